"""Exact substring deduplication by prefix-free parsing.

A rolling hash places triggers in every text (`repeats.phrases`) and cuts it into phrases, each of which holds all windows
of one trigger. Equal phrases are one entry of the dictionary, known by its hash as in any prefix-free parsing; the parse
says which entry stands at which place. Entries and places are dealt to buckets by trigger. An entry that stands alone
at its trigger is settled by the parse: all its windows repeat with it or none does. For the other triggers the suffixes of
the entries are put in order, to the depth of a window, and the runs whose longest common prefix reaches a window are the
repeated strings; the parse, its places in the order of documents under each entry, turns a run of suffixes into the
run of places in the corpus, whose first document keeps the string. The parse's own suffix array would order equal windows by what
follows them, which no result needs, so places stay in document order. Work is in proportion to repetition, not to the corpus.

Behaviour at the edges: a null text has no bytes; texts shorter than `length` keep all bytes; a null doc_id comes before
all others; rows that share a doc_id count as one document, so they remove nothing from each other; an empty table gives
an empty result; other columns are ignored by `dedup`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm import repeats as R

LENGTH, GRAM = 50, 20


def _cut(length: int):
    def cut(text: bytes, firsts, windows) -> list[bytes]:
        return [text[f : f + w + length - 1] for f, w in zip(firsts.tolist(), windows.tolist(), strict=True)]

    return cut


def suffix_runs(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The dictionary's suffixes of `length` bytes or more in order, as places in `raw`, and the run of each.

    Suffixes are ordered by their first `length` bytes, eight at a time; only those still equal go on to the next eight. A
    run holds suffixes whose longest common prefix reaches `length`; runs of one are left out.
    """
    room = np.maximum(ends - begins - length + 1, 0)
    at = np.repeat(begins - (np.cumsum(room) - room), room) + np.arange(room.sum())
    padded = np.append(raw, np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    run = np.zeros(len(at), np.int64)
    for depth in range(0, length, 8):
        if not len(at):
            break
        key = words[at + depth].copy().view(">u8")[:, 0].astype(np.uint64)
        if length - depth < 8:
            key >>= np.uint64(8 * (8 - length + depth))
        order = np.lexsort((key, run)) if depth else np.argsort(key, kind="stable")
        at, run, key = at[order], run[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        run = np.cumsum(new) - 1
        again = np.bincount(run)[run] > 1
        at, run = at[again], run[again]
    return at, run


def _suffix_order(length: int):
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"doc_key": [], "tag": [], "first": [], "windows": []})
        if not len(pdf):
            return none
        # the parse: which phrase of the dictionary stands at each place, the places of a phrase in the order of documents
        phrase, dictionary = pd.factorize(pdf["content"])
        doc, first, tag = pdf["doc_key"].to_numpy(), pdf["first"].to_numpy(), pdf["tag"].to_numpy()
        places = np.lexsort((tag, first, doc, phrase))
        opens = np.searchsorted(phrase[places], np.arange(len(dictionary) + 1))
        raw = np.frombuffer(b"".join(dictionary), np.uint8)
        sizes = np.array([len(c) for c in dictionary], np.int64)
        begins = np.cumsum(sizes) - sizes
        at, run = suffix_runs(raw, begins, begins + sizes, length)
        if not len(at):
            return none
        # combined: a run's places are those of its phrases, and the first document of each is at hand
        holder = np.searchsorted(begins, at, "right") - 1
        least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, run, doc[places[opens[holder]]])
        count = opens[holder + 1] - opens[holder]
        each = np.repeat(np.arange(len(at)), count)
        place = places[np.repeat(opens[holder] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        hit = doc[place] > least[run[each]]
        place, each = place[hit], each[hit]
        begin = first[place] + (at - begins[holder])[each]
        return pd.DataFrame({"doc_key": doc[place], "tag": tag[place], "first": begin.astype(np.int32), "windows": np.ones(len(place), np.int32)})

    return judge


def _remove(length: int):
    def remove(text: bytes, first: np.ndarray, windows: np.ndarray) -> tuple:
        if not len(first):
            return len(text), 0, 0, text
        raw = np.frombuffer(text, np.uint8)
        gone = R.covered(len(raw), first, windows, length)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(raw), int(gone.sum()), spans, raw[~gone].tobytes()

    return remove


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: removal may cut characters).
    """
    rows = R.keyed(docs)
    marks = R.phrase_marks(rows, R.as_bytes, length, gram, "smaller_doc")
    texts = R.packed(rows)
    spans = R.repeated_windows(texts, marks, _cut(length), length, _suffix_order(length))
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
    ddl = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept": T.BinaryType()}
    return R.rewritten(R.with_spans(texts, spans), _remove(length), kinds, ddl)
