"""Removal of repeated word sequences by suffix automata of reference shards.

The reference is the corpus itself, cut into shards by trigger (`repeats`): a window of `length` words and all its copies have
one trigger, so they lie in one shard. Phrases equal as a whole are settled when they are dealt to shards. For the
rest a shard's phrases are streamed through the suffix automaton of its other phrases for matching statistics: at each
word the length of the longest suffix that occurs in the reference. Words under a match of `length` or more are removed. A
reference made of the whole corpus has no size bound, so shards are brought to their phrases by a shuffle and not
broadcast to all documents.

Behaviour at the edges: a null text has no words; texts with fewer than `length` words keep all; repetition inside one
document counts; rows that share a doc_id and text repeat each other; a null doc_id is a document like any other; an
empty table gives an empty result; other columns are ignored by `dedup`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm import repeats as R

LENGTH, GRAM = 35, 12
SHARD_WORDS = 40_000  # bounds an automaton's memory


class SuffixAutomaton:
    """All substrings of the sequences added, in linear size."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.long = [-1], [0]

    def _state(self, long: int, link: int, following: dict) -> int:
        self.long.append(long)
        self.link.append(link)
        self.next.append(following)
        return len(self.long) - 1

    def _clone(self, p: int, q: int, word) -> int:
        copy = self._state(self.long[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:  # seen in an earlier sequence
                last = q if self.long[q] == self.long[last] + 1 else self._clone(last, q, word)
                continue
            new, p = self._state(self.long[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.long[q] == self.long[p] + 1 else self._clone(p, q, word)
            last = new

    def matches(self, sequence) -> list[int]:
        """For each position, the length of the longest match that ends there."""
        at = size = 0
        out = []
        for word in sequence:
            while at and word not in self.next[at]:
                at = self.link[at]
                size = self.long[at]
            if word in self.next[at]:
                at, size = self.next[at][word], size + 1
            out.append(size)
        return out


def _cut(length: int):
    def cut(text: bytes, firsts, windows) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[f : f + w + length - 1]) for f, w in zip(firsts.tolist(), windows.tolist(), strict=True)]

    return cut


def _shards(length: int):
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The phrases of a trigger are the reference and the stream: each is matched against all others of the trigger.

        A shard holds distinct phrases of about `SHARD_WORDS` words. Going through it, each phrase is first matched against the
        automaton of those before it and then added; going back, against those behind it; phrases of other shards are
        matched against the whole of it. A window is repeated if a match of its length ends at its last word on any way.
        Inside a phrase no window stands twice, since all of its windows hold the trigger at one place.
        """
        content, state, trigger = pdf["content"].to_numpy(), pdf["state"].to_numpy(), pdf["trigger"].to_numpy()
        out = []
        order = np.argsort(trigger, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(trigger[order])) + 1):
            holders: dict[bytes, list[int]] = {}
            for i in group:
                holders.setdefault(content[i], []).append(i)
            if len(holders) < 2:
                continue
            phrases = [(c.split(b" "), [i for i in held if state[i] == R.OPEN]) for c, held in holders.items()]
            ends: list[set] = [set() for _ in phrases]

            def stream(k: int, automaton: SuffixAutomaton) -> None:
                words, wanted = phrases[k]
                if wanted and len(ends[k]) < len(words) - length + 1:
                    ends[k].update(end for end, size in enumerate(automaton.matches(words)) if size >= length)

            upto = np.cumsum([len(words) for words, _ in phrases]) // SHARD_WORDS
            for shard in np.split(np.arange(len(phrases)), np.flatnonzero(np.diff(upto)) + 1):
                for way in (shard, shard[::-1]):
                    automaton = SuffixAutomaton()
                    for k in way.tolist():
                        stream(k, automaton)
                        automaton.add(phrases[k][0])
                inside = set(shard.tolist())
                for k in range(len(phrases)) if len(inside) < len(phrases) else ():
                    if k not in inside:
                        stream(k, automaton)
            out += [(i, end - length + 1) for k, (_, wanted) in enumerate(phrases) for i in wanted for end in ends[k]]
        which = np.array([x[0] for x in out], np.int64)
        rows = pdf.iloc[which]
        first = rows["first"].to_numpy() + np.array([x[1] for x in out], np.int64)
        return pd.DataFrame({"doc_key": rows["doc_key"].to_numpy(), "tag": rows["tag"].to_numpy(), "first": first.astype(np.int32), "windows": np.ones(len(which), np.int32)})

    return judge


def _remove(length: int):
    def remove(text: bytes, first: np.ndarray, windows: np.ndarray) -> tuple:
        words = text.split()
        if not len(first):
            return len(words), 0, b" ".join(words).decode()
        gone = R.covered(len(words), first, windows, length)
        return len(words), int(gone.sum()), b" ".join(w for w, out in zip(words, gone.tolist(), strict=True) if not out).decode()

    return remove


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove each word covered by `length` consecutive words whose sequence also starts anywhere else.

    Returns doc_id, n_words, n_removed and kept (the words left, joined by one space).
    """
    rows = R.keyed(docs)
    marks = R.phrase_marks(rows, R.as_words, length, gram, "anywhere")
    texts = R.packed(rows)
    spans = R.repeated_windows(texts, marks, _cut(length), length, _shards(length))
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
    ddl = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept": T.StringType()}
    return R.rewritten(R.with_spans(texts, spans), _remove(length), kinds, ddl)
