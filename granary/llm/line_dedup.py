"""Removal of repeated runs of lines by winnowing.

Each line is hashed. In every window of `run` lines the least hash of a pair of neighbouring lines is the window's
fingerprint (`repeats.phrases`), so two texts that share a run of that length share a fingerprint for certain. Positions
with one fingerprint meet, matches are extended both ways to whole phrases, and of each repeated run all but the first
place (least doc_id, then position) is deleted. A passage on fewer lines than `run` has no such window. `dedup_documents`
therefore also takes fewer neighbouring lines that hold `PASSAGE` words together for a run; `dedup` does so if asked.

Behaviour at the edges: lines are what a split at "\n" gives, compared byte by byte, and empty lines count as lines; a
null text has no lines and stays null; texts with fewer than `run` lines stay as they are (but for passages); a null doc_id comes before all
others; of repeated rows with one doc_id and text, none is the earlier one, so both keep what no other place has; rows
with one doc_id and different texts have an order by position, then by the hash of their text; an empty table gives an
empty result; all other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import repeats as R

RUN, GRAM, PASSAGE = 3, 2, 50


def _cut(run: int):
    def cut(text: bytes, firsts, windows) -> list[bytes]:
        lines = text.split(b"\n")
        return [b"\n".join(lines[f : f + w + run - 1]) for f, w in zip(firsts.tolist(), windows.tolist(), strict=True)]

    return cut


def _compare(run: int):
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [c.split(b"\n") for c in pdf["content"]]
        doc, first, tag = pdf["doc_key"].to_numpy(), pdf["first"].to_numpy(), pdf["tag"].to_numpy()
        earliest: dict[tuple, tuple] = {}
        places = []
        for i, (phrase, windows) in enumerate(zip(lines, pdf["windows"], strict=True)):
            for o in range(windows):
                key, place = tuple(phrase[o : o + run]), (doc[i], first[i] + o, tag[i])
                places.append((i, o, key, place))
                if place < earliest.setdefault(key, place):
                    earliest[key] = place
        hits = [(i, o) for i, o, key, place in places if earliest[key] < place]
        at = np.array([h[0] for h in hits], np.int64)
        rows = pdf.iloc[at]
        begin = rows["first"].to_numpy() + np.array([h[1] for h in hits], np.int64)
        return pd.DataFrame({"doc_key": rows["doc_key"].to_numpy(), "tag": rows["tag"].to_numpy(), "first": begin.astype(np.int32), "windows": np.ones(len(at), np.int32)})

    return judge


def _remove(run: int):
    def remove(text: bytes, first: np.ndarray, windows: np.ndarray) -> tuple:
        lines = text.split(b"\n")
        if not len(first):
            return len(lines), 0, text.decode()
        gone = R.covered(len(lines), first, windows, run)
        return len(lines), int(gone.sum()), b"\n".join(x for x, out in zip(lines, gone.tolist(), strict=True) if not out).decode()

    return remove


def _wordy(lines: int, words: int):
    def among(raw: np.ndarray, bounds: np.ndarray, first: np.ndarray) -> np.ndarray:
        begins, ends, _ = R.tokens(raw, bounds, R.NEWLINE, empty=True)
        starts = R.tokens(raw, bounds, R.SPACES)[0]
        return np.searchsorted(starts, ends[first + lines - 1]) - np.searchsorted(starts, begins[first]) >= words

    return among


def _passages(rows: DataFrame, run: int, words: int) -> list[DataFrame]:
    """Runs of fewer than `run` lines with `words` words or more that start at an earlier place, as windows of `run` lines.

    Each is a phrase by itself, so none is left open. The number of windows makes up for the lines it lacks.
    """
    short = []
    for lines in range(1, run):
        marks = R.phrase_marks(rows, R.as_lines, lines, lines, "earlier", _wordy(lines, words))
        short.append(marks.where(F.col("state") == R.REPEATED).select("doc_key", "tag", "first", (F.col("windows") + lines - run).cast("int").alias("windows")))
    return short


def dedup(docs: DataFrame, run: int = RUN, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """Delete each line covered by `run` neighbouring lines that also start at an earlier place of the corpus.

    With `words`, fewer neighbouring lines are a run too if they hold so many words.

    Returns the columns of `docs` with `text` rewritten, then n_lines and n_removed_lines under names made free by a
    prefix "_" if `docs` has them already.
    """
    rows = R.keyed(docs, whole=True)
    marks = R.phrase_marks(rows, R.as_lines, run, gram, "earlier")
    texts = R.packed(rows)
    spans = R.repeated_windows(texts, marks, _cut(run), run, _compare(run))
    for short in _passages(rows, run, words) if words else []:
        spans = spans.unionByName(short)
    kinds = {"n_lines": pa.int64(), "n_removed_lines": pa.int64(), "text": pa.string()}
    ddl = {"n_lines": T.LongType(), "n_removed_lines": T.LongType(), "text": T.StringType()}
    found = R.with_spans(texts, spans)
    kept = [F.col("rest").alias("kept")] if "rest" in found.columns else []
    out = R.rewritten(found.withColumn("rest", F.struct(F.col("text").isNull().alias("none"), *kept)), _remove(run), kinds, ddl)
    text = F.when(F.col("rest.none"), F.lit(None)).otherwise(F.col("text")).cast("string")
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name = f"_{name}"
        return name

    columns = [F.col("doc_id") if c == "doc_id" else text.alias(c) if c == "text" else F.col(f"rest.kept.`{c}`").alias(c) for c in docs.columns]
    lines = F.when(F.col("rest.none"), F.lit(0)).otherwise(F.col("n_lines")).cast("long")
    return out.select(*columns, lines.alias(free("n_lines")), F.col("n_removed_lines").alias(free("n_removed_lines")))


def dedup_documents(docs: DataFrame, run: int = RUN, gram: int = GRAM, words: int | None = PASSAGE) -> DataFrame:
    """`dedup` with only the columns of `docs`, without documents of which no line is left."""
    out = dedup(docs, run, gram, words)
    n, removed = out.columns[-2:]
    return out.where((F.col(removed) == 0) | (F.col(removed) < F.col(n))).select(*[F.col(f"`{c}`") for c in docs.columns])
