"""Quality rules: compression bands over whole documents and fixed chunks.

zstandard's ratio (bytes before over bytes after) is high where a text repeats itself and near 1 where it is random or
already compressed. What is normal depends on the length, so each band of lengths has limits of its own for the whole
text; every fixed chunk is held to one pair of limits, and what is left after the last whole chunk to those of its own
length. So each byte of a text is in a part that is judged. A text must also pass the base rule on words.

Behaviour at the edges: a null or empty text has no words and fails the base rule; a very long text is compressed whole
and chunk by chunk; repeated rows get a row each; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from granary.llm.repeats import small_batches

SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio: (bytes up to, least, most) for whole texts, (least, most) for chunks.

    The defaults leave room on both sides of what prose in a European language has at each length.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 1.95),
        (256, 0.9, 1.95),
        (512, 1.15, 2.1),
        (1024, 1.25, 2.2),
        (2048, 1.4, 2.32),
        (4096, 1.5, 2.38),
        (8192, 1.6, 2.48),
        (16384, 1.6, 2.55),
        (65536, 1.6, 2.7),
        (float("inf"), 1.6, 2.85),
    )
    chunk: int = 2048
    chunk_limits: tuple[float, float] = (1.4, 2.32)


BANDS = Bands()


def ratios(text: bytes, bands: Bands, tool: zstandard.ZstdCompressor) -> tuple[float, float, float, float]:
    """Of the whole text, the least and the most of its whole chunks, and of what is left after them; 1 where there is none."""
    if not text:
        return 1.0, 1.0, 1.0, 1.0
    ratio = lambda part: len(part) / len(tool.compress(part))
    upto = len(text) - len(text) % bands.chunk
    each = [ratio(text[i : i + bands.chunk]) for i in range(0, upto, bands.chunk)] or [1.0]
    return ratio(text), min(each), max(each), ratio(text[upto:]) if upto < len(text) else 1.0


def limits(n_bytes: int, bands: Bands) -> tuple[float, float]:
    return next((low, high) for upto, low, high in bands.whole if n_bytes <= upto)


def in_band(n_bytes: int, whole: float, least: float, most: float, rest: float, bands: Bands) -> bool:
    low, high = limits(n_bytes, bands)
    if not low <= whole <= high:
        return False
    if n_bytes >= bands.chunk and not (bands.chunk_limits[0] <= least and most <= bands.chunk_limits[1]):
        return False
    low, high = limits(n_bytes % bands.chunk, bands)
    return n_bytes % bands.chunk == 0 or low <= rest <= high


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    upto = total = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "least_chunk_ratio", "most_chunk_ratio", "last_chunk_ratio")


def judge(text: bytes, bands: Bands, tool: zstandard.ZstdCompressor) -> tuple:
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) - sum(map(text.count, SPACES))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, repeated = len(words), repeated_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    whole, least, most, rest = ratios(text, bands, tool)
    kept = not failed and in_band(len(text), whole, least, most, rest, bands)
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, kept, whole, least, most, rest


def score(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept and the ratios."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            found = [judge(t or b"", bands, tool) for t in texts]
            columns = [pa.array(c) for c in zip(*found, strict=True)] if found else [pa.array([])] * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *NAMES])

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, least_chunk_ratio double, most_chunk_ratio double, last_chunk_ratio double"
    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, kinds)
