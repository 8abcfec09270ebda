"""Windows of a fixed length that occur more than once in a corpus, found exactly and without all-pairs work.

A text is a sequence of symbols (bytes, words or lines). Of the `length - gram + 1` grams inside a window, the one with
the least rolling hash is the window's trigger. Every occurrence of a window has the same trigger at the same place, so
consecutive windows with one trigger form a phrase, and phrases deal all windows out exactly once. Phrases are hashed
and meet by trigger:

- a trigger seen once has no repeated window; this settles nearly all of a corpus;
- a phrase equal to another one is settled as a whole;
- what is left are the phrases where a repeated passage begins or ends. Only their symbols are read again, and a
  `judge` compares them window by window.

Phrases travel as compressed arrays, one row for each batch and bucket of triggers, so a common passage adds a few bytes
for each document that holds it and never a row per pair.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import isgeneratorfunction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from granary.session import scratch_path

U = np.uint64
_STEP, _LOW = 1 << 18, (1 << 24) - 1
_KEEP, _FLUSH = 8 << 20, 1 << 18
RULES = ("anywhere", "smaller_doc", "earlier")


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def frugal(task: Callable) -> Callable:
    """`task`, giving freed memory back at its end: executors keep Python workers for later tasks."""

    @wraps(task)
    def rows(batches: Iterator) -> Iterator:
        yield from task(batches)
        release()

    @wraps(task)
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = task(pdf)
        release()
        return out

    return rows if isgeneratorfunction(task) else group


# --- rolling hashes -------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def process_cache() -> dict:
    """What this process keeps between tasks. Task functions travel by value, so a cache in their module would be new in every task."""
    return sys.__dict__.setdefault("_granary_cache", {})


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, `n` at least."""
    n, kept = 1 << max(18, n.bit_length()), process_cache()
    if "powers" not in kept or len(kept["powers"][0]) < n:
        base = 0xD6E8FEB86659FD93
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, U)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        kept["powers"] = (out[0], out[1])
    return kept["powers"]


def byte_symbols() -> np.ndarray:
    kept = process_cache()
    if "byte_symbols" not in kept:
        kept["byte_symbols"] = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    return kept["byte_symbols"]


def prefix_sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, U)
    np.cumsum(x * powers(len(x) + 1)[0][: len(x)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of the symbols in [a, b), the same wherever they stand."""
    return (prefix[b] - prefix[a]) * powers(len(prefix))[1][a]


# --- symbols of a batch of texts ------------------------------------------------------------------------------------


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and where each text begins and ends."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    bounds = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if len(bounds) == 0:
        bounds = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def tokens(raw: np.ndarray, bounds: np.ndarray, breaks: np.ndarray, empty: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes between `breaks` (a table of 256 flags), and the bounds in runs.

    With `empty`, each break ends one run, empty ones too, and so does the end of a text, as in a split by lines.
    """
    n = len(raw)
    cut = breaks[raw]
    if empty:
        at = np.flatnonzero(cut)
        doc = np.searchsorted(bounds, at, "right") - 1
        ends = np.concatenate([at, bounds[1:]])
        order = np.lexsort((np.concatenate([np.zeros(len(at), np.int8), np.ones(len(bounds) - 1, np.int8)]), ends, np.concatenate([doc, np.arange(len(bounds) - 1)])))
        ends = ends[order]
        count = np.bincount(doc, minlength=len(bounds) - 1) + 1
        runs = np.concatenate([[0], np.cumsum(count)])
        begins = np.empty_like(ends)
        begins[1:] = ends[:-1] + 1
        begins[runs[:-1]] = bounds[:-1]
        return begins, ends, runs
    edge = np.ones(n + 1, bool)
    edge[1:n] = cut[: n - 1]
    edge[bounds] = True
    word = ~cut
    begins = np.flatnonzero(word & edge[:n])
    last = np.ones(n, bool)
    if n:
        last[: n - 1] = cut[1:]
        inner = bounds[(bounds > 0) & (bounds <= n)] - 1
        last[inner] = True
    ends = np.flatnonzero(word & last) + 1
    return begins, ends, np.searchsorted(begins, bounds)


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def run_symbols(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    prefix = prefix_sums(byte_symbols()[raw])
    return mix(spans_hash(prefix, begins, ends) + (ends - begins).astype(U))


def steps(bounds: np.ndarray, most: int = _STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text stands alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, j
        i = j


def as_bytes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_symbols()[raw], bounds


def as_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins, ends, runs = tokens(raw, bounds, SPACES)
    return run_symbols(raw, begins, ends), runs


def as_lines(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins, ends, runs = tokens(raw, bounds, NEWLINE, empty=True)
    return run_symbols(raw, begins, ends), runs


# --- phrases --------------------------------------------------------------------------------------------------------


def phrases(x: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, trigger, hash) of each phrase of the texts in `x`."""
    if len(x) > _KEEP and len(x) >= 2 * length:
        parts = []
        for a in range(0, len(x) - length + 1, _KEEP // 2):  # windows that begin in [a, a + _KEEP // 2)
            b = min(len(x), a + _KEEP // 2 + length - 1)
            inside = np.clip(bounds, a, b) - a
            parts.append([p + s for p, s in zip(phrases(x[a:b], inside, length, gram), (0, a, 0, U(0), U(0)), strict=True)])
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    windows = len(x) - length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    prefix = prefix_sums(x)
    inverse = powers(len(prefix))[1]
    grams = mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(x) - gram + 1])
    least = (grams & ~U(_LOW)) | np.arange(len(grams), dtype=U)
    width, need = 1, length - gram + 1
    while 2 * width <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < need:
        least = np.minimum(least[: width - need], least[need - width :])
    trigger = (least & U(_LOW)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = text[:windows] == text[length - 1 :]
    new = np.ones(windows, bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, windows))
    kept = whole[first]
    first, count = first[kept], count[kept]
    trigger = trigger[first]
    content = mix(spans_hash(prefix, first, first + count + length - 1) * U(3) + (trigger - first).astype(U))
    return text[first], first, count, mix(grams[trigger] + U(1)), content  # least hashes are small: spread them again


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, equal bytes of neighbouring numbers side by side."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueeze(blob: bytes, count: int, *kinds: type) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in map(np.dtype, kinds):
        plane = np.frombuffer(data, np.uint8, count * kind.itemsize, at).reshape(kind.itemsize, count)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(count))
        at += count * kind.itemsize
    return out


_KINDS = (U, U, np.int64, np.int64, np.int32, np.uint16)
_BITS = U(16)  # dropped from a trigger: 48 bits are left


def _emit(kept: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    trigger, content, doc, tag, first, count = (np.concatenate(p) for p in zip(*kept, strict=True))
    order = np.argsort(trigger, kind="stable")
    trigger = trigger[order]
    bucket = ((trigger >> U(32)) * U(buckets)) >> U(32)
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rows = []
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        at, short = order[a:b], trigger[a:b] >> _BITS
        step = np.diff(short, prepend=U(0))
        rows.append((int(bucket[a]), b - a, squeeze(step, content[at] >> U(24), doc[at], tag[at], first[at].astype(np.int32), count[at].astype(np.uint16))))
    names = ["bucket", "n", "data"]
    kinds = [pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _phrase_rows(symbols: Callable, length: int, gram: int, buckets: int, among: Callable | None = None) -> Callable:
    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            raw, bounds = texts_of(batch.column("text"))
            doc = batch.column("doc_key").to_numpy(zero_copy_only=False)
            tag = batch.column("tag").to_numpy(zero_copy_only=False)
            for i, j in steps(bounds):
                part, edges = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                x, inside = symbols(part, edges)
                found = phrases(x, inside, length, gram)
                if among:
                    kept_here = among(part, edges, found[1])
                    found = [a[kept_here] for a in found]
                text, first, count, trigger, content = found
                text = text.astype(np.int64)
                kept.append((trigger, content, doc[text + i], tag[text + i], first - inside[text], count))
                held += len(first)
                if held >= _FLUSH:
                    yield _emit(kept, buckets)
                    kept, held = [], 0
        if held:
            yield _emit(kept, buckets)

    return rows


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, n)))


#: State of a phrase: settled as repeated, or to be judged, or only kept for others to be compared with.
REPEATED, OPEN, SEEN = 0, 1, 2


def _settle(rule: str) -> Callable:
    @frugal
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for n, data in zip(pdf["n"], pdf["data"], strict=True):
            step, *rest = unsqueeze(data, n, *_KINDS)
            parts.append((np.cumsum(step, dtype=U), *rest))
        trigger, content, doc, tag, first, count = (np.concatenate(p) for p in zip(*parts, strict=True))
        del parts
        order = np.argsort(trigger, kind="stable")
        starts = _group_starts(trigger[order])
        sizes = np.diff(np.append(starts, len(order)))
        many = sizes > 1
        if rule == "smaller_doc":
            d = doc[order]
            many &= np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        order = order[np.repeat(many, sizes)]
        trigger, content, doc, tag, first, count = (a[order] for a in (trigger, content, doc, tag, first, count))
        order = np.lexsort((tag, first, doc, content, trigger))
        trigger, content, doc, tag, first, count = (a[order] for a in (trigger, content, doc, tag, first, count))
        n = len(order)
        if not n:
            return pd.DataFrame({"doc_key": [], "tag": [], "first": [], "windows": [], "state": [], "trigger": []})
        same = _group_starts(trigger, content)
        alike = _spread(np.diff(np.append(same, n)), same, n)  # how many phrases are equal to this one
        leading = np.zeros(n, bool)
        leading[same] = True
        group = _group_starts(trigger)
        kinds = _spread(np.add.reduceat(leading.astype(np.int64), group), group, n)  # different phrases at the trigger
        state = np.full(n, -1, np.int8)
        if rule == "anywhere":
            state[alike > 1] = REPEATED
            alone = alike == 1
            state[alone & (kinds > 1)] = OPEN
            wanted = _spread(np.maximum.reduceat(alone.astype(np.int8), group), group, n) > 0
            extra = leading & (alike > 1) & wanted
        else:
            place = (doc, first, tag) if rule == "earlier" else (doc,)
            later = np.zeros(n, bool)  # equal rows share a place, and none of them is later
            for p in place:
                later |= p != _spread(p[same], same, n)
            state[later] = REPEATED
            state[~later & (kinds > 1)] = OPEN
            extra = np.zeros(n, bool)
        at = np.concatenate([np.flatnonzero(state >= 0), np.flatnonzero(extra)])
        marks = np.concatenate([state[state >= 0], np.full(int(extra.sum()), SEEN, np.int8)])
        return pd.DataFrame({"doc_key": doc[at], "tag": tag[at], "first": first[at], "windows": count[at].astype(np.int32), "state": marks.astype(np.int32), "trigger": trigger[at].astype(np.int64)})

    return settle


# --- documents ------------------------------------------------------------------------------------------------------


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, doc_key, tag, text), with `whole` all other columns as `rest`.

    Null ids come before all others. Rows that share an id are told apart by 64 bits of hash of their text.
    """
    docs = small_batches(docs)
    shared = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    tag = F.xxhash64("text") if shared else F.lit(0).cast("long")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if whole else []
    kept = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []
    return docs.select("doc_id", key.alias("doc_key"), tag.alias("tag"), "text", *kept)


def small_batches(docs: DataFrame, most: int = 8 << 20) -> DataFrame:
    """`docs`, with the session's Arrow batches held to `most` bytes, so that long texts don't fill a task's memory.

    The plan reads this setting when it runs, so it stays set; a smaller value of the user's is kept.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).rstrip("b")) > most:
        conf.set(name, str(most))
    return docs


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts_for(spark: SparkSession, work: int, each: int) -> int:
    """So many buckets that each holds about `each`, and no fewer than the session's partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-work // each))


def packed(rows: DataFrame) -> DataFrame:
    """`keyed` rows with the text compressed, which is what is shuffled."""
    schema = StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in rows.schema])

    @frugal
    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).cast(pa.large_binary()).to_pylist()
            yield b.set_column(at, "text", pa.array([None if t is None else tool.compress(t) for t in texts], pa.binary()))

    return rows.mapInArrow(squeezed, schema)


def unpack(blob: bytes | None) -> bytes:
    return b"" if blob is None else zstandard.ZstdDecompressor().decompress(blob)


def phrase_marks(rows: DataFrame, symbols: Callable, length: int, gram: int, rule: str, among: Callable | None = None) -> DataFrame:
    """Phrases of `keyed` rows with a repeated window or the chance of one: (doc_key, tag, first, windows, state, trigger).

    `among(raw, bounds, firsts)` gives flags of the phrases to look at, without it all are.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = rows.sparkSession
    buckets = parts_for(spark, text_bytes(rows), 4 << 20)
    found = rows.select("doc_key", "tag", "text").mapInArrow(_phrase_rows(symbols, length, gram, buckets, among), "bucket int, n long, data binary")
    marks = found.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_settle(rule), "doc_key long, tag long, first int, windows int, state int, trigger long")
    path = scratch_path(spark, "phrases")
    marks.write.parquet(path)
    return spark.read.parquet(path)


def open_phrases(texts: DataFrame, marks: DataFrame, cut: Callable, length: int, judge: Callable) -> DataFrame:
    """Windows of phrases left open that `judge` finds repeated: (doc_key, tag, first, windows).

    `cut(text, firsts, windows)` gives the bytes of each phrase; `judge` gets a bucket's phrases as a pandas frame.
    """
    spark = texts.sparkSession
    left = marks.where(F.col("state") != REPEATED)
    buckets = parts_for(spark, left.count() * (2 * length), 4 << 20)
    wanted = left.groupBy("doc_key", "tag").agg(F.collect_list(F.struct("first", "windows", "state", "trigger")).alias("open"))
    names = ["doc_key", "tag", "first", "windows", "state", "trigger", "content"]

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, fields = nested(batch.column("open"))
            size = np.diff(offsets)
            content = []
            for i, blob in enumerate(batch.column("text").to_pylist()):
                a, b = offsets[i], offsets[i + 1]
                content += cut(unpack(blob), fields["first"][a:b], fields["windows"][a:b])
            ids = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), size)) for c in names[:2]]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(fields[c]) for c in names[2:6]), pa.array(content, pa.binary())], names=names)

    cuts = texts.join(wanted, ["doc_key", "tag"]).select("doc_key", "tag", "text", "open").mapInArrow(
        rows, "doc_key long, tag long, first int, windows int, state int, trigger long, content binary"
    )
    bucket = F.pmod(F.xxhash64("trigger"), F.lit(buckets)).cast("int")
    return cuts.withColumn("bucket", bucket).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(frugal(judge), "doc_key long, tag long, first int, windows int")


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """`packed` rows with the repeated windows of each as an array, null where there are none."""
    found = spans.groupBy("doc_key", "tag").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    return texts.join(found, ["doc_key", "tag"], "left")


def repeated_windows(texts: DataFrame, marks: DataFrame, cut: Callable, length: int, judge: Callable) -> DataFrame:
    settled = marks.where(F.col("state") == REPEATED).select("doc_key", "tag", "first", "windows")
    return settled.unionByName(open_phrases(texts, marks, cut, length, judge))


def nested(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where the list of each row begins and ends, and the fields of all its structs; null is an empty list."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    fields = {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}
    return np.concatenate([[0], np.cumsum(sizes)]), fields


def covered(count: int, first: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Flags of the symbols that the windows cover."""
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + windows + length - 1, -1)
    return np.cumsum(edge[:count]) > 0


def rewritten(found: DataFrame, remove: Callable, kinds: dict[str, pa.DataType], ddl: dict[str, object]) -> DataFrame:
    """Replace text and spans of `with_spans` rows by what `remove(text, first, windows)` returns, columns `kinds`."""
    kept = [f for f in found.schema if f.name in ("doc_id", "rest")]
    schema = StructType([*kept, *(StructField(c, t) for c, t in ddl.items())])

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, fields = nested(batch.column("spans"))
            out = []
            for i, blob in enumerate(batch.column("text").to_pylist()):
                a, b = offsets[i], offsets[i + 1]
                out.append(remove(unpack(blob), fields["first"][a:b].astype(np.int64), fields["windows"][a:b].astype(np.int64)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *kinds])

    return found.mapInArrow(rows, schema)


def window_groups(pdf: pd.DataFrame, symbols: Callable, length: int, breaks: bytes) -> tuple[np.ndarray, ...]:
    """Windows of a bucket's open phrases that have an equal among them, by rolling hash.

    Returns the phrase, the offset in it and the hash of each, equals side by side.
    """
    joined = breaks.join(pdf["content"])
    raw = np.frombuffer(joined, np.uint8)
    sizes = pdf["content"].str.len().to_numpy()
    begins = np.concatenate([[0], np.cumsum(sizes + len(breaks))[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    phrase, offset, key = [], [], []
    for i in range(0, len(sizes), 20_000):
        part = slice(i, i + 20_000)
        a, b = begins[part][0], begins[part][-1] + sizes[part][-1]
        bounds = np.append(begins[part], b) - a
        x, inside = symbols(raw[a:b], bounds)
        windows = pdf["windows"].to_numpy()[part].astype(np.int64)
        which = np.repeat(np.arange(len(windows)), windows)
        at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = inside[:-1][which] + at
        key.append(mix(spans_hash(prefix_sums(x), start, start + length)))
        phrase.append(which + i)
        offset.append(at)
    phrase, offset, key = (np.concatenate(p) for p in (phrase, offset, key))
    order = np.argsort(key, kind="stable")
    starts = _group_starts(key[order])
    sizes = np.diff(np.append(starts, len(order)))
    again = order[np.repeat(sizes > 1, sizes)]
    return phrase[again], offset[again], key[again]
