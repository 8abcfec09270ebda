"""Benchmark decontamination with DataFrame functions only.

Texts are normalised to words: A-Z in lower case, ASCII letters, digits and all other non-ASCII characters. A window is
`ngram` consecutive words of a benchmark item, or the whole of a shorter item. Windows are a hash table on their longest
word, which is broadcast; one pass over each document's words probes it and compares the words around a hit, inside the
same code-generated stage, so nothing but verified hits leaves the scan. The table is broadcast in slices of at most
`SLICE_BYTES`, one pass each, so its size is bounded whatever the size of the benchmark.

Behaviour at the edges: a null or wordless text has no words and is never contaminated; an item without words has no
window; a null item_id is an item of that name, "null"; equal items count once each; rows with one doc_id are told apart
by their text and repeated rows get the same answer; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between normalised words, and between the words of a text as it is.
BREAK, RAW_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
NGRAM, SLICE_BYTES = 10, 32 << 20


def words(text: str | Column) -> Column:
    text = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(text, f"{BREAK}+"), "")


def benchmark_windows(benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """One row per distinct window: window, items, and its longest word (the first of them) as anchor with its offset."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words("text").alias("w"))
    items = items.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - ngram + 1, F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, ngram))).alias("window"))
    shared = cut.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    longest = F.array_max(F.transform("window", lambda x, i: F.struct(F.length(x).alias("long"), (-i).alias("at"))))
    return shared.withColumn("offset", -longest["at"]).withColumn("anchor", F.element_at("window", F.col("offset") + 1))


def table_slices(windows: DataFrame) -> list[DataFrame]:
    """Parts of `benchmark_windows` of about `SLICE_BYTES` at most, dealt by the whole window: anchors may be shared by many."""
    weight = F.sum(F.octet_length(F.concat_ws(" ", "window")) + F.octet_length(F.concat_ws(",", "items")) + 100)
    slices = -(-(windows.agg(weight).first()[0] or 1) // SLICE_BYTES)
    return [windows.where(F.pmod(F.xxhash64("window"), F.lit(slices)) == k) for k in range(slices)]


def hits(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """Verified occurrences: doc_id, _text_key, start (first word, from 0), size, items."""
    spread = docs.select("doc_id", F.xxhash64("text").alias("_text_key"), words("text").alias("w"))
    spread = spread.select("doc_id", "_text_key", "w", F.posexplode("w").alias("at", "word"))
    found = None
    for part in map(F.broadcast, table_slices(benchmark_windows(benchmark, ngram))):
        around = F.slice("w", F.greatest(F.col("at") - F.col("offset"), F.lit(0)) + 1, F.size("window"))
        match = (F.col("word") == F.col("anchor")) & (F.col("at") >= F.col("offset")) & (around == F.col("window"))
        rows = spread.join(part, match).select("doc_id", "_text_key", (F.col("at") - F.col("offset")).alias("start"), F.size("window").alias("size"), "items")
        found = rows if found is None else found.unionByName(rows)
    return found


def _covered(spans: Column) -> Column:
    """Number of words that sorted (start, size) spans cover."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, span: Column) -> Column:
        end = span["start"] + span["size"]
        fresh = F.greatest(end - F.greatest(span["start"], state["upto"]), F.lit(0))
        return F.struct(F.greatest(state["upto"], end).alias("upto"), (state["n"] + fresh).alias("n"))

    return F.aggregate(spans, zero, step, lambda s: s["n"])


def report(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids of occurring items, sorted as strings), spans of hit words."""
    found = (
        hits(docs, benchmark, ngram)
        .groupBy("doc_id", "_text_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select(F.col("doc_id").alias("_hit_id"), F.col("_text_key").alias("_hit_key"), "spans", "items")
    )
    base = docs.select("doc_id", F.xxhash64("text").alias("_text_key"), F.size(words("text")).cast("long").alias("n_words"))
    joined = base.join(found, base.doc_id.eqNullSafe(found._hit_id) & (base._text_key == found._hit_key), "left")
    return joined.select(
        "doc_id",
        "_text_key",
        "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, remove: str = "documents") -> DataFrame:
    """`docs` without contaminated documents, or with `remove="spans"` all of them without the hit words.

    A removed word takes the characters between it and the next word with it.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = hits(docs, benchmark, ngram).groupBy("doc_id", "_text_key").agg(F.collect_set(F.struct("start", "size")).alias("hit_spans"))
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("_text_key").alias("hit_key"), "hit_spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # the user's columns, apart from those made here
    keyed = docs.select(row, F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_key") == F.col("hit_key"))
    own = {c: F.col(f"row.`{c}`").alias(c) for c in docs.columns}
    if remove == "documents":
        return keyed.join(found, same, "left_anti").select(*own.values())
    plain = F.col("row.text")
    pieces = F.regexp_extract_all(plain, F.lit(f"({RAW_WORD}+{RAW_BREAK}*)"), F.lit(1))
    left = F.filter(pieces, lambda p, i: ~F.exists("hit_spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["size"])))
    text = F.concat(F.regexp_extract(plain, f"^{RAW_BREAK}*", 0), F.array_join(left, ""))
    own["text"] = F.when(F.col("hit_spans").isNull(), plain).otherwise(text).alias("text")
    return keyed.join(found, same, "left").select(*own.values())
