"""SimHash near-duplicates with pigeonring filtering.

The 64 bits are a ring of `2 * bits + 1` segments. If two fingerprints differ in at most `bits` places, then from some
segment on, every chain of l consecutive segments differs in at most l * bits / segments places (the pigeonring
principle). The first two segments of such a chain are therefore equal, which gives a join key; longer chains are
checked against their budgets before the full Hamming distance is. Fingerprints that share a key with more than `CROWD`
others are not paired: each is linked through the points half-way between it and its neighbours, which finds the same
groups with a number of rows that is linear in the fingerprints. Groups are connected components of distinct
fingerprints, found by alternating large and small stars over tables in the shared folder.

Behaviour at the edges: a null or empty text has fingerprint zero and is linked like any other; a text with fewer words
than a shingle is one shingle; repeated rows each get a row; a null doc_id never names a component unless nothing else
is in it; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import repeats as R
from granary.session import scratch_path

SEED, WORDS, BITS = 42, 3, 2
CROWD = 64


def fingerprint_of(text: bytes, words: int = WORDS) -> int:
    """Bits set in over half of the XXH64 hashes of all shingles, repeats included."""
    found = text.lower().split()
    if not found:
        return 0
    runs = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, runs), chain.from_iterable(iter(lambda: (SEED,), None)))
    counts, n = np.zeros(64, np.int64), 0
    while True:
        part = np.fromiter((h for _, h in zip(range(1 << 17), hashes, strict=False)), np.uint64)
        if not len(part):
            break
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint_of(t or b"", words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return R.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(count: int) -> list[int]:
    edges = [64 * i // count for i in range(count + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _differ(a: str, b: str, mask: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(_signed(mask))))


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at `bits` differing bits or fewer, enough of them to connect all that are."""
    if bits not in (1, 2, 3):
        raise ValueError("bits must be 1, 2 or 3")
    count = 2 * bits + 1
    masks = _segments(count)
    keys = [masks[i] | masks[(i + 1) % count] for i in range(count)]
    signs = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(k))) for k in keys])).alias("start", "key"))
    crowds = signs.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = signs.join(crowds, ["start", "key"])
    few = shared.where(F.col("n") <= CROWD).drop("n")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["start", "key"]).where("a < b")
    checks = []
    for i in range(count):
        cells, here = masks[i] | masks[(i + 1) % count], F.lit(True)
        for size in range(3, count + 1):
            cells |= masks[(i + size - 1) % count]
            here = here & (_differ("a", "b", cells) <= size * bits // count)
        checks.append((F.col("start") == i) & here)
    passed = checks[0]
    for c in checks[1:]:
        passed = passed | c
    near = pairs.where(passed).where(_differ("a", "b", (1 << 64) - 1) <= bits).select("a", "b").distinct()
    return near.unionByName(_crowded(shared.where(F.col("n") > CROWD), keys, bits))


def _crowded(shared: DataFrame, keys: list[int], bits: int) -> DataFrame:
    """Links inside crowded keys: two fingerprints are near if a point lies within half the distance of either."""
    crowd = shared.select("fp", "start").groupBy("start", "fp").agg(F.lit(1).alias("one"))
    places = F.array(*[F.array(*[F.lit(_signed(1 << b)) for b in range(64) if not k >> b & 1]) for k in keys])
    free = F.element_at(places, F.col("start") + 1)
    near = F.concat(F.array(F.lit(0).cast("long")), free)
    far = near
    if bits == 3:
        far = F.array_distinct(F.concat(near, F.flatten(F.transform(free, lambda x: F.transform(free, lambda y: x.bitwiseXOR(y))))))
    if bits == 1:
        near = F.array(F.lit(0).cast("long"))
    points = lambda flips, own: crowd.select("fp", F.explode(flips).alias("flip"), F.lit(own).alias("own")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp", "own")
    around = points(near, True) if bits == 2 else points(near, True).unionByName(points(far, False))
    least = around.where("own").groupBy("point").agg(F.min("fp").alias("b"))
    return around.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of `edges` (a, b) reaches, by alternating large and small stars."""
    spark = edges.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "stars")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return pairs.join(least, "a")

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = stored(small)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def with_roots(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """`prints` with `root`, the least fingerprint that each one's `fp` reaches over links."""
    reached = components(links(prints.select("fp").distinct(), bits)).select(F.col("node").alias("_fp"), "root")
    return prints.join(reached, F.col("fp") == F.col("_fp"), "left").select(*prints.columns, F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the least doc_id reachable over links."""
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    fingerprints(docs, words).write.parquet(path)
    rooted = with_roots(spark.read.parquet(path), bits)
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(names, "root").select("doc_id", "fp", "component_id")


# --- near copies by similarity --------------------------------------------------------------------------------------
#
# The groups of fingerprints above are checked in full by an exact similarity: texts of one template can come within `BITS`
# without being copies. At a similarity of 0.8 fingerprints mostly differ in 5 to 20 of 64 bits, and no chain of segments is
# equal often enough to be a key there, so pairs outside the groups are sought as well: min-wise keys connect most of them
# cheaply, and prefixes of the ordered shingles, which no pair escapes, find the rest. Nodes and keys are made of distinct
# shingles, as the similarity is; fingerprints are those of `fingerprint_of`.

NEAR_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, NEAR_CROWD, LEADERS, OUTSIDE, MAPS = 12, 4, 64, 8, 512, 8
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_hashes(raw: np.ndarray, bounds: np.ndarray, words: int = NEAR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts and the bounds in shingles; a shorter text is one shingle, an empty one none."""
    x, runs = R.as_words(_FOLD[raw], bounds)
    size = np.diff(runs)
    count = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    edges = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(runs[:-1] - edges[:-1], count) + np.arange(edges[-1])
    stop = np.minimum(start + words, np.repeat(runs[1:], count))
    return R.mix(R.spans_hash(R.prefix_sums(x), start, stop) + (stop - start).astype(R.U)), edges


def _per_text(values: np.ndarray, edges: np.ndarray, how: np.ufunc, empty: int) -> np.ndarray:
    out = np.full(len(edges) - 1, empty, values.dtype)
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        out[some] = how.reduceat(values, edges[some])
    return out


def _distinct(h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text without repeats, sorted, and their bounds."""
    if len(edges) == 2:
        h = np.unique(h)
        return h, np.array([0, len(h)])
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((h, text))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])  # sorting leaves `text` as it is
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(edges) - 1))])


def _sketches(words: int, similarity: float = SIMILARITY):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * R.U(2) + R.U(1)
        for batch in batches:
            raw, bounds = R.texts_of(batch.column("text"))
            fps = np.zeros(len(bounds) - 1, np.uint64)
            node, keys = np.zeros(len(fps), np.int64), np.zeros((len(fps), BANDS), np.uint64)
            size, prefix, firsts = np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64), [np.zeros(0, np.uint64)]
            for i, j in R.steps(bounds):
                h, edges = _distinct(*shingle_hashes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words))
                fps[i:j] = [fingerprint_of(raw[a:b].tobytes()) for a, b in zip(bounds[i:j], bounds[i + 1 : j + 1], strict=True)]
                node[i:j] = R.mix(_per_text(R.mix(h), edges, np.add, 0)).view(np.int64)
                size[i:j] = np.diff(edges)
                prefix[i:j] = np.where(size[i:j] > 0, size[i:j] - np.ceil(similarity * size[i:j] - 1e-6).astype(np.int64) + 1, 0)
                firsts.append(h[np.arange(len(h)) - np.repeat(edges[:-1], size[i:j]) < np.repeat(prefix[i:j], size[i:j])])
                for band in range(BANDS):
                    key = np.full(j - i, band, np.uint64)
                    for t in turns[band * ROWS : (band + 1) * ROWS]:
                        key = R.mix(key * R.U(31) + _per_text(h * t, edges, np.minimum, 0))
                    keys[i:j, band] = key
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            ends = pa.array(np.concatenate([[0], np.cumsum(prefix)]), pa.int32())
            firsts = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(firsts).view(np.int64)))
            columns = [batch.column("doc_key"), batch.column("tag"), pa.array(node), pa.array(fps.view(np.int64)), lists, pa.array(size), firsts]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_key", "tag", "node", "fp", "keys", "size", "firsts"])

    return rows


def _sets(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for blob in batch.column("text").to_pylist():
                raw = np.frombuffer(R.unpack(blob), np.uint8)
                sets.append(np.unique(shingle_hashes(raw, np.array([0, len(raw)]), words)[0]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows


def _similar(least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _single_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, blob in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
            found = np.frombuffer(blob, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node, np.int64)), pa.array(found)], names=["node", "shingle"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of sets and, in `MAPS` words, which of their hash classes hold an odd number of shingles."""
    for batch in batches:
        sets = [np.frombuffer(blob, np.uint64) for blob in batch.column("shingles").to_pylist()]
        odd = np.array([np.bincount(R.mix(x) % R.U(64 * MAPS), minlength=64 * MAPS) & 1 for x in sets], np.uint8).reshape(len(sets), 64 * MAPS)
        words = np.packbits(odd, axis=1, bitorder="little").view("<i8")
        sizes = pa.array([len(x) for x in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("node"), sizes, *(pa.array(words[:, i].copy()) for i in range(MAPS))], names=["node", "size", *(f"{i}m" for i in range(MAPS))])


def near_copies(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY, bits: int = BITS) -> DataFrame:
    """(doc_key, tag, node, group_key, group_tag) of `repeats.keyed` rows: the first document of each one's group.

    Groups are connected by all pairs whose sets of `words`-word shingles (A-Z in lower case) have a Jaccard similarity of
    `similarity` or more; equal sets are one node. Pairs are sought in three steps, each among nodes that are not connected yet.

    First a node's keys are the groups that `links` of its fingerprints form and its min-wise keys, which connect most. Of a key
    that more than `NEAR_CROWD` nodes share, those with too many shingles of their own to match any other leave; each of the rest
    is compared with `LEADERS` of them, after bounds from sizes and from bitmaps of their sets (two sets differ in as many
    shingles as their bitmaps in bits). If all but `OUTSIDE` of a crowd are in one component, those outside are compared with
    the rest.

    Then the shingles of each node that come first by hash are keys. Of sets with s and r shingles that similar ones share a
    shingle among the first s - ceil(ts) + 1 and r - ceil(tr) + 1. What they share there and what follows in the one whose
    prefix ends first is all they can share, so counts of common keys leave few pairs to compare.

    The nodes of crowded keys meet under the rarest shingles of each instead (`prefixes`), and under a crowded one of these
    every pair of components is compared in the end. So no pair is lost.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    rows = R.keyed(docs)
    kind = "doc_key long, tag long, node long, fp long, keys array<long>, size long, firsts array<long>"
    sketches = stored(rows.select("doc_key", "tag", "text").mapInArrow(_sketches(words, similarity), kind), "sketches")
    nodes = stored(sketches.groupBy("node").agg(F.min(F.struct("doc_key", "tag", "keys", "size", "firsts")).alias("first")).select("node", "first.*"), "nodes")
    grouped = with_roots(sketches.select("node", "fp").distinct(), bits).select("node", F.lit(BANDS).alias("band"), F.col("root").alias("key")).distinct()
    cells = nodes.select("node", F.posexplode("keys").alias("band", "key")).unionByName(grouped)
    crowds = cells.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(cells.join(crowds, ["band", "key"]), "shared")

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = some.join(nodes.select("node", "doc_key", "tag"), "node")
        texts = R.packed(rows).join(wanted, ["doc_key", "tag"]).dropDuplicates(["doc_key", "tag"]).select("node", "text")
        return stored(texts.mapInArrow(_sets(words), "node long, shingles binary"), "sets")

    sets = sets_of(shared.select("node").distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
        of = lambda n, x: sets.select(F.col("node").alias(n), F.col("shingles").alias(x))
        long = F.octet_length("x"), F.octet_length("y")
        full = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").where(F.least(*long) >= similarity * F.greatest(*long) - 1e-6)
        return stored(full.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long"), "verified")

    maps = [f"{i}m" for i in range(MAPS)]

    def sides(left: DataFrame, right: DataFrame, but: str) -> DataFrame:
        """Pairs under a key that no link connects yet, that sizes and bitmaps allow."""
        short = {"node": "n", "root": "r", "main": "m", "every": "e", "size": "s", "common": "c", "short": "i"} | {m: m for m in maps}
        named = lambda df, x: df.select("key", *[F.col(c).alias(to + x) for c, to in short.items() if c in df.columns])
        both = F.col("sa") + F.col("sb")
        shared_ = F.least("ca", "cb") * (1 + similarity) >= similarity * both - 1e-6
        apart = sum((F.bit_count(F.col(m + "a").bitwiseXOR(F.col(m + "b"))) for m in maps), F.lit(0)) * (1 + similarity) <= (1 - similarity) * both + 1e-6
        allowed = F.expr(f"ra <> rb and ({but})") & F.coalesce(shared_ & apart, F.lit(True))
        if "short" in left.columns:
            allowed = allowed & F.expr("sa <= sb and ia or sb <= sa and ib")
        return named(left, "a").join(named(right, "b"), "key").where(allowed)

    def proposed(keyed: DataFrame) -> DataFrame:
        """Pairs inside keys of (key, node, ..., n): all of a small crowd, each with its leaders in a larger one."""
        few, many = keyed.where(F.col("n") <= NEAR_CROWD), keyed.where(F.col("n") > NEAR_CROWD)
        least = many.groupBy("key").agg(*[F.min(F.xxhash64("node", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)])
        led = many.join(least, "key").where(" or ".join(f"xxhash64(node, {i}) = l{i}" for i in range(LEADERS)))
        return sides(few, few, "na < nb").select("na", "nb").unionByName(sides(many, led, "na <> nb").select("na", "nb")).toDF("a", "b")

    def outside(keyed: DataFrame) -> DataFrame:
        """Pairs of the few nodes outside a key's main component with all of other components, once in their least key."""
        full = keyed.join(keyed.groupBy("node").agg(F.collect_set("key").alias("every")), "node")
        pairs = sides(full.where("root <> main"), full, "rb = mb or na < nb")
        return pairs.where(F.array_min(F.array_intersect("ea", "eb")) == F.col("key")).select("na", "nb").toDF("a", "b")

    def prefixes(crowd: DataFrame) -> DataFrame:
        """(key, node, root, n, facts, short): the rarest shingles of each node of `crowd` as keys.

        Similar sets x and y, y not the larger, share at least t |x| and 2 t / (1 + t) |y| shingles. The rarest they share
        is therefore among the first |x| - t |x| + 1 of x and the first |y| - 2 t / (1 + t) |y| + 1 of y (`short`).
        """
        facts = bounds(crowd)
        held = sets.join(facts, "node").select("node", "shingles").mapInArrow(_single_shingles, "node long, shingle long")
        often = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
        first = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1
        ranked = held.join(often, "shingle").withColumn("rank", rank).join(facts, "node").where((F.col("often") > 1) & (F.col("rank") <= first(similarity)))
        ranked = ranked.withColumn("short", F.col("rank") <= first(2 * similarity / (1 + similarity))).withColumnRenamed("shingle", "key").drop("often", "rank")
        ranked = stored(ranked.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node")), "prefixes")
        sizes = ranked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key", "n")
        return stored(ranked.join(sizes, "key"), "exact")

    def unsettled(keyed: DataFrame) -> DataFrame:
        """Rows of crowded keys whose nodes are in several components, with the largest of these and how many are not in it."""
        rest = keyed.where(F.col("n") > NEAR_CROWD).drop("n", "root").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
        tally = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("main"), (F.sum("n") - F.max("n")).alias("out"))
        return stored(rest.join(tally.where("out > 0"), "key"), "open")

    def bounds(crowd: DataFrame) -> DataFrame:
        """(node, size, maps, common) of the nodes of `crowd` that share enough shingles with the others to be similar to one."""
        held = sets.join(stored(crowd, "crowd"), "node").select("node", "shingles")
        single = held.mapInArrow(_single_shingles, "node long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
        alone = single.where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
        drawn = held.mapInArrow(_bitmaps, ", ".join(["node long", "size long", *(f"`{m}` long" for m in maps)]))
        facts = drawn.join(alone, "node", "left").withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone")
        return stored(facts.where(F.col("common") >= similarity * F.col("size") - 1e-6), "facts")

    def ordered() -> DataFrame:
        """(key, node, size, root, n): the first shingles of each node as keys, where nodes of several components share one."""
        keyed = nodes.select("node", "size", F.explode("firsts").alias("key"))
        crowds = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        keyed = keyed.join(crowds, "key").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
        keyed = stored(keyed, "firsts")
        apart = keyed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
        return stored(keyed.join(apart, "key"), "ordered")

    def counted(keyed: DataFrame) -> DataFrame:
        """Pairs that share as many of their first shingles as similar sets do."""
        named = lambda x: keyed.select("key", *[F.col(c).alias(c[0] + x) for c in ("node", "root", "size")])
        pairs = named("a").join(named("b"), "key").where("na < nb and ra <> rb").where(F.least("sa", "sb") >= similarity * F.greatest("sa", "sb") - 1e-6)
        pairs = pairs.groupBy("na", "nb", "sa", "sb").agg(F.count(F.lit(1)).alias("first"))
        later = F.ceil(similarity * F.greatest("sa", "sb") - 1e-6) - 1
        enough = (F.col("first") + later) * (1 + similarity) >= similarity * (F.col("sa") + F.col("sb")) - 1e-6
        return pairs.where(enough).select("na", "nb").toDF("a", "b")

    def joined(linked: DataFrame) -> DataFrame:
        return rooted if linked.isEmpty() else components(linked.unionByName(rooted.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    met = shared.select(F.xxhash64("band", "key").alias("key"), "node", F.col("node").alias("root"), "n")
    facts = bounds(met.where(F.col("n") > NEAR_CROWD).select("node").distinct())
    many = met.where(F.col("n") > NEAR_CROWD).drop("n").join(facts, "node")
    many = many.join(many.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    few = met.where(F.col("n") <= NEAR_CROWD).withColumns({c: F.lit(None).cast("long") for c in facts.columns if c != "node"})
    met = stored(few.unionByName(many), "met")
    rooted = components(verified(proposed(met)))
    rest = unsettled(met).where(F.col("out") <= OUTSIDE)
    if not rest.isEmpty():
        rooted = joined(verified(outside(rest)))
    met = ordered()
    pairs, hot = stored(counted(met.where(F.col("n") <= NEAR_CROWD)), "counted"), met.where(F.col("n") > NEAR_CROWD).select("node").distinct()
    late = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot).distinct().join(sets, "node", "left_anti")
    late = stored(late, "late")
    if not late.isEmpty():
        sets = sets.unionByName(sets_of(late))
    rooted = joined(verified(pairs))
    if not hot.isEmpty():
        exact = prefixes(hot)
        rooted = joined(verified(proposed(exact)))
        rest = unsettled(exact)
        if not rest.isEmpty():
            left = sides(rest.where("root <> main"), rest, "rb = mb or na < nb")
            rooted = joined(verified(left.select("na", "nb").toDF("a", "b")))
    rooted = sketches.join(rooted, "node", "left").select("doc_key", "tag", "node", F.coalesce("root", "node").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min(F.struct("doc_key", "tag")).alias("first"))
    return rooted.join(firsts, "root").select("doc_key", "tag", "node", F.col("first.doc_key").alias("group_key"), F.col("first.tag").alias("group_tag"))


def keep_one(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with the first document (least doc_id) of each group of near copies.

    Of rows with one id and text that differ in other columns, the one whose other columns come first as JSON stays.
    """
    path = scratch_path(docs.sparkSession, "kept")
    groups_ = near_copies(docs, words, similarity)
    groups_.where("doc_key = group_key and tag = group_tag").select("doc_key", "tag").distinct().write.parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    rows = R.keyed(docs, whole=True).join(kept, ["doc_key", "tag"], "left_semi")
    if "rest" in rows.columns:
        rest = F.min_by("rest", F.to_json("rest")).alias("rest")
        rows = rows.groupBy("doc_key", "tag").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), rest)
    else:
        rows = rows.dropDuplicates(["doc_key", "tag"])
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
