"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of (doc_id, text digest, digest of the other carried columns). A keyed Feistel
network over pairs (x, y) of Z_a x Z_b, a * b just above the number of rows, permutes the numbers; numbers that land outside the
rows walk on until they are inside. A row's place p gives its shard p mod s and its slot p div s, so shard sizes differ by
one row at most, slots have no gap, and the row of any (shard, slot) is computable by running the network backwards
(`row_at`). Nothing depends on partitions, files or machines.

The walk needs no cap: it can only pass the fewer than a points outside the rows, and `walk_length` follows just those,
about the square root of the number of rows, to find the longest walk there is.

Skew: rows are range-partitioned on all of the order; fully equal rows, which may swap places without changing the
result, are told apart by an arbitrary last key, so no id and no group of equal texts lands in one task. Equal texts are not kept together.

Behaviour at the edges: null ids come first; null texts have no bytes and the CRC of nothing; very long texts travel only
where `carry` names their column; repeated rows get a place each; an empty table gives an empty result; carried columns
are fields of `row`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import scratch_path

#: Modulus, key multiplier and number of double rounds of the network.
PRIME, STEP, ROUNDS = (1 << 31) - 1, 48271, 4
OVERHEAD, SEED = 16, 2026


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 .. rows - 1, the same for the same seed."""

    rows: int
    seed: int = SEED
    rounds: int = ROUNDS

    @property
    def sides(self) -> tuple[int, int]:
        """(a, b) with a * b >= rows and fewer than a points outside."""
        a = max(isqrt(max(self.rows - 1, 0)) + 1, 1)
        return a, max(-(-self.rows // a), 1)

    @property
    def keys(self) -> list[tuple[int, int]]:
        state, out = self.seed % PRIME + 1, []
        for _ in range(2 * self.rounds):
            state = state * STEP % PRIME
            out.append(state)
        return list(zip(out[::2], out[1::2], strict=True))

    @staticmethod
    def _mixed(value: Column, key: Column) -> Column:
        once = (value + key) % PRIME
        twice = (once * once + key) % PRIME
        return twice * twice % PRIME

    def _once(self, place: Column, back: bool) -> Column:
        a, b = self.sides
        keys = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(m).cast("long").alias("m")) for k, m in self.keys]

        def forth(s: Column, key: Column) -> Column:
            x = F.pmod(s["x"] + self._mixed(s["y"], key["k"]), F.lit(a))
            return F.struct(x.alias("x"), F.pmod(s["y"] + self._mixed(x, key["m"]), F.lit(b)).alias("y"))

        def undo(s: Column, key: Column) -> Column:
            y = F.pmod(s["y"] - self._mixed(s["x"], key["m"]), F.lit(b))
            return F.struct(F.pmod(s["x"] - self._mixed(y, key["k"]), F.lit(a)).alias("x"), y.alias("y"))

        start = F.struct((place % a).cast("long").alias("x"), F.floor(place / a).cast("long").alias("y"))
        if self.rows > 1 << 52:
            start = F.struct((place % a).cast("long").alias("x"), ((place - place % a) / a).cast("decimal(20,0)").cast("long").alias("y"))
        joined = lambda s: s["y"] * F.lit(a).cast("long") + s["x"]
        return F.aggregate(F.array(*(keys[::-1] if back else keys)), start, undo if back else forth, joined)

    def walk_length(self, spark: SparkSession) -> int:
        """Steps of the longest walk: only points outside the rows are walked on from."""
        a, b = self.sides
        outside = spark.range(self.rows, a * b).select(F.col("id").alias("p"))
        steps = 1
        while self.rows:
            outside = outside.select(self._once(F.col("p"), False).alias("p")).where(F.col("p") >= self.rows)
            if outside.isEmpty():
                break
            steps += 1
        return steps + 1

    def place(self, number: Column, steps: int, back: bool = False) -> Column:
        """Where row `number` goes; with `back`, the number of the row that goes there."""
        walked = F.sequence(F.lit(1), F.lit(steps))
        step = lambda p, i: F.when((i == 1) | (p >= self.rows), self._once(p, back)).otherwise(p)
        return F.aggregate(walked, number.cast("long"), step)


def numbered(docs: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """row (the carried columns), size, text_crc32 and row_number from 0: one range shuffle, no window over rows."""
    spark = docs.sparkSession
    carry = tuple(docs.columns) if carry is None else carry
    text = F.col("text").cast("binary")
    others = [F.col(f"`{c}`") for c in carry if c not in ("doc_id", "text")]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.col("doc_id").alias("_id"),
        F.md5(text).alias("_digest"),
        (F.xxhash64(*[F.to_json(F.struct(c.alias("v"))) for c in others]) if others else F.lit(0).cast("long")).alias("_rest"),
        F.monotonically_increasing_id().alias("_any"),
    )
    order = ["_id", "_digest", "_rest", "_any"]
    path = scratch_path(spark, "numbered")
    in_order = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    in_order.select("row", "size", "text_crc32", F.monotonically_increasing_id().alias("_at")).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("_slice", F.shiftright("_at", 33))
    sizes = kept.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"))  # one row per partition of the range shuffle
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return kept.join(offsets, "_slice").select("row", "size", "text_crc32", number.alias("row_number"))


def place(docs: DataFrame, shards: int = 40, seed: int = SEED, carry: tuple[str, ...] | None = None) -> DataFrame:
    """row, size, text_crc32, row_number, place, shard and slot of every row; `carry` names the columns to keep in `row`."""
    rows = numbered(docs, carry)
    feistel = Feistel(rows.count(), seed)
    steps = feistel.walk_length(docs.sparkSession)
    placed = rows.withColumn("place", feistel.place(F.col("row_number"), steps))
    return placed.select(
        "*",
        (F.col("place") % shards).cast("int").alias("shard"),
        ((F.col("place") - F.col("place") % shards) / shards).cast("long").alias("slot"),
    )


def row_at(spark: SparkSession, rows: int, shard: Column, slot: Column, shards: int = 40, seed: int = SEED) -> Column:
    """The row number that stands in `slot` of `shard`."""
    feistel = Feistel(rows, seed)
    return feistel.place(slot * shards + shard, feistel.walk_length(spark), back=True)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, in slot order over its files; a shard may be larger than a task, so it is cut by ranges."""
    dealt = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
