"""Hard-negative mining: rotated one-bit codes propose candidates, integer inner products decide.

Encoding. Vectors become integers, floor(scale * c). A vector is rotated at random and its signs form a one-bit code: the
unit vector b of those signs. Stored with the code is its alignment a = <x, b>; what is left, x - a b, is orthogonal to b
and is coded again by the next rotation. After `LEVELS` codes the norm of the rest is stored.

Estimate. A query's rotated entries are rounded to 8-bit numbers, one bit plane each, so <q, b> comes from the population
counts of plane AND code. <q, x> is then the sum of a <q, b> over the codes, give or take two bounds that hold for
every vector: Cauchy-Schwarz for the rest, |<q, r>| <= |r| |q without its part along b|, and the rounding of the query. The
interval after the first code drops most rows, the next codes narrow it for those that stay, and rows whose last
interval still reaches the wanted ranks are scored with integers. Intervals never exclude a row that belongs to the result,
so the result is exact.

Work. Rows are packed into blocks dealt out evenly, whatever their labels or values. A stated set of anchors, packed too,
meets every block; a pair of blocks gives each anchor its best few rows of that block, and ranks are taken over those few.
Both are shuffled to the shares that blocks are dealt to. No block, anchor, label or group is collected or broadcast anywhere:
the plan's estimate of packed rows knows nothing of their arrays, so a join left to it broadcasts every anchor once a block.

Behaviour at the edges: rows with a null label or a null vector, or one with null or non-finite entries, take no part; a vector
shorter than the longest counts as continued by zeros; entries beyond a long are cut to it; null ids come last in ties and
are never anchors; a repeated row is another row; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.whitening import _matrix, integers, usable
from granary.session import scratch_path

SCALE, LEVELS, PLANES, SEED = 256, 4, 8, 11
BLOCK, ANCHORS, SHARES = 8192, 256, 256
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Rule:
    """How many positives and negatives, and the range of a negative's score in hundredths of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


RULE = Rule()


# --- codes ----------------------------------------------------------------------------------------------------------


def rotations(dims: int) -> list[np.ndarray]:
    """One orthogonal matrix per level, over as many dimensions as the words of a code have bits."""
    wide, rng = max(-(-dims // 64) * 64, 64), np.random.default_rng(SEED)
    return [np.linalg.qr(rng.standard_normal((wide, wide)))[0] for _ in range(LEVELS)]


def encode(x: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels, words), alignments (rows, levels) and norms of the rest after each level (rows, levels)."""
    wide = len(turns[0])
    rest = np.zeros((len(x), wide))
    rest[:, : x.shape[1]] = x
    codes, along, left = [], [], []
    for turn in turns:
        up = rest @ turn >= 0
        codes.append(np.packbits(up, axis=1, bitorder="little").view("<u8"))
        b = np.where(up, 1.0, -1.0) / np.sqrt(wide)
        b = b @ turn.T
        a = (rest * b).sum(axis=1)
        rest = rest - a[:, None] * b
        along.append(a)
        left.append(np.sqrt((rest * rest).sum(axis=1)))
    return np.stack(codes, axis=1), np.stack(along, axis=1), np.stack(left, axis=1)


@dataclass
class Query:
    """A query under one rotation: bit planes of its rounded entries, and what turns counts into <q, b>."""

    planes: np.ndarray
    step: float
    base: float
    error: float

    def along(self, codes: np.ndarray) -> np.ndarray:
        """<q, b> of each code (rows, words), right to within `error`."""
        total = np.zeros(len(codes), np.int64)
        for j, plane in enumerate(self.planes):
            total += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << j
        signs = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        return self.step * total + self.base * signs - (self.step * self.total + self.base * self.wide) / 2

    total: int = 0
    wide: int = 0


def query(q: np.ndarray, turn: np.ndarray) -> Query:
    """<q, b> = sum of signs * v / sqrt(wide); with v = low + unit * u, the sum over set bits, doubled, less the whole."""
    wide = len(turn)
    v = np.zeros(wide)
    v[: len(q)] = q
    v = v @ turn
    low = v.min()
    unit = (v.max() - low) / ((1 << PLANES) - 1) or 1.0
    u = np.rint((v - low) / unit).astype(np.int64)
    planes = np.stack([np.packbits(u >> j & 1, bitorder="little").view("<u8") for j in range(PLANES)])
    root = np.sqrt(wide)
    error = float(np.abs(v - low - unit * u).sum() / root)
    return Query(planes, 2 * unit / root, 2 * low / root, error, int(u.sum()), wide)


class Intervals:
    """Bounds of <q, x> for the rows of a block, narrowed level by level for the rows asked for."""

    def __init__(self, q: np.ndarray, block: dict, turns: list[np.ndarray]):
        self.q, self.block, self.turns = q, block, turns
        self.norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        self.level, n = 0, len(block["ids"])
        self.middle, self.slack = np.zeros(n), np.zeros(n)

    def narrow(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) of `rows` after one more code; the rows must have been asked for at every level before."""
        view = query(self.q, self.turns[self.level])
        a, left = self.block["along"][rows, self.level], self.block["left"][rows, self.level]
        b = view.along(self.block["codes"][rows, self.level])
        self.middle[rows] += a * b
        self.slack[rows] += np.abs(a) * view.error
        inside = np.maximum(np.abs(b) - view.error, 0)
        across = np.sqrt(np.maximum(self.norm * self.norm - inside * inside, 0))
        rounding = 1e-9 * self.norm * (np.abs(self.block["along"][rows]).sum(axis=1) + left + 1)
        wide = self.slack[rows] + left * across + rounding
        self.level += 1
        return self.middle[rows] - wide, self.middle[rows] + wide


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or less than all with fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def scores(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Integer inner products, exact at any size."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0))
    if most * max(len(q), 1) < 1 << 62:
        return (x * q[None, :]).sum(axis=1).tolist()
    return (x.astype(object) * q.astype(object)[None, :]).sum(axis=1).tolist()


def best_same(q: np.ndarray, label: int, own: int, block: dict, turns: list[np.ndarray], rule: Rule) -> list[tuple]:
    """The best rows of the anchor's label in a block: (score, id, row)."""
    rows = np.flatnonzero((block["labels"] == label) & (block["rows"] != own))
    bounds = Intervals(q, block, turns)
    for _ in turns:
        if len(rows) <= rule.positives:
            break
        least, most = bounds.narrow(rows)
        rows = rows[most >= kth(least, rule.positives)]
    found = zip(scores(block["x"][rows], q), block["ids"][rows].tolist(), block["rows"][rows].tolist(), strict=True)
    return sorted(found, key=lambda r: (-r[0], r[1]))[: rule.positives]


def best_other(q: np.ndarray, label: int, positives: list[int], block: dict, turns: list[np.ndarray], rule: Rule) -> list[tuple]:
    """The rows of other labels that are among the best in the range of any positive: (score, id, row)."""
    ranges = sorted({(rule.low * p, rule.high * p) for p in positives if rule.low * p <= rule.high * p})
    rows = np.flatnonzero(block["labels"] != label)
    bounds = Intervals(q, block, turns)
    for _ in turns:
        if not ranges or len(rows) <= rule.negatives:
            break
        least, most = bounds.narrow(rows)
        wanted = np.zeros(len(rows), bool)
        for low, high in ranges:
            low, high = low / 100, high / 100
            pad = 1e-9 * (abs(low) + abs(high))
            inside = (least >= low + pad) & (most <= high - pad)
            wanted |= (most >= max(low - pad, kth(least[inside], rule.negatives))) & (least <= high + pad)
        rows = rows[wanted]
    if not ranges:
        return []
    found = sorted(zip(scores(block["x"][rows], q), block["ids"][rows].tolist(), block["rows"][rows].tolist(), strict=True), key=lambda r: (-r[0], r[1]))
    kept = set()
    for low, high in ranges:
        kept.update([r for r in found if low <= 100 * r[0] <= high][: rule.negatives])
    return sorted(kept, key=lambda r: (-r[0], r[1]))


# --- blocks ---------------------------------------------------------------------------------------------------------


def _pack(rows: DataFrame, parts: int, dims: int, turns: list[np.ndarray] | None) -> DataFrame:
    """Rows (id, label, x, row, anchor) dealt evenly to `parts` blocks, one row of arrays each, coded with `turns`."""
    names = ["codes", "along", "left"] if turns else ["positives"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids = np.concatenate([b.column("id").fill_null(NO_ID).to_numpy() for b in held])
        labels = np.concatenate([b.column("label").to_numpy() for b in held])
        x = np.concatenate([_matrix(b.column("x"), dims) for b in held])
        part = TaskContext.get().partitionId()
        if turns:
            anchor = np.concatenate([b.column("anchor").to_numpy(zero_copy_only=False) for b in held])
            own = (np.int64(part) << np.int64(32)) + np.arange(len(ids), dtype=np.int64)
            more = [np.ascontiguousarray(c).tobytes() for c in encode(x.astype(np.float64), turns)]
        else:
            anchor, own = np.ones(len(ids), bool), np.concatenate([b.column("row").to_numpy() for b in held])
            more = [pa.array([p for b in held for p in b.column("positives").to_pylist()])]
        cells = [part, len(ids), ids.tobytes(), labels.tobytes(), own.tobytes(), x.tobytes(), anchor.tobytes()]
        columns = [pa.array([c], pa.int32() if i < 2 else pa.large_binary()) for i, c in enumerate(cells)]
        columns += [pa.array([m], pa.large_binary()) if turns else pa.array([m.to_pylist()], pa.list_(pa.list_(pa.decimal128(38)))) for m in more]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "ids", "labels", "rows", "x", "anchor", *names])

    kinds = "part int, n int, ids binary, labels binary, rows binary, x binary, anchor binary, "
    kinds += ", ".join(f"{n} binary" for n in names) if turns else "positives array<array<decimal(38,0)>>"
    return rows.repartition(parts).mapInArrow(packed, kinds)


def _opened(batch: pa.RecordBatch, i: int, prefix: str, dims: int, coded: bool) -> dict:
    """The arrays of one packed block."""
    value = lambda name: batch.column(prefix + name)[i].as_buffer()
    n = batch.column(prefix + "n")[i].as_py()
    out = {k: np.frombuffer(value(k), np.int64) for k in ("ids", "labels", "rows")}
    out["x"] = np.frombuffer(value("x"), np.int64).reshape(n, dims)
    if coded:
        out["codes"] = np.frombuffer(value("codes"), "<u8").reshape(n, LEVELS, -1)
        for k in ("along", "left"):
            out[k] = np.frombuffer(value(k), np.float64).reshape(n, LEVELS)
    return out


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", rule: Rule = RULE, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `anchor` says which rows are anchors."""
    spark = rows.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    usable_rows = rows.where(F.col(label).isNotNull() & usable(vector))
    plain = usable_rows.select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        integers(vector, scale).alias("x"),
        F.coalesce(anchor & F.col(vec_id).isNotNull(), F.lit(False)).alias("anchor"),
    )
    size = plain.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims"), F.sum(F.col("anchor").cast("long")).alias("anchors")).first()
    n, dims, anchors = size.n, size.dims or 0, size.anchors or 0
    turns = rotations(dims)
    parts, groups = max(-(-n // BLOCK), 1), max(-(-anchors // ANCHORS), 1)
    shares = min(parts, SHARES)
    blocks = stored(_pack(plain, parts, dims, turns), "blocks")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _opened(batch, i, "", dims, False)
                at = np.flatnonzero(np.frombuffer(batch.column("anchor")[i].as_buffer(), bool))
                x = pa.array(b["x"][at].tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(b["ids"][at]), pa.array(b["labels"][at]), pa.array(b["rows"][at]), x], names=["id", "label", "row", "x"])

    asked = stored(blocks.mapInArrow(taken, "id long, label long, row long, x array<long>"), "anchors")

    def met(queries: DataFrame, search: str) -> DataFrame:
        """Every anchor block with every block of rows: (anchor, anchor_id, score, id, row)."""
        left = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
        right = blocks.withColumn("share", F.col("part") % shares)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    q, block = _opened(batch, i, "q_", dims, False), _opened(batch, i, "", dims, True)
                    known = batch.column("q_positives")[i].as_py()
                    out = []
                    for j in range(len(q["ids"])):
                        if search == "same":
                            best = best_same(q["x"][j], q["labels"][j], q["rows"][j], block, turns, rule)
                        else:
                            best = best_other(q["x"][j], q["labels"][j], [int(p) for p in known[j]], block, turns, rule)
                        out += [(int(q["rows"][j]), int(q["ids"][j]), *b) for b in best]
                    kinds = [pa.int64(), pa.int64(), pa.decimal128(38), pa.int64(), pa.int64()]
                    columns = [pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "anchor_id", "score", "id", "row"])

        both = left.repartitionById(shares, "share").hint("merge").join(right.repartitionById(shares, "share"), "share")
        return both.mapInArrow(found, "anchor long, anchor_id long, score decimal(38,0), id long, row long")

    first = asked.withColumn("positives", F.array().cast("array<decimal(38,0)>"))
    near = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    same = met(_pack(first, groups, dims, None), "same").withColumn("k", F.row_number().over(near)).where(F.col("k") <= rule.positives)
    positives = stored(same, "positives")
    known = positives.groupBy("anchor").agg(F.array_agg("score").alias("positives"))
    again = asked.join(known, asked["row"] == known["anchor"]).select(asked["*"], "positives")
    others = met(_pack(again, groups, dims, None), "other").select("anchor", F.col("id").alias("negative"), "row", F.col("score").alias("against"))
    pairs = positives.select("anchor", "anchor_id", "k", F.col("id").alias("positive"), "score").join(others, "anchor")
    pairs = pairs.where((F.col("score") * rule.low <= F.col("against") * 100) & (F.col("against") * 100 <= F.col("score") * rule.high))
    hard = Window.partitionBy("anchor", "k").orderBy(F.desc("against"), "negative", "row")
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return pairs.withColumn("rank", F.row_number().over(hard)).where(F.col("rank") <= rule.negatives).select(
        "anchor_id",
        shown("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        shown("negative").alias("negative_id"),
        F.col("score").cast("long").alias("positive_score"),
        F.col("against").cast("long").alias("negative_score"),
    )
