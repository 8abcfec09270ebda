"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). The tokens of each cell are summed once; raking then scales the
cells' probabilities until the expected tokens match the target share of every source, language and topic in turn. A
probability can't exceed 1: cells that would are fixed there and the others raked again to the rest. A document is kept
with its cell's probability, drawn by a hash of its id, so the choice does not depend on partitions. Cells stay in one
table with their probability in the row: a step is one window sum over the cells of a category, a round is one job that
writes the table once, and nothing is broadcast.

A category with fewer tokens than its target asks for can't reach it. Then `repeat` takes documents more than once,
`largest_keep` gives the share to keep at which all targets are met, and `marginals` shows the gap that is left otherwise.

A source may hold any share of all rows: cells are pre-aggregated where they are read, and documents meet their cell's
weight by a join that adaptive execution can split.

Behaviour at the edges: a null source or language is a category of its own; a null text has no tokens and the topic
"empty"; categories without a target keep the share they have; rows with a null doc_id are drawn by the hash of their text;
repeated rows are drawn alike; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import discard, scratch_path

TOLERANCE, KEEP, SEED, FLATTEN = 1e-3, 0.5, 7, 0.5
DIMENSIONS = ("source", "lang", "topic")


def tokens(text: str = "text") -> Column:
    """Words as a stand-in for tokens."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return F.size(F.array_remove(F.split(plain, "[ \t-\r]+"), "")).cast("long")


def topic(text: str = "text") -> Column:
    """A coarse topic by form: what a text looks like stands in for what it is about."""
    plain = F.coalesce(F.col(text), F.lit(""))
    long = F.greatest(F.length(plain), F.lit(1))
    signs = F.length(plain) - F.length(F.translate(plain, "#*$%&|<>{}=_0123456789", ""))
    lines = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(F.length(F.trim(plain)) == 0, "empty")
        .when(signs * 20 > long, "marked")
        .when(long < 60 * lines, "listed")
        .when(long >= 6000, "essay")
        .when(long >= 1500, "article")
        .otherwise("note")
    )


def _celled(docs: DataFrame) -> DataFrame:
    other = F.lit("(none)")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("source").cast("string"), other).alias("source"),
        F.coalesce(F.col("lang").cast("string"), other).alias("lang"),
        topic().alias("topic"),
        tokens().alias("tokens"),
        F.coalesce(F.xxhash64("doc_id", F.lit(SEED)).cast("long"), F.lit(0)).alias("_id_hash") if "doc_id" in docs.columns else F.lit(0).alias("_id_hash"),
    )


class _Cells:
    """The cells as a table that is written anew after each change; the one before is removed."""

    def __init__(self, spark: SparkSession, first: DataFrame):
        self.spark, self.path = spark, None
        self.put(first)

    def put(self, df: DataFrame) -> None:
        path = scratch_path(self.spark, "cells")
        df.write.parquet(path)
        if self.path is not None:
            discard(self.spark, self.path)
        self.path, self.rows = path, self.spark.read.parquet(path)


def _within(dimension: str) -> Window:
    """The cells of a category: at most the product of the other two dimensions' categories, whatever the documents."""
    return Window.partitionBy(dimension)


def _once(column: str, dimension: str) -> Column:
    """The sum over categories of what every cell of a category carries in `column`."""
    return F.sum(F.col(column) / F.col(f"cells_{dimension}"))


def targeted(cells: DataFrame, wanted: dict[str, dict[str, float]] | None = None, flatten: float = FLATTEN) -> DataFrame:
    """`cells` with target_<dimension>, the share of tokens that the cell's category is to have, and cells_<dimension>.

    `wanted` has shares by category; the others of a dimension keep the share they have. Without any, shares are flattened by a power.
    """
    spark = cells.sparkSession
    rows = cells
    for d in DIMENSIONS:
        own = F.sum("tokens").over(_within(d)).cast("double")
        given = None if wanted is None else wanted.get(d, {})
        rows = rows.withColumns({f"cells_{d}": F.count(F.lit(1)).over(_within(d)).cast("double"), f"own_{d}": own})
        if given is None:
            want = F.pow(f"own_{d}", F.lit(flatten))
        else:
            pairs = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))]) if given else F.lit(None).cast("map<string,double>")
            want = F.element_at(pairs, F.col(d))
        rows = rows.withColumn(f"want_{d}", want)
    table = _Cells(spark, rows)
    total = table.rows.agg(F.sum("tokens")).first()[0] or 0
    for d in DIMENSIONS:
        share = F.col(f"own_{d}") / (float(total) or 1.0)
        table.rows = table.rows.withColumn(f"want_{d}", F.coalesce(f"want_{d}", share)).drop(f"own_{d}")
    sums = table.rows.agg(*[_once(f"want_{d}", d).alias(d) for d in DIMENSIONS]).first()
    scaled = {f"target_{d}": F.col(f"want_{d}") / (sums[d] or 1.0) for d in DIMENSIONS}
    return table.rows.withColumns(scaled).drop(*[f"want_{d}" for d in DIMENSIONS])


def _rests(table: _Cells, total: float, keep: float) -> dict[str, float]:
    """Give every cell the tokens that its categories still want from their free cells, `rest_<dimension>`; scales for them.

    A category without free cells can't give more than it has. Its gap would make the other dimensions unreachable too, so
    all dimensions are scaled to the least total that the free cells of one can give.
    """
    rows = table.rows
    for d in DIMENSIONS:
        free = F.sum(F.when(~F.col("fixed"), F.col("tokens")).otherwise(0)).over(_within(d))
        taken = F.sum(F.when(F.col("fixed"), F.col("tokens") * F.col("probability")).otherwise(0.0)).over(_within(d))
        rest = F.greatest(F.col(f"target_{d}") * total * keep - taken, F.lit(0.0))
        rows = rows.withColumn(f"rest_{d}", F.when(free > 0, rest).otherwise(0.0))
    table.put(rows)
    sums = table.rows.agg(*[_once(f"rest_{d}", d).alias(d) for d in DIMENSIONS]).first()
    least = min(sums[d] or 0.0 for d in DIMENSIONS)
    return {d: least / sums[d] if sums[d] else 0.0 for d in DIMENSIONS}


def _round(table: _Cells, scales: dict[str, float]) -> tuple[float, int]:
    """Scale the free cells to the rests of each dimension in turn: the largest move of a factor, and how many cells exceed 1."""
    rows = table.rows.withColumn("gap", F.lit(0.0))
    for d in DIMENSIONS:
        now = F.sum(F.when(~F.col("fixed"), F.col("probability") * F.col("tokens")).otherwise(0.0)).over(_within(d))
        rows = rows.withColumn("now", now)
        factor = F.when(~F.col("fixed") & (F.col("now") > 0), F.col(f"rest_{d}") * scales[d] / F.col("now")).otherwise(1.0)
        moved = F.when(F.col(f"rest_{d}") * scales[d] > 0, F.abs(F.col("factor") - 1)).otherwise(0.0)
        rows = rows.withColumn("factor", factor).withColumns({"probability": F.col("probability") * F.col("factor"), "gap": F.greatest("gap", moved)}).drop("now", "factor")
    table.put(rows)
    seen = table.rows.agg(F.max("gap").alias("gap"), F.count_if(_over()).alias("over")).first()
    return seen.gap or 0.0, seen.over


def _over() -> Column:
    return ~F.col("fixed") & (F.col("probability") > 1)


def calibrate(cells: DataFrame, keep: float = KEEP, tolerance: float = TOLERANCE, repeat: bool = False) -> DataFrame:
    """`cells` as `targeted` gives them, with the probability at which each is kept.

    Raking goes on until no factor moves by more than `tolerance`, or the moves no longer shrink because the targets contradict
    each other. Cells that then exceed 1 are fixed there and the others raked again to what is left, until none does.
    With `repeat`, cells may exceed 1: their documents are then taken more than once. `marginals` tells the gaps that are left.
    """
    table = _Cells(cells.sparkSession, cells.withColumns({"probability": F.lit(float(keep)), "fixed": F.lit(False)}))
    total = float(table.rows.agg(F.sum("tokens")).first()[0] or 0)
    while True:
        scales = _rests(table, total, keep)
        (before, over), idle = _round(table, scales), 0
        while before > tolerance and idle < 3:  # three rounds in a row that hardly shrank the moves
            gap, over = _round(table, scales)
            idle = 0 if gap < 0.9 * before else idle + 1
            before = gap
        if repeat or not over:
            break
        fixed = {"fixed": F.col("fixed") | _over(), "probability": F.when(_over(), 1.0).otherwise(F.col("probability"))}
        table.rows = table.rows.withColumns(fixed)  # written with the next rests
    return table.rows.select(*DIMENSIONS, "tokens", "probability", *[f"target_{d}" for d in DIMENSIONS])


def largest_keep(cells: DataFrame) -> float:
    """The largest share of tokens that can be kept with every target met and no document repeated."""
    most = calibrate(cells, 1.0, repeat=True).where("tokens > 0").agg(F.max("probability")).first()[0]
    return min(1.0, 1.0 / most) if most else 1.0


def marginals(calibrated: DataFrame) -> DataFrame:
    """(dimension, value, target, expected): wanted and expected share of the kept tokens of every category."""
    kept = calibrated.withColumn("kept", F.col("tokens") * F.col("probability"))
    total = kept.agg(F.sum("kept").alias("all"))
    each = [
        kept.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.max(f"target_{d}").alias("target"), F.sum("kept").alias("kept"))
        for d in DIMENSIONS
    ]
    share = F.col("kept") / F.when(total.scalar() > 0, total.scalar())
    return reduce(DataFrame.unionByName, each).select("dimension", "value", "target", F.coalesce(share, F.lit(0.0)).alias("expected"))


def cell_table(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, documents): one row per cell, summed where the documents are read."""
    path = scratch_path(docs.sparkSession, "tokens")
    _celled(docs).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def mix(docs: DataFrame, wanted: dict[str, dict[str, float]] | None = None, keep: float = KEEP, tolerance: float = TOLERANCE, repeat: bool = False) -> DataFrame:
    """All documents with their cell's probability: row, source, lang, topic, tokens, weight, probability, sampled, copies.

    `keep` is the share of all tokens to keep. With `repeat`, `copies` may exceed 1.
    """
    cells = cell_table(docs)
    raked = calibrate(targeted(cells, wanted), keep, tolerance, repeat).select(*DIMENSIONS, "probability")
    draw = F.pmod(F.xxhash64("_id_hash", F.when(F.col("row.doc_id").isNull(), F.col("row.text"))), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor("probability")
    copies = (whole + F.when(draw < F.col("probability") - whole, 1).otherwise(0)).cast("int")
    rows = _celled(docs).join(raked, list(DIMENSIONS)).withColumn("copies", copies)
    return rows.select("row", *DIMENSIONS, "tokens", (F.col("probability") / keep).alias("weight"), "probability", (F.col("copies") > 0).alias("sampled"), "copies")


def sample(docs: DataFrame, wanted: dict[str, dict[str, float]] | None = None, keep: float = KEEP, repeat: bool = False) -> DataFrame:
    """The documents drawn, with the columns of `docs`."""
    drawn = mix(docs, wanted, keep, repeat=repeat).where("sampled")
    if repeat:
        drawn = drawn.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"))
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
