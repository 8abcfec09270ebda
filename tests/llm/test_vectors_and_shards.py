"""Whitening, hard negatives and sharding against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import negatives, sharding, whitening
from granary.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, row string, x long"


def _usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def _ints(v, dims):
    return [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 20))
    out = [(i, (base[i % 8] + rng.normal(size=20) * 0.7).tolist(), int(i % 8 // 2), f"r{i}", i) for i in range(900)]
    hot = base[0].tolist()
    out += [(1000 + i, hot, 1, None, None) for i in range(450)]  # one vector holds a third
    out += [(2000, None, 1, "a", 1), (2001, [], 2, "b", 2), (2002, hot[:7], 3, "c", 3), (2003, [None] * 20, 1, "d", 4), (2100, [float("nan")] * 20, 1, "e", 5)]
    out += [(2200, [float("inf")] + hot[1:], 1, "f", 6), (None, hot, 2, "g", 7), (None, base[1].tolist(), None, "h", 8), (2300, base[2].tolist(), None, "i", 9)]
    return out + [out[100], out[700]]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- whitening ------------------------------------------------------------------------------------------------------


def _check_whitening(out, sound, dims):
    """`sound`: (key, vector) of the usable rows; `out`: (key, component, n, deviation, whitened, explained, error)."""
    x = [_ints(v, dims) for _, v in sound]
    fit = np.array(sorted({tuple(v) for v in x}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    around = fit - sums / n
    v = around.T @ around / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    want = Counter((k, c + 1, n, int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)))) for (k, _), r in zip(sound, x) for c in range(min(4, dims)))
    assert Counter((r[0], r[1], r[2], r[3]) for r in out) == want
    by_key = defaultdict(dict)
    for k, c, _, _, w, e, error in out:
        by_key[k].setdefault(c, []).append(w)
        assert abs(e / (values[c - 1] / np.trace(v)) - 1) < 1e-10 and error < 1e-10
    unique = {k: r for (k, _), r in zip(sound, x)}
    for c in range(1, 5):
        keys = [k for k in unique if k is not None and len(by_key[k][c]) == 1]
        got = np.array([by_key[k][c][0] for k in keys])
        there = (np.array([unique[k] for k in keys]) - sums / n) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(got - there).max(), np.abs(got + there).max()) < 1e-8


def test_whitening(vectors, rows, none):
    out = [(r.row.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(vectors).collect()]
    _check_whitening(out, [(r[0], r[1]) for r in rows if _usable(r[1])], 20)
    kept = whitening.whiten(vectors).select("row.*", "component").where("vec_id = 5 and component = 1").first()
    assert (kept["row"], kept["x"], kept.label) == ("r5", 5, 2)
    assert whitening.whiten(none).collect() == [] and whitening.whiten(none).columns == whitening.whiten(vectors).columns
    assert whitening.whiten(vectors.where("vec_id = 2001")).collect() == []


def test_whitening_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    out = [tuple(r) for r in QUERIES["op11_whitening"](spark, sf_dir).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()]
    _check_whitening(out, [(r.vec_id, r.embedding) for r in rows if _usable(r.embedding)], 64)


def test_whitening_does_not_depend_on_partitions(vectors):
    result = lambda df: sorted(map(str, whitening.whiten(df).select("row.vec_id", "component", "deviation", "whitened").collect()))
    assert result(vectors.repartition(13)) == result(vectors.coalesce(1))


def test_whitening_without_variance_and_with_large_entries(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(9)], "vec_id long, embedding array<double>")
    out = whitening.whiten(same).collect()
    assert len(out) == 18 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in out)
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    out = whitening.whiten(flat).collect()
    assert {r.component for r in out if r.whitened is not None} == {1} and {round(r.explained, 9) for r in out} == {1.0, 0.0}
    vast = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [1e12, 3.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(vast).collect()] == [None] * 6


@pytest.mark.parametrize("gap", [0.0, 1e-13, 1e-9, 1e-6, 1e-3])
def test_eigenvectors_with_clusters(gap):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (3 * np.eye(30, dtype=q.dtype) - q.T @ q) / 2
    values = np.array([9 + i * gap for i in range(4)] + [5, 5 + gap] + list(range(-24, 0)), np.longdouble)
    a = (q * values) @ q.T
    found, x = whitening.eigenvectors((a + a.T) / 2)
    assert np.abs(np.sort(values)[::-1] - found).max() < 1e-15 * 30
    assert np.abs(x.T @ x - np.eye(30)).max() < 1e-16 * 30
    assert np.abs(a @ x - x * found).max() < 1e-15 * 30
    if gap >= 1e-9:  # vectors are defined to about eps / gap
        order = np.argsort(-values)
        assert np.abs(np.abs((q[:, order] * x).sum(axis=0)) - 1).max() < 1e-14


def test_refinement_doubles_the_digits():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 12))
    a = (a + a.T).astype(np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    moves = []
    for _ in range(4):
        x, _, _, moved = whitening.refine_step(a, x)
        moves.append(moved)
    assert moves[0] > 1e-9 and moves[1] < 1e-9 and moves[2] < 1e-15


# --- hard negatives -------------------------------------------------------------------------------------------------


def _brute_negatives(rows, is_anchor, dims):
    sound = [(r[0], r[2], np.array(_ints(r[1], dims), object)) for r in rows if r[2] is not None and _usable(r[1])]
    last = lambda i: (i is None, i or 0)
    out = Counter()
    for a, (anchor, label, q) in enumerate(sound):
        if anchor is None or not is_anchor(anchor):
            continue
        seen = [(int(q @ x), i, own) for b, (i, own, x) in enumerate(sound) if b != a]
        near = sorted([s for s in seen if s[2] == label], key=lambda s: (-s[0], last(s[1])))[:5]
        others = sorted([s for s in seen if s[2] != label], key=lambda s: (-s[0], last(s[1])))
        for score, positive, _ in near:
            inside = [s for s in others if 30 * score <= 100 * s[0] <= 90 * score][:10]
            out.update((anchor, positive, k + 1, s[1], score, s[0]) for k, s in enumerate(inside))
    return out


def _rows(df):
    return Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives(vectors, rows, none, monkeypatch):
    want = _brute_negatives(rows, lambda i: i % 50 == 0, 20)
    anchor = F.col("vec_id") % 50 == 0
    assert len(want) > 300 and _rows(negatives.mine(vectors, anchor)) == want
    monkeypatch.setattr(negatives, "BLOCK", 97)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    assert _rows(negatives.mine(vectors.repartition(7), anchor)) == want
    assert negatives.mine(none, anchor).collect() == []
    assert negatives.mine(vectors, F.lit(False)).collect() == []


def test_negatives_of_wide_and_negative_vectors(spark):
    rng = np.random.default_rng(8)
    many = [(i, (rng.normal(size=130) - 0.2 * (i % 3)).tolist(), i % 4, None, None) for i in range(300)]
    many += [(300 + i, [-v for v in many[i][1]], 9, None, None) for i in range(6)] + [(400, [0.0] * 130, 1, None, None), (500, [0.0] * 130, 1, None, None)]
    df = spark.createDataFrame(many, SCHEMA)
    assert _rows(negatives.mine(df, F.col("vec_id") % 20 == 0)) == _brute_negatives(many, lambda i: i % 20 == 0, 130)


def test_intervals_hold_and_narrow():
    rng = np.random.default_rng(4)
    x = rng.integers(-90, 90, size=(400, 64))
    x[:50] //= 40
    x[50] = 0
    turns = negatives.rotations(64)
    codes, along, left = negatives.encode(x.astype(float), turns)
    block = {"ids": np.arange(400), "codes": codes, "along": along, "left": left}
    rows, widths = np.arange(400), []
    for q in (x[3], x[60], x[399], np.zeros(64, np.int64)):
        bounds, exact = negatives.Intervals(q, block, turns), x @ q
        widths.append([])
        for _ in turns:
            least, most = bounds.narrow(rows)
            assert (least <= exact).all() and (exact <= most).all()
            widths[-1].append((most - least)[60:].mean())
    assert all(b < 0.75 * a for w in widths[:3] for a, b in zip(w, w[1:]))


def test_anchors_are_shuffled_to_the_blocks_and_not_broadcast(vectors, monkeypatch):
    """However small the plan believes packed anchors to be, the driver never holds them once a block."""
    mined = lambda: negatives.mine(vectors.drop("row"), F.col("vec_id") % 100 == 0)
    whole = Counter(map(tuple, mined().collect()))
    for name, value in {"BLOCK": 100, "ANCHORS": 4, "SHARES": 3}.items():
        monkeypatch.setattr(negatives, name, value, raising=False)
    out = mined()
    assert Counter(map(tuple, out.collect())) == whole
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and not re.search(r"Broadcast\w*Join \[(part|share)#", plan)


# --- sharding -------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, shard string, slot double, row_number int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i % 90} é", "a", float(i), i) for i in range(700)]
    rows += [(None, f"no id {i}", None, None, None) for i in range(400)] + [(7, "copy", "z", 1.0, 1)] * 500
    rows += [(800, None, "a", None, None), (801, "", "b", None, None), (802, "long " * 50_000, "c", None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(9)


def test_sharding(spark, docs):
    rows, given = sharding.place(docs, 40).collect(), docs.collect()
    n = len(given)
    assert Counter(map(str, (r.row for r in rows))) == Counter(map(str, given))
    assert sorted(r.place for r in rows) == list(range(n)) == sorted(r.row_number for r in rows)
    slots = defaultdict(list)
    for r in rows:
        b = (r.row.text or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 16, zlib.crc32(b))
        slots[r.shard].append(r.slot)
    sizes = {len(s) for s in slots.values()}
    assert set(slots) == set(range(40)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ids = [(r.row.doc_id is not None, r.row.doc_id or 0) for r in sorted(rows, key=lambda r: r.row_number)]
    assert ids == sorted(ids)
    places = spark.createDataFrame([(r.shard, r.slot, r.row_number) for r in rows], "shard int, slot long, number long")
    back = places.withColumn("found", sharding.row_at(spark, n, F.col("shard"), F.col("slot")))
    assert back.where("found <> number").isEmpty()


def test_sharding_does_not_depend_on_partitions(docs):
    result = lambda df: Counter(map(str, sharding.place(df, 7).collect()))
    assert result(docs.coalesce(1)) == result(docs.repartition(31))


def test_sharding_edges(spark, docs, tmp_path):
    none = docs.where("false")
    assert sharding.place(none).collect() == [] and sharding.place(none).columns == sharding.place(docs).columns
    assert [(r.shard, r.slot) for r in sharding.place(docs.where("doc_id = 3"), 40).collect()] == [(0, 0)]
    sharding.write_shards(sharding.place(docs, 3).select("row.doc_id", "shard", "slot"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 16, 17, 210, 1000, 4097])
def test_permutation(spark, rows):
    feistel = sharding.Feistel(rows, seed=rows)
    steps = feistel.walk_length(spark)
    moved = spark.range(rows).select("id", feistel.place(F.col("id"), steps).alias("p"))
    pairs = moved.withColumn("back", feistel.place(F.col("p"), steps, back=True)).collect()
    assert sorted(r.p for r in pairs) == list(range(rows)) and all(r.back == r.id for r in pairs)


def test_permutation_mixes(spark):
    """Neighbours part: shards of consecutive rows pass a chi-square test, another seed gives another order."""
    feistel = sharding.Feistel(60_000)
    steps = feistel.walk_length(spark)
    p = [r.p for r in spark.range(60_000).select(feistel.place(F.col("id"), steps).alias("p")).collect()]
    pairs = Counter((a % 10, b % 10) for a, b in zip(p, p[1:]))
    chi = sum((pairs[i, j] - 599.99) ** 2 / 599.99 for i in range(10) for j in range(10))
    assert chi < 150  # 99 degrees of freedom: above in 1 of 1000
    first = Counter(x * 10 // 60_000 for x in p[:6000])
    assert sum((first[i] - 600) ** 2 / 600 for i in range(10)) < 28
    other = sharding.Feistel(60_000, seed=1)
    q = [r.p for r in spark.range(100).select(other.place(F.col("id"), other.walk_length(spark)).alias("p")).collect()]
    assert q != p[:100]
