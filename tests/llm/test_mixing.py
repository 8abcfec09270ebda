"""Calibrated mixing against an independent raking with numpy, and drawn samples against their probabilities."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from granary.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, topic string, weight double, row int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        source = ["web", "web", "book", "code", None][rng.integers(5)] if i % 3 else "web"  # a hot source
        lang = ["en", "en", "de", None][rng.integers(4)]
        n = int(rng.integers(1, 9)) if source == "code" else int(rng.integers(5, 400))
        text = "\n".join(" ".join(["word"] * min(n, 6)) for _ in range(max(n // 6, 1))) if source == "code" else " ".join(["word"] * n)
        rows.append((i, text, lang, source, "mine", 1.0, i))
    rows += [(None, f"no id {i} " * 5, "en", "web", None, None, None) for i in range(200)] + [rows[5]] * 3 + [(9000, None, "en", "web", None, None, None), (9001, "", None, None, None, None, None)]
    rows.append((9002, "long " * 30_000, "en", "book", None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def cells(docs):
    return mixing.cell_table(docs)


def _brute(rows, targets, keep):
    """Free cells raked to the rest, cells above 1 fixed, again until none is left."""
    keys = [tuple(r[d] for d in mixing.DIMENSIONS) for r in rows]
    tokens = np.array([float(r["tokens"]) for r in rows])
    p, fixed = np.full(len(rows), keep), np.zeros(len(rows), bool)
    at = [defaultdict(list) for _ in mixing.DIMENSIONS]
    for i, k in enumerate(keys):
        for d in range(3):
            at[d][k[d]].append(i)
    total = tokens.sum()
    while True:
        goal = []
        for d in range(3):
            goal.append({})
            for value, members in at[d].items():
                m = np.array(members)
                rest = max(targets[d][value] * total * keep - (tokens[m] * p[m])[fixed[m]].sum(), 0.0)
                goal[d][value] = rest if tokens[m][~fixed[m]].sum() > 0 else 0.0
        least = min(sum(g.values()) for g in goal)
        for _ in range(3000):
            for d in range(3):
                whole = sum(goal[d].values())
                for value, members in at[d].items():
                    m = np.array([i for i in members if not fixed[i]], int)
                    now = (tokens[m] * p[m]).sum()
                    if now > 0:
                        p[m] *= goal[d][value] * (least / whole if whole else 0) / now
        over = ~fixed & (p > 1)
        if not over.any():
            return {k: x for k, x in zip(keys, p)}
        p[over], fixed = 1.0, fixed | over


def _targets(cells, wanted):
    rows = mixing.targeted(cells, wanted).collect()
    found = [{r[d]: r[f"target_{d}"] for r in rows} for d in mixing.DIMENSIONS]
    assert all(sum(f.values()) == pytest.approx(1) for f in found)
    for d, given in (wanted or {}).items():
        assert all(found[mixing.DIMENSIONS.index(d)][k] == pytest.approx(v) for k, v in given.items())
    return found


@pytest.mark.parametrize("wanted", [None, {"lang": {"de": 0.6, "en": 0.3, "(none)": 0.1}}])
def test_probabilities_equal_brute_force(cells, wanted):
    got = {tuple(r[d] for d in mixing.DIMENSIONS): r.probability for r in mixing.calibrate(mixing.targeted(cells, wanted), 0.5, tolerance=1e-5).collect()}
    want = _brute(cells.collect(), _targets(cells, wanted), 0.5)
    assert set(got) == set(want) and max(got.values()) <= 1
    tokens = {tuple(r[d] for d in mixing.DIMENSIONS): r.tokens for r in cells.collect()}
    assert {k: v for k, v in got.items() if tokens[k]} == pytest.approx({k: v for k, v in want.items() if tokens[k]}, rel=5e-3, abs=5e-3)


def test_marginals_reach_every_reachable_target(cells):
    wanted = {"lang": {"de": 0.6, "en": 0.3, "(none)": 0.1}}
    goals = mixing.targeted(cells, wanted)
    keep = 0.9 * mixing.largest_keep(goals)
    for keep, repeat in ((keep, False), (0.5, True)):
        for r in mixing.marginals(mixing.calibrate(goals, keep, repeat=repeat)).collect():
            assert r.expected == pytest.approx(r.target, rel=0.01, abs=1e-6), r
    capped = mixing.calibrate(goals, 0.5)
    assert capped.where("probability > 1").isEmpty() and not capped.where("probability = 1").isEmpty()


def test_samples_follow_their_probabilities(docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(r.copies == r.sampled for r in out)
    drawn, expected = Counter(), Counter()
    for r in out:
        drawn[r.source] += r.sampled
        expected[r.source] += r.probability
    assert all(abs(drawn[s] - expected[s]) < 4 * max(expected[s], 1) ** 0.5 for s in expected)
    twice = mixing.mix(docs, {"lang": {"de": 0.8, "en": 0.1, "(none)": 0.1}}, repeat=True).collect()
    assert max(r.copies for r in twice) > 1
    assert all(int(r.probability) <= r.copies <= int(r.probability) + 1 for r in twice)


def test_samples_do_not_depend_on_partitions_and_keep_columns(docs):
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, mixing.sample(docs.repartition(5)).collect()))
    none = docs.where("false")
    assert mixing.mix(none).collect() == [] and mixing.sample(none).columns == docs.columns


def test_whole_query_reaches_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    cells = mixing.cell_table(docs)
    goals = mixing.targeted(cells)
    keep = min(0.5, mixing.largest_keep(goals))
    for r in mixing.marginals(mixing.calibrate(goals, keep)).collect():
        assert r.expected == pytest.approx(r.target, rel=0.01, abs=1e-6)
