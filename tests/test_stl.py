"""Loess decomposition: exact cases, additivity, and the tags of the fixture series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import scalars as S
from granary.models import stl
from granary.operators import aggregates as A
from tests.test_models import INT, ST, T1, panel


def test_line_plus_fixed_season_leaves_no_residual():
    t = np.arange(140)
    season = np.tile([3.0, -1.0, 0.0, 2.0, -4.0, 1.0, -1.0], 20)
    trend, got, rest = stl.decompose(5 + 0.3 * t + season, 7)
    assert np.abs(rest).max() < 0.05 and np.abs(got - season).max() < 0.05
    assert np.abs(trend - (5 + 0.3 * t)).max() < 0.05


@pytest.mark.parametrize("n", [14, 15, 29, 100])
def test_parts_add_up(n):
    y = np.random.default_rng(n).normal(0, 1, n)
    assert np.allclose(sum(stl.decompose(y, 7)), y)


def test_noise_is_not_all_season():
    y = np.random.default_rng(0).normal(0, 1, 2000)
    assert 0.2 < stl.strength(y) < 0.6


def test_a_local_line_is_reproduced():
    y = 2.0 + 3.0 * np.arange(40)
    assert np.allclose(stl._loess(y, 9), y)
    assert np.allclose(stl._loess(y, 9, extend=True), 2.0 + 3.0 * np.arange(-1, 41))


def test_fixture_tags(spark):
    df = panel(spark, T1=T1, INT=INT, ST=ST)
    features = A.demand_features(df).drop("seasonality_strength")
    tagged = features.join(stl.seasonal_strength(df), ["item_id", "location_id"]).withColumn("tag", S.model_tag())
    assert {r.item_id: r.tag for r in tagged.collect()} == {"T1": "xgboost", "INT": "tbats", "ST": "arima"}


def test_short_series_have_none(spark):
    assert stl.seasonal_strength(panel(spark, a=[1, 2, 3])).agg(F.max("seasonality_strength")).first()[0] == 0.0
