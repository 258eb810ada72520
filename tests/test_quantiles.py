"""Exact quantiles against NumPy, with ranges so small that every group is narrowed several times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans.quantiles import exact_quantiles, with_quantiles


def tables():
    r = np.random.default_rng(8)
    yield "plain", r.normal(0, 1, 3000)
    yield "outlier", np.append(r.normal(0, 1e-3, 3000), [1e300, -1e300])
    yield "geometric", np.array([1.5**k for k in range(-900, 900)])
    yield "ties", np.repeat([1.0, 2.0, 2.5], [2900, 60, 40])
    yield "one value", np.full(500, 7.0)
    yield "few", np.array([3.0, 1.0])
    yield "single", np.array([-4.0])
    yield None, r.integers(0, 50, 2000).astype(float)  # a null key is a group


@pytest.mark.parametrize("small", [1_000_000, 40])
def test_quantiles_are_those_of_numpy(spark, small):
    rows = [(k, float(v), 2 * float(v)) for k, values in tables() for v in values]
    rows += [("nothing", None, None), ("plain", None, 1.0), ("few", 2.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    points = {"low": ("x", 0.0), "q1": ("x", 1 / 3), "mid": ("x", 0.5), "q9": ("x", 0.9), "top": ("x", 1.0), "mid_y": ("y", 0.5)}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], {"x": F.col("x"), "y": F.col("y")}, points, small).collect()}
    by = {}
    for k, x, y in rows:
        own = by.setdefault(k, ([], []))
        for held, v in zip(own, (x, y), strict=True):
            if v is not None:
                held.append(v)
    assert set(got) == set(by) - {"nothing"}
    for k, r in got.items():
        for out, (name, q) in points.items():
            assert r[out] == pytest.approx(np.quantile(by[k]["xy".index(name)], q), rel=1e-12, abs=1e-300), (k, out)


def test_groups_without_values_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 5.0)], "k string, v double")
    out = with_quantiles(df.groupBy("k").agg(F.count("*").alias("n")), df, ["k"], {"v": F.col("v")}, {"m": ("v", 0.5)})
    assert {(r.k, r.n, r.m) for r in out.collect()} == {("a", 2, 1.5), ("b", 1, None), (None, 1, 5.0)}
    whole = with_quantiles(df.agg(F.count("*").alias("n")), df, [], {"v": F.col("v")}, {"m": ("v", 0.5)})
    assert [tuple(r) for r in whole.collect()] == [(4, 2.0)]
    empty = df.where("false")
    assert [tuple(r) for r in with_quantiles(empty.agg(F.count("*").alias("n")), empty, [], {"v": F.col("v")}, {"m": ("v", 0.5)}).collect()] == [(0, None)]


def test_no_group_is_sorted_whole(spark):
    """Narrowed ranges hold few values whatever the group holds."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    out = exact_quantiles(df, ["k"], {"v": F.col("v")}, {"m": ("v", 0.5)}, small=200)
    want = float(np.median([i * 7919 % 20_011 for i in range(20_000)]))
    assert out.first().m == want
    assert "percentile(" not in out._jdf.queryExecution().toString()
