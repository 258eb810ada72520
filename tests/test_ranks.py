"""Rank metrics where a task may scan few scores only: outliers, constant scores and ties, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics


def scores(seed=3):
    r = random.Random(seed)
    out = []
    for i in range(1500):
        key = r.choice(["plain", "constant", "outlier", "ties", None])
        s = {"plain": r.gauss(0, 1), "constant": 0.5, "outlier": r.random() * 1e-6 if r.random() < 0.99 else r.choice([-1e200, 1e200]), "ties": float(r.randrange(4)), None: r.random()}[key]
        out.append((i, key, s, int(r.random() < 0.4), r.gauss(0, 1)))
    return out


def area(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("scan_rows", [10, 1_000_000])
def test_scans_by_range(spark, monkeypatch, scan_rows):
    rows = scores()
    df = spark.createDataFrame(rows, "i long, k string, s double, y int, a double").repartition(4)
    counts = metrics.score_counts(df, "y", "s", ["k"])
    for descending in (True, False):
        got = {(r.k, r.score): (r.cum_pos, r.cum_n) for r in metrics.cumulated(counts, ["k"], descending, scan_rows).collect()}
        for key in {r[1] for r in rows}:
            own = [(s, y) for _, k, s, y, _ in rows if k == key]
            for s in {s for s, _ in own}:
                upto = [y for x, y in own if (x >= s if descending else x <= s)]
                assert got[key, s] == (sum(upto), len(upto))
    monkeypatch.setattr(metrics.cumulated, "__defaults__", (True, scan_rows))
    found = {r.k: r.auc for r in metrics.roc_auc(df, "y", "s", ["k"]).collect()}
    for key in {r[1] for r in rows}:
        assert found[key] == pytest.approx(area([(s, y) for _, k, s, y, _ in rows if k == key]))


@pytest.mark.parametrize("scan_rows", [5, 1_000_000])
@pytest.mark.parametrize("tie", [None, "i"])
def test_tiles_split_ties(spark, scan_rows, tie):
    rows = [(i, r[1], round(r[2], 1) if r[1] == "plain" else r[2], r[3], round(r[4], 1)) for i, r in enumerate(scores(5)) if r[1] in ("plain", "constant", "ties")]
    df = spark.createDataFrame(rows, "i long, k string, s double, y int, a double").repartition(4)
    got = sorted(tuple(r) for r in metrics.quantile_table(df, "s", "a", 7, tie, scan_rows).collect())
    ordered = sorted(rows, key=lambda r: (r[2], *((r[0],) if tie else ()), r[4]))
    size, extra = divmod(len(rows), 7)
    at = 0
    for tile, n, mean_p, mean_a in got:
        want = size + (tile <= extra)
        own = ordered[at : at + want]
        at += want
        assert n == want
        assert mean_p == pytest.approx(sum(r[2] for r in own) / want) and mean_a == pytest.approx(sum(r[4] for r in own) / want)
    assert at == len(rows) and [g[0] for g in got] == list(range(1, 8))


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "p double, a double")
    assert sorted(tuple(r) for r in metrics.quantile_table(df, "p", "a", 5).collect()) == [(1, 1, 1.0, 2.0), (2, 1, 1.0, 4.0)]
    assert metrics.quantile_table(df.where("false"), "p", "a", 5).collect() == []
    assert metrics.cumulated(metrics.score_counts(df.where("false").withColumn("y", F.lit(1)), "y", "p", []), []).collect() == []
