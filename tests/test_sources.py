"""Readers and normalizers on landed payloads, merges, exports, ledgers and models on small fixtures."""

import hashlib
import json
import random
import zipfile

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import ledger, metrics, models, rollups
from tidemark.sources import market
from tidemark.spec import MINUTE, Series

S = Series()
KEYS = {"venue": "x", "instrument": "a"}
T0 = 1_700_000_040_000 - 1_700_000_040_000 % MINUTE


def kline(i, close="1.5"):
    return [T0 + i * MINUTE, "1", "2", "0.5", close, "10", "ignored"]


def test_kline_pages(spark):
    pages = spark.createDataFrame([(json.dumps([kline(0), kline(1)]),), (json.dumps([kline(1, "1.7"), kline(9)]),)], "p string").coalesce(1)
    rows = market.kline_pages(pages, "p", KEYS, S, T0, T0 + 5 * MINUTE).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.close) for r in rows] == [(T0, 1.5), (T0 + MINUTE, 1.7)] and rows[0].funding_rate is None


def test_csv_and_zip(spark, tmp_path):
    text = "open_time,open,high,low,close,volume,x\n" + "\n".join(",".join(map(str, kline(i))) for i in range(3))
    (tmp_path / "k.csv").write_text(text)
    assert market.kline_csv(spark, str(tmp_path / "k.csv"), KEYS, S).count() == 3
    with zipfile.ZipFile(tmp_path / "k.zip", "w") as z:
        z.writestr("k.csv", text)
    assert market.zip_lines(spark, str(tmp_path / "k.zip")).count() == 4


def test_funding_interest_and_bars(spark):
    pages = spark.createDataFrame([(json.dumps([{"fundingTime": T0, "fundingRate": "0.0001"}, {"fundingTime": str(T0), "fundingRate": "0.0002"}, {"fundingTime": T0 + 2 * MINUTE, "fundingRate": ""}]),)], "p string")
    funding = market.funding_events(pages, "p", KEYS, S)
    assert [(r.ts_ms, r.funding_rate) for r in funding.collect()] == [(T0, 0.0002)]
    interest = market.interest_events(spark.createDataFrame([("2023-11-14 22:14:00", "5"), (None, "6")], "create_time string, sum_open_interest string"), KEYS, S)
    assert interest.count() == 1
    make = lambda closes: spark.createDataFrame([("x", "a", T0 + i * MINUTE, 1.0, 2.0, 0.5, c, 1.0) for i, c in closes], "venue string, instrument string, ts_ms long, open double, high double, low double, close double, volume double")
    got = {r.ts_ms: (r.close, r.funding_rate) for r in market.build_bars(make([(0, 1.0), (1, 1.1)]), make([(1, 9.0), (2, 1.2)]), funding, interest, S).collect()}
    assert got == {T0: (1.0, 0.0002), T0 + MINUTE: (1.1, 0.0002), T0 + 2 * MINUTE: (1.2, 0.0002)}


def test_range_replace_is_idempotent(spark):
    make = lambda rows: spark.createDataFrame([("x", "a", T0 + i * MINUTE, c) for i, c in rows], "venue string, instrument string, ts_ms long, close double")
    old, new = make([(i, 1.0) for i in range(6)]), make([(2, 2.0), (9, 2.0)])
    once = market.replace_range(old, new, S, T0 + 2 * MINUTE, T0 + 4 * MINUTE)
    twice = market.replace_range(once, new, S, T0 + 2 * MINUTE, T0 + 4 * MINUTE)
    key = lambda df: sorted((r.ts_ms, r.close) for r in df.collect())
    assert key(once) == key(twice) and len(key(once)) == 5
    assert (T0 + 2 * MINUTE, 2.0) in key(market.merge_bars(old, new, S))


def test_partitioned_store(spark, tmp_path):
    rows = [("x", "a", i, T0 + i * 43_200_000, 1.0, 2.0, 2.0, True) for i in range(6)]
    market.write_partitioned(spark.createDataFrame(rows, market.TRADES), str(tmp_path / "t"))
    market.write_partitioned(spark.createDataFrame(rows[:1], market.TRADES), str(tmp_path / "t"))
    df = market.read_trades(spark, str(tmp_path / "t"), "2023-11-15", "2023-11-17")
    assert df.count() == 4 and "PartitionFilters: [isnotnull(trade_date" in df._jdf.queryExecution().toString()


def test_stored_range(spark, tmp_path):
    """Only the days of a range are read or written; days without fresh rows go, edges of days stay."""
    path = str(tmp_path / "s")
    day = 86_400_000
    start = T0 - T0 % day
    rows = [("x", "a", start + k * day // 4, float(k)) for k in range(24)]
    schema = "venue string, instrument string, ts_ms long, close double"
    market.write_partitioned(spark.createDataFrame(rows, schema), path)
    fresh = spark.createDataFrame([("x", "a", start + day + day // 2 + 5, 100.0), ("x", "a", start, -1.0)], schema)
    lo, hi = start + day + day // 4 + 1, start + 4 * day + 1
    for _ in range(2):
        market.replace_stored_range(spark, path, fresh, lo, hi)
    want = sorted([r[2:] for r in rows if not lo <= r[2] < hi] + [(start + day + day // 2 + 5, 100.0)])
    assert sorted((r.ts_ms, r.close) for r in market.read_bars(spark, path, schema=schema).collect()) == want
    assert not any(p.name.endswith(d) for p in (tmp_path / "s").iterdir() for d in ("2023-11-16", "2023-11-17"))
    part = market.read_bars(spark, path, start + day, start + 2 * day, schema)
    assert part.count() == 3 and "PartitionFilters: [isnotnull(trade_date" in part._jdf.queryExecution().toString()


def test_prediction_markets(spark):
    a = json.dumps({"id": "m", "question": "Will Bitcoin rise?", "outcomePrices": '["0.4", "0.6"]', "clobTokenIds": '["t1"]', "bestBid": "0.39", "bestAsk": "0.41", "volume": "10", "liquidity": "null", "bids": [{"price": "0.39", "size": "5"}] * 12})
    b = json.dumps({"ticker": "k", "title": "Other", "yes_bid": "30", "yes_ask": "40", "last_price": "33", "volume": "7", "notional_value": "100", "close_time": "2024-01-01T00:00:00Z"})
    make = lambda *p: spark.createDataFrame([(x, T0 + i) for i, x in enumerate(p)], "payload string, fetched_ms long")
    good, bad = market.snapshot_table(market.snapshot_a(make(a, "{}", a)), market.snapshot_b(make(b)))
    rows = {r.market_id: r for r in good.collect()}
    assert set(rows) == {"m", "k"} and bad.count() == 1
    assert rows["m"].yes_price == 0.4 and rows["m"].bid_depth == 50.0 and rows["m"].liquidity is None and rows["m"].ts_ms == T0 + 2
    assert abs(rows["k"].yes_price - 0.35) < 1e-12 and rows["k"].volume == 7.0 and rows["k"].end_ms == 1_704_067_200_000
    assert rollups.probability_sentiment(good).first().n == 1
    history = spark.createDataFrame([("a", "m", "1700000000", "0.5", None, 0), ("a", "m", "1700000000000", "0.6", "0.7", 1)], "platform string, market_id string, t string, price string, high string, arrival long").withColumns({"close": F.lit(None).cast("string"), "open": F.lit(None).cast("string"), "low": F.lit(None).cast("string")})
    r = market.probability_bars(history).collect()
    assert len(r) == 1 and (r[0].open, r[0].high, r[0].close) == (0.6, 0.7, 0.6)


def test_scalars(spark):
    df = spark.createDataFrame([("1.5", "2023-11-14T22:13:20Z"), ("", "1700000000"), ("0x", "1700000000000"), ("abc", None)], "a string, t string")
    rows = df.select(scalars.fixed_point("a").alias("a"), scalars.to_epoch_ms("t").alias("t")).collect()
    assert [r.a for r in rows] == [1.5, None, None, None] and [r.t for r in rows] == [1_700_000_000_000] * 3 + [None]
    p = spark.createDataFrame([(0.0,), (1.959964,), (None,)], "t double").select(scalars.two_sided_p("t").alias("p")).collect()
    assert p[0].p == 1.0 and abs(p[1].p - 0.05) < 1e-6 and p[2].p is None


def test_log_checks(spark):
    def record(i, **more):
        body = {"seq": i, "type": "record", "ts_ms": 10 * i, "decision_ts_ms": 1, "exec_ts_ms": 2, "action": "HOLD", "fill": None, "pos": {"side": 0, "size": 0.0}} | more
        body["entry_hash"] = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        return json.dumps(body)

    lines = [(0, json.dumps({"seq": 0, "type": "header"})), (1, record(1)), (2, record(2, ts_ms=5)), (3, record(3, action="ENTER")), (4, record(4).replace("HOLD", "EXIT")), (5, "no json"), (6, json.dumps({"seq": 6, "type": "footer", "records": 4}))]
    rec = ledger.parse_log(spark.createDataFrame(lines, "seq long, line string"))
    codes = {(r.seq, r.code) for r in ledger.log_violations(rec).collect()}
    assert codes == {(2, "TIME_NOT_INCREASING"), (3, "ACTION_WITHOUT_FILL"), (4, "ACTION_WITHOUT_FILL"), (4, "EXIT_WHILE_FLAT"), (5, "BAD_JSON")}
    assert [r.seq for r in ledger.hash_violations(rec).collect()] == [4]
    assert ledger.completeness(rec).first().complete


def test_chain(spark):
    lines, previous = [], ""
    for i in range(8):
        body = f'{{"kind":"decision","n":{i},"previous_hash":"{previous}"}}'
        h = hashlib.sha256((previous + body).encode()).hexdigest()
        lines.append((i, body[:-1] + f',"record_hash":"{h}"}}'))
        previous = h
    df = lambda rows: spark.createDataFrame(rows, "seq long, line string")
    assert ledger.chain_violations(df(lines)).count() == 0
    edited = [*lines]
    edited[3] = (3, lines[3][1].replace('"n":3', '"n":4'))
    assert [(r.seq, r.code) for r in ledger.chain_violations(df(edited)).collect()] == [(3, "HASH")]
    missing = [(i if i < 5 else i - 1, x) for i, x in lines if i != 5]
    assert (5, "LINK") in [(r.seq, r.code) for r in ledger.chain_violations(df(missing)).collect()]
    assert ledger.inspect(df(edited)).first().violations == 1


def test_reconstruction(spark):
    rows = [("d1", "decision", 10, None, None, "s", None), ("f1", "fill", 11, "d1", None, None, None), ("f2", "fill", 9, "zz", None, None, None), ("t1", "trade", 12, None, ["f1"], None, 2.5), ("t2", "trade", 12, None, ["nope"], None, 1.0)]
    df = spark.createDataFrame(rows, "record_id string, kind string, ts_ms long, decision_id string, fill_ids array<string>, strategy string, pnl double")
    assert {(r.record_id, r.code) for r in ledger.foreign_key_violations(df).collect()} == {("f2", "FILL_WITHOUT_DECISION"), ("t2", "TRADE_WITHOUT_FILL")}
    r = ledger.reconstruct(df).first()
    assert (r.decision_id, r.n_trades, r.trade_pnl, r.in_order) == ("d1", 1, 2.5, True)


def test_models_and_folds(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append(("x", "a", T0 + i * MINUTE, x, z, 2 * x - z + rng.gauss(0, 0.1), int(x + z > 0), rng.randint(0, 1)))
    df = spark.createDataFrame(rows, "venue string, instrument string, ts_ms long, f1 double, f2 double, y double, up int, cls int")
    split = metrics.purged_split(df, S, T0 + 400 * MINUTE, T0 + 400 * MINUTE, 10)
    assert not metrics.split_leaks(split, S, 10).first().leak
    assert not split.where("split = 'train'").where(F.col("ts_ms") >= T0 + 390 * MINUTE).count()
    folds = metrics.walk_forward(df, S, [("one", T0, T0 + 300 * MINUTE, T0 + 450 * MINUTE), ("two", T0, T0 + 450 * MINUTE, T0 + 600 * MINUTE)], 10)
    out = {r.fold: r for r in models.fold_benchmark(folds, ["f1", "f2"], "y").collect()}
    assert set(out) == {"one", "two"} and all(r.ic > 0.9 and r.n == 150 for r in out.values())
    scored = models.fold_benchmark(folds, ["f1", "f2"], "up", classifier=True).collect()
    assert all(r.auc > 0.95 for r in scored)
    three = models.fit_classes(df, ["f1", "f2"], "cls")
    p = models.score(three, df, ["f1", "f2"]).select("probabilities").first()[0]
    assert len(p) == 3 and abs(sum(p) - 1) < 1e-9
    ensemble = models.fit_ensemble(df, ["f1", "f2"], "y", (1, 2))
    assert models.score_ensemble(ensemble, df, ["f1", "f2"]).where("uncertainty is null").count() == 0


def test_exports(spark):
    out = market.backtest_columns(spark.createDataFrame([(T0, 1.0, None)], "ts_ms long, open double, close double")).first()
    assert (out.Open, out.Close, out.Volume, out.Timestamp) == (1.0, 0.0, 0.0, T0)
    raw = spark.createDataFrame([("1", "2.5", "4", str(T0), "true")], "a string, p string, q string, T string, m string")
    r = market.normalize_trades(raw, KEYS).first()
    assert (r.trade_id, r.notional, r.ts_ms, r.is_buyer_maker) == (1, 10.0, T0, True)
    assert [(r.year, r.month) for r in market.months(spark, 1_701_000_000_000, 1_704_067_200_000).collect()] == [(2023, 11), (2023, 12)]


def test_linear_fits_of_groups(spark):
    """Weights against NumPy, group by group and head by head, with gaps, and the fallback of timeouts."""
    import numpy as np

    r = np.random.default_rng(2)
    rows = []
    for fold, n in (("a", 200), ("b", 40), (None, 30), ("alone", 1)):
        for _ in range(n):
            x = r.normal(3, 2, 2)
            rows.append((fold, float(x[0]), float(x[1]), float(x @ [0.5, -1] + r.normal()), float(r.normal()) if r.random() < 0.7 else None, "TIMEOUT" if r.random() < 0.5 else "TP"))
    rows += [("a", None, 1.0, 1.0, 1.0, "TP"), ("a", float("nan"), 1.0, 1.0, 1.0, "TIMEOUT"), ("empty", None, None, 1.0, 1.0, "TP")]
    df = spark.createDataFrame(rows, "fold string, x0 double, x1 double, y double, z double, outcome string").repartition(5)
    fits = models.linear_fits(df, ["fold"], ["x0", "x1"], ["y", "z"])
    got = {(f.fold, f["head"]): f for f in fits.collect()}
    for fold in ("a", "b", None, "alone"):
        for k, head in ((3, "y"), (4, "z")):
            own = np.array([(t[1], t[2], t[k]) for t in rows if t[0] == fold and t[k] is not None and t[1] is not None and np.isfinite(t[1])], float).reshape(-1, 3)
            if not len(own):
                assert (fold, head) not in got
                continue
            x, y = own[:, :2] - own[:, :2].mean(0), own[:, 2] - own[:, 2].mean()
            w = np.linalg.solve(x.T @ x + np.eye(2), x.T @ y)
            f = got[fold, head]
            assert f.n == len(own) and np.allclose(f.weights, w) and np.isclose(f.intercept, own[:, 2].mean() - w @ own[:, :2].mean(0))
    assert not any(k[0] == "empty" for k in got)
    scored = models.linear_scores(df.where("fold in ('a', 'empty')"), fits, ["fold"], ["x0", "x1"]).collect()
    assert len(scored) == 200 and all(abs(t.pred_y - (got["a", "y"].intercept + t.x0 * got["a", "y"].weights[0] + t.x1 * got["a", "y"].weights[1])) < 1e-9 for t in scored)
    timeouts = {f.fold: f for f in models.timeout_fits(df.where("fold in ('a', 'b')"), ["fold"], ["x0", "x1"], "y", least=60).collect()}
    assert list(timeouts["b"].weights) == [0.0, 0.0] and any(timeouts["a"].weights)
    mean = np.mean([t[3] for t in rows if t[0] == "b" and t[5] == "TIMEOUT"])
    assert np.isclose(timeouts["b"].intercept, mean)
