"""Chunks, scans and causality: results do not depend on chunk length, partitions or what comes later."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events, features, labels, payoff, quality
from tidemark.operators.joins import as_of
from tidemark.plans.series import block_scan, ema, framed, trailing, with_row_index
from tidemark.spec import MINUTE, Series

SERIES = Series(chunk=64)
T0 = 1_700_000_000_000 - 1_700_000_000_000 % MINUTE
COLUMNS = "venue string, instrument string, ts_ms long, open double, high double, low double, close double, volume double, funding_rate double, open_interest double"


def walk(n=400, seed=1, instrument="a", start=T0, skip=()):
    rng, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        o, price = price, price * math.exp(rng.gauss(0, 0.002))
        hi, lo = max(o, price) * (1 + abs(rng.gauss(0, 0.0005))), min(o, price) * (1 - abs(rng.gauss(0, 0.0005)))
        if i not in skip:
            rows.append(("x", instrument, start + i * MINUTE, o, hi, lo, price, rng.expovariate(0.1), 0.0001 * (i // 60 % 5), 1000.0 + rng.gauss(0, 5)))
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk() + walk(300, 2, "b", skip={50, 51, 120}), COLUMNS).repartition(5).cache()


def table(df, *names):
    return {(r.instrument, r.ts_ms): tuple(None if r[n] is None else round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_chunk_length_changes_nothing(bars, chunk):
    s, whole = SERIES.at(chunk=chunk), SERIES.at(chunk=1 << 30)
    one = lambda series: table(framed(bars, series, 30, 20, lambda w: {"m": F.avg("close").over(trailing(w, 30)), "f": F.max("high").over(labels.ahead(w, 20))}), "m", "f")
    assert one(s) == one(whole)
    scan = lambda series: table(block_scan(bars, series, {"c": F.col("volume")}), "c")
    assert {k: round(v[0], 6) for k, v in scan(s).items()} == {k: round(v[0], 6) for k, v in scan(whole).items()}
    touch = lambda series: table(labels.first_touch(bars, series, 0.004, 0.003, 25), "outcome", "holding", "realized")
    assert touch(s) == touch(whole)
    chosen = lambda series: sorted(table(payoff.select_non_overlapping(bars.withColumn("go", F.col("volume") > 9), series, "go", 15), "close"))
    assert chosen(s) == chosen(whole)


def test_row_index(bars):
    got = table(with_row_index(bars, SERIES.at(chunk=7)), "row_idx")
    for name in ("a", "b"):
        times = sorted(t for i, t in got if i == name)
        assert [got[name, t][0] for t in times] == list(range(len(times)))


@pytest.mark.parametrize("adjust", [False, True])
def test_ema_equals_recursion(bars, adjust):
    got = table(ema(bars, SERIES.at(chunk=1 << 20), {"e": (F.col("close"), 5, 5)}, adjust), "e")
    q, y, weight = 1 - 2 / 6, None, 0.0
    for i, r in enumerate(sorted((r for r in walk()), key=lambda r: r[2])):
        if adjust:
            y, weight = (0.0 if y is None else y) * q + r[6], weight * q + 1
            value = y / weight
        else:
            y = r[6] if y is None else q * y + (1 - q) * r[6]
            value = y
        assert got["a", r[2]][0] is None if i < 4 else abs(got["a", r[2]][0] - value) < 1e-6


def test_both_touch_kernels_agree(bars, monkeypatch):
    for side in (labels.LONG, labels.SHORT):
        arrays = table(labels.first_touch(bars, SERIES, 0.004, 0.003, 25, side), "outcome", "tp_offset", "sl_offset", "realized")
        monkeypatch.setattr(labels, "ARRAY_HORIZON", 1)
        assert table(labels.first_touch(bars, SERIES, 0.004, 0.003, 25, side), "outcome", "tp_offset", "sl_offset", "realized") == arrays
        monkeypatch.undo()


def test_touch_by_hand(spark):
    rows = [("x", "a", T0 + i * MINUTE, 100.0, 100.5, 99.5, 100.0, 1.0, None, None) for i in range(10)]
    rows[3] = (*rows[3][:4], 102.0, 99.5, *rows[3][6:])  # target
    rows[6] = (*rows[6][:4], 102.0, 98.0, *rows[6][6:])  # both: stop
    got = table(labels.first_touch(spark.createDataFrame(rows, COLUMNS), SERIES, 0.02, 0.02, 3), "outcome", "holding")
    at = lambda i: got["a", T0 + i * MINUTE]
    assert at(0) == ("TP", 3) and at(2) == ("TP", 1) and at(3) == ("SL", 3) and at(5) == ("SL", 1) and at(7) == (None, None)


def test_features_do_not_see_the_future(spark, bars):
    cut = T0 + 250 * MINUTE
    changed = bars.withColumn("close", F.when(F.col("ts_ms") > cut, F.col("close") * 3).otherwise(F.col("close"))).withColumn("volume", F.when(F.col("ts_ms") > cut, 0.0).otherwise(F.col("volume")))
    names = ["ret_5", "rv_30", "atr_14", "volume_z", "ema_20", "trend_score", "vol_regime"]
    run = lambda df: table(features.state_features(df, SERIES, regime=60, z=60, spans=(20, 50, 100)), *names)
    a, b = run(bars), run(changed)
    assert all(a[k] == b[k] for k in a if k[1] <= cut) and any(a[k] != b[k] for k in a if k[1] > cut)


def test_warm_up_is_null(bars):
    got = features.state_features(bars, SERIES, regime=60, z=60, spans=(20, 50, 100)).where(f"ts_ms < {T0 + 20 * MINUTE}").agg(F.count("rv_30"), F.count("ema_20"), F.count("ret_60")).first()
    assert tuple(got) == (0, 2, 0)


def test_as_of(spark, bars):
    prints = [("x", "a", T0 - 5, 1.0), ("x", "a", T0 + 10 * MINUTE, 2.0), ("x", "a", T0 + 10 * MINUTE + 1, 3.0), ("x", "a", T0 + 10_000 * MINUTE, 9.0), ("x", "b", T0 + 30 * MINUTE, 5.0)]
    got = table(as_of(bars.drop("funding_rate"), spark.createDataFrame(prints, "venue string, instrument string, ts_ms long, funding_rate double"), SERIES.at(chunk=7), ["funding_rate"]), "funding_rate")
    assert got["a", T0][0] == 1.0 and got["a", T0 + 10 * MINUTE][0] == 2.0 and got["a", T0 + 11 * MINUTE][0] == 3.0 and got["a", T0 + 399 * MINUTE][0] == 3.0
    assert got["b", T0][0] is None and got["b", T0 + 299 * MINUTE][0] == 5.0


def test_quality_codes(spark):
    rows = walk(30, 3)
    rows[5] = (*rows[5][:4], 1.0, *rows[5][5:])  # high below the rest
    rows[7] = (*rows[7][:7], -1.0, *rows[7][8:])
    df = spark.createDataFrame([*rows[:10], *rows[11:], rows[20]], COLUMNS)
    codes = {r.code: r.rows for r in quality.validate_bars(df, SERIES).collect()}
    assert codes == {"BAR_GAPS": 1, "DUPLICATE_TIMESTAMPS": 1, "OHLC_INCOHERENT": 1, "NEGATIVE_VOLUME": 1}
    segments = {r.segment for r in quality.with_segments(spark.createDataFrame([*rows[:10], *rows[11:]], COLUMNS), SERIES).collect()}
    assert segments == {0, 1}
    assert quality.require_contiguous(spark.createDataFrame(rows, COLUMNS), SERIES).count() == 30
    with pytest.raises(Exception, match="not contiguous"):
        quality.require_contiguous(df, SERIES).collect()
    trades = spark.createDataFrame([("x", "a", 1, 1_700_000_000_000, 1.0, 1.0, 0), ("x", "a", 1, 1_600_000_000, 0.0, -1.0, 1), ("x", "a", 2, None, 1.0, 1.0, 2)], "venue string, instrument string, trade_id long, ts_ms long, price double, quantity double, arrival long")
    codes = {r.code: r.rows for r in quality.validate_trades(trades, SERIES).collect()}
    assert codes == {"NULL_TIMESTAMPS": 1, "UNIT_SUSPECT": 1, "NON_MONOTONIC_TS": 1, "DUPLICATE_TRADES": 1, "NONPOSITIVE_PRICE": 1, "NONPOSITIVE_QUANTITY": 1}


def test_firewall(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, "s", 2)], "ret_5 double, fwd_ret_5 double, close double, name string, target_up int")
    assert quality.model_features(df) == ["ret_5"]


def test_tick_problems(spark):
    rows = [("s", "i", 10, 1, 100.0, 99.0, 101.0, 0), ("s", "i", 10, 1, 100.0, 99.0, 101.0, 1), ("s", "i", 12, 4, 100.0, 102.0, 101.0, 2), ("s", "i", 11, 5, 200.0, 99.0, 101.0, 3)]
    df = spark.createDataFrame(rows, "source string, instrument string, event_ts long, sequence long, last double, bid double, ask double, arrival long")
    got = {r.code: r.ticks for r in quality.tick_problems(df).collect()}
    assert got == {"RETRANSMIT": 1, "SEQUENCE_GAP": 1, "CROSSED": 1, "OUT_OF_ORDER": 1, "LAST_OFF_MID": 1}


def test_accounting_identities(spark):
    df = spark.createDataFrame([(1, 100.0, 101.0, 0.0001), (-1, 100.0, 99.0, 0.0001)], "side int, entry double, exit double, funding double").withColumns(payoff.components())
    for r in df.collect():
        assert abs(r.net - (r.gross - r.fees - r.funding_cost)) < 1e-15 and abs(r.raw - r.gross - r.slippage_cost) < 1e-15 and r.slippage_cost > 0
        assert (r.funding_cost > 0) == (r.side > 0)


def test_greedy_choice_equals_a_loop(spark, bars):
    got = sorted(t for i, t in table(payoff.select_non_overlapping(bars.withColumn("go", F.col("volume") > 6), SERIES.at(chunk=16), "go", 9), "close") if i == "a")
    picks, last = [], -(10**9)
    for i, r in enumerate(walk()):
        if r[7] > 6 and i - last >= 9:
            picks.append(r[2])
            last = i
    assert got == picks


@pytest.mark.parametrize("horizon,block_rows,joined", [(2, 32, 2), (7, 16, 3), (9, 16_384, 256), (40, 80, 2), (1, 64, 2)])
def test_composed_choice_equals_a_loop(spark, horizon, block_rows, joined):
    """Dense, sparse and gappy stretches, across chunks, blocks and runs of blocks."""
    rng = random.Random(horizon)
    rows = []
    for key in ("dense", "sparse", "mixed", "every"):
        share = 1.0
        for i in range(3000):
            if key == "mixed" and i % 97 == 0:
                share = rng.choice([0.0, 0.02, 0.5, 1.0])
            odds = {"dense": 0.9, "sparse": 0.02, "mixed": share, "every": 1.0}[key]
            rows.append(("x", key, T0 + 60_000 * i, i, rng.random() < odds))
    df = spark.createDataFrame(rows, "venue string, instrument string, ts_ms long, i int, go boolean").repartition(6)
    chosen = payoff.select_non_overlapping(df, SERIES.at(chunk=64), "go", horizon, block_rows, joined)
    got = sorted((r.instrument, r.i) for r in chosen.collect())
    want = []
    for key in ("dense", "sparse", "mixed", "every"):
        free = 0
        for _, k, _, i, go in rows:
            if k == key and go and i >= free:
                want.append((key, i))
                free = i + horizon
    assert got == sorted(want)
    plan = chosen._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_q_values_are_monotone(spark):
    df = spark.createDataFrame([(float(t),) for t in (0.1, 4.0, 2.5, -3.0, 1.0)] + [(None,)], "t_stat double")
    rows = [r for r in events.with_q_values(df).collect() if r.p_value is not None]
    rows.sort(key=lambda r: r.p_value)
    assert all(a.q_value <= b.q_value for a, b in zip(rows, rows[1:], strict=False)) and all(r.p_value <= r.q_value <= 1 for r in rows)


def test_funding_and_book(spark):
    book = spark.createDataFrame([(1, [(100.0, 1.0), (101.0, 1.0)])], "id long, asks array<struct<price: double, size: double>>")
    r = payoff.book_walk(book, "id", "asks", 150.0).first()
    assert abs(r.average_price - 150 / (1 + 50 / 101)) < 1e-12 and r.fill_share == 1.0
    h = spark.range(1).select(payoff.expected_prints(F.lit(0), F.lit(28_800_000 * 2 + 1)).alias("n")).first()
    assert h.n == 2


@pytest.mark.parametrize("bucket_ms", [1, 5_000, 1 << 40])
def test_order_rates_by_hand(spark, bucket_ms):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *(rng.randrange(T0, T0 + 60_000) for _ in range(30))]), rng.choice(["ENTER", "EXIT", None])) for i in range(300)]
    rows += [("a", 300 + i, T0 + 10_000, "EXIT") for i in range(5)]
    got = {r.id: (r.recent_orders, r.last_exit_ts, r.rate_limited, r.cooling_down) for r in payoff.order_rates(spark.createDataFrame(rows, "who string, id long, ts_ms long, kind string"), ["who"], window_ms=2_000, most=6, cooldown_ms=1_500, bucket_ms=bucket_ms).collect()}
    for who, i, t, _ in rows:
        own = [r for r in rows if r[0] == who]
        recent = sum(r[2] is None if t is None else r[2] is not None and t - 2_000 <= r[2] <= t for r in own)
        exit_ts = max((r[2] for r in own if t is not None and r[2] is not None and r[2] < t and r[3] == "EXIT"), default=None)
        assert got[i] == (recent, exit_ts, recent > 6, exit_ts is not None and t - exit_ts < 1_500)
    assert len(got) == len(rows)


@pytest.mark.parametrize("horizon,chunk", [(1, 7), (5, 16), (13, 64), (64, 32), (200, 50)])
def test_touch_times_by_hand(spark, horizon, chunk):
    """First touches of several levels, with chunks shorter and longer than the horizon."""
    rng = random.Random(horizon)
    rows, price = [], 100.0
    for i in range(400):
        o = price * (1 + rng.uniform(-0.01, 0.01))
        price = o * (1 + rng.uniform(-0.02, 0.02))
        rows.append(("x", "a", T0 + MINUTE * i, o, max(o, price) * 1.002, min(o, price) * 0.998, price, rng.choice([0.01, 0.05, None])))
    df = spark.createDataFrame(rows, "venue string, instrument string, ts_ms long, open double, high double, low double, close double, own double").repartition(3)
    levels = {"up": (F.lit(0.03), 1), "down": (F.lit(0.02), -1), "own": (F.col("own"), 1)}
    horizons = sorted({max(1, horizon // 3), horizon})
    got = {r.ts_ms: r for r in labels.touch_times(df, SERIES.at(chunk=chunk), horizons, levels).collect()}
    assert len(got) == len(rows)
    for i, row in enumerate(rows):
        r = got[row[2]]
        path = rows[i + 1 : i + 1 + horizon]
        entry = rows[i + 1][3] if i + 1 < len(rows) else None
        assert r.entry == entry
        for h in horizons:
            leave = rows[i + h + 1][3] if i + h + 1 < len(rows) else None
            assert r[f"exit_{h}"] == leave and r[f"whole_{h}"] == (leave is not None)
        for name, fraction, side in (("up", 0.03, 1), ("down", 0.02, -1), ("own", row[7], 1)):
            want = None
            if entry is not None and fraction is not None:
                level = entry * (1 + side * fraction)
                want = next((k for k, b in enumerate(path, 1) if (b[4] >= level * (1 - 1e-12) if side == 1 else b[5] <= level * (1 + 1e-12))), None)
            assert r[name] == want, (i, name)
    plan = labels.touch_times(df, SERIES, horizons, levels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan
