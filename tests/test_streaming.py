"""Streams from landed files with availableNow: the same results as the batch twins."""

import json
import os
import time

from pyspark.sql import functions as F

from tidemark.streaming import ticks as st

T0 = 1_700_000_000


def tick(seq, at, **more):
    return {"source": "s", "venue": "v", "instrument": "i", "event_ts": f"2023-11-14T22:13:{20 + at % 40:02d}.000Z" if at < 40 else f"2023-11-14T22:{14 + (at - 40) // 60:02d}:{(at - 40) % 60:02d}.000Z", "received_ts": f"2023-11-14T23:00:{seq:02d}.000Z", "sequence": seq, "kind": "trade", "side": "buy", "price": 100.0 + seq, "quantity": 1.0, "generation": 1} | more


def land(tmp_path, *batches):
    for k, rows in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        file = tmp_path / "in" / f"{k}.json"
        file.write_text("\n".join(map(json.dumps, rows)))
        os.utime(file, (T0 + k, T0 + k))  # the source takes files by their time
    return str(tmp_path / "in")


def drain(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_minute_flow_and_closed_bars(spark, tmp_path):
    path = land(tmp_path, [tick(1, 0), tick(2, 5, side="sell"), tick(3, 45)], [tick(4, 50), tick(5, 400)], [tick(6, 800)])
    rows = drain(st.minute_flow(st.read_ticks(spark, path, files_per_batch=1)), tmp_path, "flow")
    first = min(rows, key=lambda r: r.start)
    assert (first.buy_volume, first.sell_volume, first.trades) == (1.0, 1.0, 2)
    bars = sorted(drain(st.closed_bars(st.read_ticks(spark, path, files_per_batch=1)), tmp_path, "bars"), key=lambda r: r.start)
    assert (bars[0].open, bars[0].close, bars[0].trades) == (101.0, 102.0, 2) and (bars[1].open, bars[1].close) == (103.0, 104.0)


def test_dedupe(spark, tmp_path):
    path = land(tmp_path, [tick(1, 0), tick(1, 0)], [tick(1, 0), tick(2, 1)])
    assert len(drain(st.without_retransmissions(st.read_ticks(spark, path, files_per_batch=1)), tmp_path, "dedupe")) == 2


#: A tick of another source an hour on: the watermark passes all before it.
CLOCK = tick(0, 0, source="clock", received_ts="2023-11-15T01:00:00.000Z")


def test_sequence_problems(spark, tmp_path):
    path = land(tmp_path, [tick(1, 0), tick(2, 5), tick(5, 6)], [tick(5, 7, received_ts="2023-11-14T23:00:05.500Z"), tick(6, 3)], [CLOCK])
    got = {(r.sequence, r.code) for r in drain(st.sequence_problems(st.read_ticks(spark, path, files_per_batch=1)), tmp_path, "seq")}
    assert got == {(5, "GAP"), (5, "REPEAT"), (6, "LATE")}


def test_merged_fields(spark, tmp_path):
    path = land(tmp_path, [tick(1, 0, bid=99.0, price=None), tick(2, 1, ask=101.0)], [tick(3, 30, price=5.0)], [tick(4, 31, generation=2, bid=1.0, price=None)], [CLOCK])
    rows = sorted(drain(st.merged_fields(st.read_ticks(spark, path, files_per_batch=1)), tmp_path, "merged"), key=lambda r: r.sequence)
    assert [r.sequence for r in rows] == [1, 2, 3, 4]
    assert (rows[0].bid, rows[0].ask) == (99.0, None) and (rows[1].bid, rows[1].ask) == (99.0, 101.0)
    assert rows[2].price == 5.0 and rows[2].bid is None  # too old
    assert rows[3].generation == 2 and rows[3].bid == 1.0 and rows[3].price is None


def test_merged_fields_of_an_older_connection(spark, tmp_path):
    straggler = tick(3, 0, bid=99.0, received_ts="2023-11-14T23:00:04.500Z")
    path = land(tmp_path, [tick(4, 31, generation=2, bid=1.0, price=None)], [straggler], [tick(5, 32, generation=2, ask=3.0, price=None)], [CLOCK])
    rows = sorted(drain(st.merged_fields(st.read_ticks(spark, path, files_per_batch=1)), tmp_path, "older"), key=lambda r: r.sequence)
    assert [(r.generation, r.bid, r.ask) for r in rows] == [(2, 1.0, None), (2, 1.0, 3.0)]


def test_newer_and_late(spark, tmp_path):
    path = land(tmp_path, [tick(1, 0), tick(2, 5), tick(5, 6)], [tick(5, 7, received_ts="2023-11-14T23:00:05.500Z"), tick(6, 3), tick(7, 9)], [CLOCK])
    newer = drain(st.only_newer(st.read_ticks(spark, path, files_per_batch=1)), tmp_path, "newer")
    assert sorted(r.event_ms % 60_000 // 1000 - 20 for r in newer) == [0, 5, 6, 7, 9]
    st.split_late(st.read_ticks(spark, path, files_per_batch=1), str(tmp_path / "good"), str(tmp_path / "late"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.sequence for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [6]
    assert spark.read.parquet(str(tmp_path / "good")).count() == 5


def test_files_in_any_order_give_one_result(spark, tmp_path):
    """Both ordered operators against a loop over the ticks in order, however the files lie and land."""
    import random

    r = random.Random(4)
    ticks = []
    for k in range(1, 40):
        maybe = lambda v: v if r.random() < 0.5 else None
        ticks.append(tick(k + (k > 20), r.randrange(80), instrument=r.choice("ij"), received_ts=f"2023-11-14T23:00:{k:02d}.000Z", price=maybe(float(k)), bid=maybe(k + 0.5), ask=maybe(k + 0.25), generation=1 + k // 15 - (k % 7 == 0)))
    results = []
    for n, seed in enumerate((None, 1, 2)):
        own = list(ticks)
        if seed:
            random.Random(seed).shuffle(own)
        (tmp_path / str(n)).mkdir()
        path = land(tmp_path / str(n), *(own[i : i + 13] for i in range(0, 39, 13)), [CLOCK])
        problems = drain(st.sequence_problems(st.read_ticks(spark, path, files_per_batch=1)), tmp_path, f"any{n}")
        fields = drain(st.merged_fields(st.read_ticks(spark, path, files_per_batch=1), 20_000), tmp_path, f"anyf{n}")
        results.append((sorted(map(str, problems)), sorted(map(str, fields))))
    assert results[0] == results[1] == results[2] and len(results[0][0]) > 20 and len(results[0][1]) > 20
    codes, last, newest = 0, {}, {}
    for t in ticks:
        key, s, at = t["instrument"], t["sequence"], t["event_ts"]
        if key in last:
            codes += (at < newest[key]) + (s != last[key] + 1)
        last[key], newest[key] = s, max(at, newest.get(key, at))
    assert codes == len(results[0][0])


def test_complete_bars_and_roll_ups(spark, tmp_path):
    path = land(tmp_path, [tick(k, 40 + 60 * k) for k in range(5)] + [tick(9, 400), tick(10, 2000)])
    bars = lambda **o: drain(st.closed_bars(st.read_ticks(spark, path), "5 minutes", **o), tmp_path, f"b{len(o)}")
    assert sorted(r.trades for r in bars()) == [1, 1, 4] or sorted(r.trades for r in bars()) == [1, 5]
    assert all(r.trades == 5 for r in bars(step="1 minute", steps=5))
    rows = drain(st.rolled_up(st.read_ticks(spark, path), ("1 minute", "5 minutes")), tmp_path, "rolled")
    wide, small = ([r for r in rows if r.frame == f] for f in ("5 minutes", "1 minute"))
    assert len(wide) + len(small) == len(rows) and sum(r.trades for r in wide) == sum(r.trades for r in small) == 6
    for w in wide:
        own = sorted((r for r in small if w.start <= r.start < w.end), key=lambda r: r.start)
        assert (w.open, w.close, w.high, w.low) == (own[0].open, own[-1].close, max(r.high for r in own), min(r.low for r in own))
        assert w.volume == sum(r.volume for r in own)
    plan = st.rolled_up(st.read_ticks(spark, path), ("1 minute", "5 minutes", "15 minutes"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("StreamingRelation") == 1
    q = st.closed_bars(st.read_ticks(spark, path)).writeStream.format("parquet").option("path", str(tmp_path / "bars")).option("checkpointLocation", str(tmp_path / "cb")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    landed = spark.readStream.schema("instrument string, start timestamp, end timestamp, open double, high double, low double, close double, volume double, trades long").parquet(str(tmp_path / "bars"))
    again = drain(st.wider_bars(landed, "5 minutes"), tmp_path, "wider")
    assert {(r.start, r.open, r.close, r.trades) for r in again} <= {(r.start, r.open, r.close, r.trades) for r in wide} and again


def test_events_of_new_bars(spark, tmp_path):
    bar = lambda k, o, h, lo, c: {"instrument": "i", "start": f"2023-11-14T22:{k:02d}:00.000Z", "open": o, "high": h, "low": lo, "close": c, "volume": 1.0}
    path = land(tmp_path, [bar(1, 10.0, 11.0, 9.0, 10.0)], [bar(2, 10.0, 13.0, 10.0, 12.0), bar(1, 10.0, 11.0, 9.0, 10.0)], [bar(3, 13.0, 13.5, 8.0, 9.5)])
    stream = spark.readStream.schema("instrument string, start timestamp, open double, high double, low double, close double, volume double").option("maxFilesPerTrigger", 1).json(path)
    got = {(r.start_ms % 3_600_000 // 60_000, r.event_type) for r in drain(st.bar_events(stream), tmp_path, "barevents")}
    assert got == {(2, "range_breakout"), (2, "trend_transition"), (3, "range_breakout"), (3, "range_failure"), (3, "trend_transition")}


class Held:
    """State of one key and a clock, as the engine hands them to a processor."""

    def __init__(self):
        self.value, self.timers, self.now = None, [], 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_freshness_timer():
    import pandas as pd

    held, processor = Held(), st.Freshness(1_000)
    processor.init(held)
    batch = lambda ms: iter([pd.DataFrame({"event_ts": [pd.Timestamp(ms, unit="ms")]})])
    held.now = 10_500
    assert [tuple(r) for pdf in processor.handleInputRows(("s", "i"), batch(10_000), held) for r in pdf.to_numpy().tolist()] == [("s", "i", 10_000, 500, "FRESH")]
    assert held.timers == [11_001]
    list(processor.handleInputRows(("s", "i"), batch(10_400), held))
    assert held.timers == [11_401]
    held.now = 11_401
    assert [r[4] for pdf in processor.handleExpiredTimer(("s", "i"), held, None) for r in pdf.to_numpy().tolist()] == ["STALE"]
    held.now = 9_000  # a clock behind the newest tick
    assert [r[4] for pdf in processor.handleInputRows(("s", "i"), batch(9_500), held) for r in pdf.to_numpy().tolist()] == ["FUTURE"]


def test_liquidations_and_messages(spark, tmp_path):
    path = land(tmp_path, [tick(1, 0, kind="liquidation"), tick(2, 5, kind="liquidation", side="sell", quantity=3.0), tick(3, 6)], [tick(4, 900)])
    rows = drain(st.liquidations(st.read_ticks(spark, path, files_per_batch=1).unionByName(st.read_ticks(spark, path).where("false"))), tmp_path, "liq")
    assert rows == [] or (rows[0].liq_buy_qty, rows[0].liq_sell_qty) == (1.0, 3.0)
    raw = spark.createDataFrame([(json.dumps(tick(1, 0)),), ("no message",), (None,)], "value string")
    assert [r.sequence for r in st.parse_messages(raw).collect()] == [1]


def test_order_book(spark, tmp_path):
    side = lambda *x: [{"price": p, "size": s} for p, s in x]
    d = lambda u, snap, bids, asks: {"instrument": "i", "update_id": u, "is_snapshot": snap, "bids": bids, "asks": asks}
    path = land(tmp_path, [d(1, True, side((99.0, 1.0), (98.0, 2.0)), side((101.0, 1.0)))], [d(2, False, side((99.0, 0.0)), side((100.5, 3.0))), d(4, False, side((97.0, 1.0)), [])], [d(5, False, side((1.0, 1.0)), []), d(9, True, side((90.0, 1.0)), side((91.0, 1.0)))])
    stream = spark.readStream.schema(st.DELTA).option("maxFilesPerTrigger", 1).json(path)
    rows = sorted(drain(st.order_books(stream, 2), tmp_path, "book"), key=lambda r: r.update_id)
    assert [(r.update_id, r.status, r.bid, r.ask) for r in rows] == [(1, "OK", 99.0, 101.0), (2, "OK", 98.0, 100.5), (4, "GAP", None, None), (9, "OK", 90.0, 91.0)]
    assert rows[1].ask_depth == 4.0


def test_sinks_are_idempotent(spark, tmp_path):
    path = land(tmp_path, [tick(1, 0), tick(2, 0)])
    st.write_once(st.read_ticks(spark, path), str(tmp_path / "out"), str(tmp_path / "ck"), ["instrument"], "sequence").awaitTermination(60)
    st.write_once(st.read_ticks(spark, path), str(tmp_path / "out"), str(tmp_path / "ck2"), ["instrument"], "sequence").awaitTermination(60)
    assert [r.sequence for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
    st.append_log(st.read_ticks(spark, path), str(tmp_path / "log"), str(tmp_path / "ck3")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_freshness(spark):
    df = spark.sql("select timestamp '2023-11-14 22:13:20' as event_ts, timestamp '2023-11-14 22:13:40' as now")
    r = st.fresh_flags(df, F.col("now")).first()
    assert r.age_ms == 20_000 and r.stale and not r.future
