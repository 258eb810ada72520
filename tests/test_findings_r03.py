"""Findings of round 3: what differed from its SQL, or grew faster than its input, on small tables that show it."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.plans import quantiles


def test_quantiles_with_a_sketch_that_differs_each_time(spark, monkeypatch):
    """a sketch merged in another order proposes other values; both uses of a proposal must see the same."""
    plain = F.percentile_approx
    moved = F.udf(lambda cells: [c - random.random() * 1e-6 for c in cells], "array<double>")
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: moved(plain(*a)))
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    got = {r["k"]: r["mid"] for r in quantiles.exact_quantiles(df, ["k"], {"v": F.col("v")}, {"mid": ("v", 0.5)}, small=40).collect()}
    assert got == {0: 1499.0, 1: 1500.0}


def same_as_sql(spark, folder, name, **tables):
    """The query and its SQL over small tables: name -> rows and schema."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = queries.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    plain = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall())
    assert got == want
    return got


def events(spark, rows):
    """(event_id, second of the first of January 2024, user_id, event_type, value, props) as an events table."""
    df = spark.createDataFrame(rows, "event_id long, s double, user_id long, event_type string, value double, props string")
    return df.withColumn("ts", F.timestamp_micros(((F.col("s") + 1_704_067_200) * 1e6).cast("long")).cast("timestamp_ntz")).drop("s")


def test_group_distribution_counts_rows_without_a_value(spark, tmp_path):
    """n is the number of rows, also of groups and rows without a value."""
    rows = [(i, float(i), 1, ("a", "b", None)[i % 3], None if i % 4 == 0 or i % 3 == 1 else float(i), "{}") for i in range(60)]
    assert len(same_as_sql(spark, tmp_path, "a14_group_distribution", events=events(spark, rows))) == 3


def test_scalars_of_missing_parts(spark, tmp_path):
    """a hash of a missing part is missing, and so is the bucket of a missing time."""
    rows = [(i if i % 5 else None, float(i) if i % 7 else None, 1, ("View", None, "error")[i % 3], 1.0, '{"k": %d}' % i if i % 4 else None) for i in range(60)]
    assert len(same_as_sql(spark, tmp_path, "f_scalars", events=events(spark, rows))) == 60


def test_timeouts_of_folds_without_any(spark, tmp_path):
    """a fold none of whose trades times out has no row."""
    day = F.expr("timestamp_ntz'1992-01-01' + make_dt_interval(cast(id / 9 as int), 0, 0, 0)")
    price = F.lit(100.0) * F.pow(F.lit(10.0), F.col("id") % 9)  # a day's range holds the lower barrier of each entry
    lines = spark.range(9 * 2600).select((F.col("id") + 1).alias("l_orderkey"), F.lit(1).cast("long").alias("l_linenumber"), F.lit("O").alias("l_linestatus"), F.lit("N").alias("l_returnflag"), day.alias("l_shipdate"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"), (price * (F.col("id") % 50 + 1)).alias("l_extendedprice"))
    assert same_as_sql(spark, tmp_path, "m9_timeouts", lineitem=lines) == []


def test_probability_bars_of_equal_times(spark, tmp_path):
    """a bar for each event, also where events of a type share their millisecond."""
    rows = [(i, float(i // 3), 1, "ab"[i // 3 % 2], i / 7, "{}") for i in range(30)]
    assert len(same_as_sql(spark, tmp_path, "s14_probability_bars", events=events(spark, rows))) == 30


def test_order_rates_without_sliding_frames(spark, tmp_path):
    """a frame that slides is summed anew for each row, which grows with the square of the orders in a window."""
    rows = [(i, float(i % 40 * 97), i % 7, "ab"[i % 2], 1.0, "{}") for i in range(200)]
    assert len(same_as_sql(spark, tmp_path, "c24_order_rates", events=events(spark, rows))) == 200
    plan = queries.queries()["c24_order_rates"](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan


class Held:
    """State of one key in memory, which counts how often it is used."""

    def __init__(self):
        self.maps, self.single, self.timers, self.uses = {}, {}, set(), 0

    def getMapState(self, name, *_):
        held = self.maps.setdefault(name, {})

        class Map:
            keys = iterator = None

        m = Map()

        def use(f):
            def run(*a):
                self.uses += 1
                return f(*a)

            return run

        m.keys, m.iterator = use(lambda: iter(list(held))), use(lambda: iter(list(held.items())))
        m.getValue, m.removeKey, m.updateValue = use(held.__getitem__), use(lambda k: held.pop(k)), use(held.__setitem__)
        return m

    def getListState(self, *_):
        raise AssertionError("a list is read and written row by row")

    def getValueState(self, name, *_):
        class Value:
            exists = lambda _: name in self.single
            get = lambda _: self.single[name]
            update = lambda _, v: self.single.__setitem__(name, v)

        return Value()

    listTimers = lambda self: iter(list(self.timers))
    deleteTimer = lambda self, t: self.timers.discard(t)
    registerTimer = lambda self, t: self.timers.add(t)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("kind", ["F8 and F9", "F7"])
def test_waiting_ticks_are_read_by_blocks(kind):
    """F7 to F9: what waits costs a use of the state a block, not one a row and watermark; a slot is released at a time."""
    import numpy as np
    import pandas as pd

    from tidemark.streaming import ticks as st

    rng = np.random.default_rng(3)
    n, delay = 20_000, "64 seconds"
    at = np.sort(rng.integers(0, 256_000, n))
    rows = pd.DataFrame({"received_ts": pd.to_datetime(at, unit="ms"), "event_ts": pd.to_datetime(at - rng.integers(0, 3000, n), unit="ms"), "sequence": np.arange(n) + (np.arange(n) > 500), "generation": 1 + at // 100_000, "quantity": 1.0})
    for f in st.FIELDS:
        rows[f] = np.where(rng.random(n) < 0.3, rng.random(n), np.nan)
    p = st.FieldMerge(2000, delay) if kind == "F7" else st.SequenceCheck(delay)
    held, out = Held(), []
    p.init(held)
    order = np.roll(np.arange(n), n // 2)
    for i in range(0, n, 5000):
        list(p.handleInputRows(("s", "i"), iter([rows.iloc[order[i : i + 5000]]]), Clock(0)))
    for passed in (90_000, 90_500, 400_000):
        assert min(held.timers) <= passed
        held.timers.clear()
        out += p.handleExpiredTimer(("s", "i"), Clock(passed), None)
    assert not held.timers and not held.maps["rows"]
    assert held.uses < 2000 and max(map(len, out)) < n / 100
    got = pd.concat(out, ignore_index=True)
    assert got["sequence"].tolist() == rows["sequence"].tolist()
    event = (rows["event_ts"].astype("datetime64[ms]").astype("int64")).tolist()
    if kind == "F7":
        top, last, newest = 0, {}, 0
        for i in range(n):
            if rows["generation"][i] > top:
                top, last, newest = rows["generation"][i], {}, event[i]
            newest = max(newest, event[i])
            for f in st.FIELDS:
                v = rows[f][i]
                if v == v and (f not in last or event[i] >= last[f][1]):
                    last[f] = (v, event[i])
                want = last[f][0] if f in last and newest - last[f][1] <= 2000 else None
                assert (want is None and got[f][i] != got[f][i]) or want == got[f][i]
            assert (got["generation"][i], got["event_ms"][i]) == (top, newest)
    else:
        most = None
        for i in range(n):
            assert got["codes"][i] == (["LATE"] if most is not None and event[i] < most else []) + (["GAP"] if i == 501 else [])
            assert got["newer"][i] == (most is None or event[i] > most)
            most = event[i] if most is None else max(most, event[i])


def test_a_book_holds_a_slot_of_updates_at_a_time():
    """however many updates a batch has, in whatever order, a slot of them is sorted and handed on at a time."""
    import numpy as np
    import pandas as pd

    from tidemark.streaming import ticks as st

    n = 3000
    one = lambda v: [np.array([float(v)])] * n
    rows = pd.DataFrame({"instrument": "i", "update_id": np.arange(n), "is_snapshot": np.arange(n) % 500 == 0, "bid_prices": one(9), "bid_sizes": one(1), "ask_prices": one(10), "ask_sizes": one(2)})
    rows = rows.drop(index=1234).sample(frac=1, random_state=5)
    p, held = st.Book(5, slot=100), Held()
    p.init(held)
    out = list(p.handleInputRows(("i",), (rows.iloc[i : i + 1000] for i in range(0, n, 1000)), Clock(0)))
    assert len(out) == 30 and max(map(len, out)) <= 100 and not held.maps["updates"]
    got = pd.concat(out)
    assert got["update_id"].tolist() == [k for k in range(n) if not (k == 1234 or 1235 < k < 1500)]
    assert got[got["status"] == "GAP"]["update_id"].tolist() == [1235]
    assert set(got[got["status"] == "OK"]["notional"]) == {29.0}


def test_bars_do_not_wait_for_wider_ones(spark, tmp_path):
    """a minute that has closed appears though its five minutes are open; wider bars gather over batches."""
    from test_streaming import drain, land, tick

    from tidemark.streaming import ticks as st

    path = land(tmp_path, [tick(1, 40)], [tick(2, 100), tick(3, 160)], [tick(4, 220), tick(5, 280)], [tick(6, 400)], [tick(7, 470)])
    rows = drain(st.rolled_up(st.read_ticks(spark, path, files_per_batch=1), ("1 minute", "5 minutes")), tmp_path, "each")
    got = sorted((r.frame, r.start.minute, r.open, r.close, r.trades) for r in rows)
    assert got == [("1 minute", 14 + m, 100.0 + s, 100.0 + s, 1) for s, m in ((1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 6))] + [("5 minutes", 10, 101.0, 101.0, 1), ("5 minutes", 15, 102.0, 105.0, 4)]
