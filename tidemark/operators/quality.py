"""Data quality: dedupe, typing, range filters, validation reports, contiguity, coverage, firewall."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import finite
from tidemark.plans.series import block_scan, framed, with_row_index
from tidemark.spec import Series, require_columns

BAR_COLUMNS = ("ts_ms", "open", "high", "low", "close", "volume", "funding_rate", "open_interest")
ISSUES = "frame string, code string, rows long"


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``. Partial aggregation keeps one row a key and task before the shuffle."""
    struct = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.groupBy(*keys).agg(F.max(struct).alias("__last")).select(*(F.col(f"__last.{c}").alias(c) for c in df.columns))


def finalize_bars(df: DataFrame, series: Series, order: list[str] | None = None) -> DataFrame:
    """Required columns, exact types, one row per series and time; absent funding and open interest are null."""
    require_columns(df, [*series.keys, series.ts, "open", "high", "low", "close", "volume"])
    rows = df.where(F.col(series.ts).isNotNull())
    for c in ("funding_rate", "open_interest"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    extra = [c for c in order or [] if c not in BAR_COLUMNS and c not in series.keys]
    typed = rows.select(*series.keys, F.col(series.ts).cast("long").alias(series.ts), *(F.col(c).cast("double").alias(c) for c in BAR_COLUMNS[1:]), *extra)
    return keep_last(typed, [*series.keys, series.ts], order or ["close"]).drop(*extra)


def between(df: DataFrame, series: Series, start_ms: int, end_ms: int) -> DataFrame:
    """Half-open time range; the predicate reaches the Parquet scan."""
    return df.where((F.col(series.ts) >= start_ms) & (F.col(series.ts) < end_ms))


def issue_rows(df: DataFrame, frame: str, checks: Mapping[str, Column]) -> DataFrame:
    """(frame, code, rows) for each aggregate of ``checks`` that counts anything, in one pass over ``df``."""
    one = df.agg(*(F.coalesce(c.cast("long"), F.lit(0)).alias(k) for k, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("code"), F.col(k).alias("rows")) for k in checks))
    return one.select(F.lit(frame).alias("frame"), F.explode(pairs).alias("x")).select("frame", "x.code", "x.rows").where("rows > 0")


def with_previous(df: DataFrame, series: Series, order: str | None = None, name: str = "__prev") -> DataFrame:
    """Add the time of the row before, by time or by another order, in halo chunks."""
    along = series if order in (None, series.ts) else series.at(ts=order, step_ms=1)
    return framed(df, along, 1, 0, lambda w: {name: F.lag(series.ts).over(w)})


def validate_trades(df: DataFrame, series: Series, id_col: str = "trade_id", arrival: str = "arrival") -> DataFrame:
    """Issue rows: EMPTY, NULL_TIMESTAMPS, UNIT_SUSPECT, NON_MONOTONIC_TS, DUPLICATE_TRADES, NONPOSITIVE_PRICE, NONPOSITIVE_QUANTITY."""
    missing = [c for c in (series.ts, id_col, "price", "quantity") if c not in df.columns]
    if missing:
        return df.sparkSession.range(1).select(F.lit("trades").alias("frame"), F.lit("MISSING_COLUMNS").alias("code"), F.lit(len(missing)).cast("long").alias("rows"))
    rows = with_previous(df, series, arrival)
    ts = F.col(series.ts)
    plain = issue_rows(
        rows,
        "trades",
        {
            "EMPTY": (F.count("*") == 0).cast("int"),
            "NULL_TIMESTAMPS": F.count_if(ts.isNull()),
            "UNIT_SUSPECT": F.count_if(ts < 1_000_000_000_000),
            "NON_MONOTONIC_TS": F.count_if(ts < F.col("__prev")),
            "NONPOSITIVE_PRICE": F.count_if(F.col("price") <= 0),
            "NONPOSITIVE_QUANTITY": F.count_if(F.col("quantity") <= 0),
        },
    )
    return plain.unionByName(issue_rows(df.groupBy(*series.keys, id_col).count(), "trades", {"DUPLICATE_TRADES": F.sum(F.col("count") - 1)}))


def validate_book(df: DataFrame) -> DataFrame:
    """Issue rows: CROSSED_BOOK, NEGATIVE_DEPTH, NONPOSITIVE_PRICE."""
    return issue_rows(
        df,
        "book",
        {
            "CROSSED_BOOK": F.count_if(F.col("bid_price") > F.col("ask_price")),
            "NEGATIVE_DEPTH": F.count_if((F.col("bid_qty") < 0) | (F.col("ask_qty") < 0)),
            "NONPOSITIVE_PRICE": F.count_if((F.col("bid_price") <= 0) | (F.col("ask_price") <= 0)),
        },
    )


def coherent() -> Column:
    """high is at least and low at most each of open and close."""
    return (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))


def validate_bars(df: DataFrame, series: Series, arrival: str | None = None) -> DataFrame:
    """Issue rows: NON_MONOTONIC, DUPLICATE_TIMESTAMPS, BAR_GAPS, OHLC_INCOHERENT, NEGATIVE_VOLUME."""
    sorted_rows = with_previous(df, series).withColumn("__delta", F.col(series.ts) - F.col("__prev"))
    checks = {
        "DUPLICATE_TIMESTAMPS": F.count_if(F.col("__delta") == 0),
        "BAR_GAPS": F.count_if((F.col("__delta") != series.step_ms) & (F.col("__delta") != 0)),
        "OHLC_INCOHERENT": F.count_if(~coherent()),
        "NEGATIVE_VOLUME": F.count_if(F.col("volume") < 0),
    }
    out = issue_rows(sorted_rows, "bars", checks)
    if arrival:
        out = out.unionByName(issue_rows(with_previous(df, series, arrival), "bars", {"NON_MONOTONIC": F.count_if(F.col(series.ts) < F.col("__prev"))}))
    return out


def validation_report(frames: Mapping[str, tuple[DataFrame | None, DataFrame | None]], spark) -> DataFrame:
    """(frame, populated, rows, ok, issues) of each named (frame, its issue rows); one that is not there is reported."""
    parts = []
    for name, (df, issues) in frames.items():
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("frame"), F.lit(False).alias("populated"), F.lit(0).cast("long").alias("rows"), F.lit(False).alias("ok"), F.lit(None).cast("string").alias("issues")))
            continue
        count = df.agg(F.count("*").alias("rows"))
        codes = issues.agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("issues"))
        parts.append(count.crossJoin(codes).select(F.lit(name).alias("frame"), (F.col("rows") > 0).alias("populated"), "rows", ((F.col("rows") > 0) & (F.col("issues") == "")).alias("ok"), "issues"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_segments(df: DataFrame, series: Series, name: str = "segment") -> DataFrame:
    """Number the gap-free stretches of a series, from 0: a step other than the declared one starts the next."""
    rows = with_previous(df, series)
    gap = (F.col(series.ts) - F.col("__prev") != series.step_ms).cast("long")
    return block_scan(rows, series, {name: F.coalesce(gap, F.lit(0))}).drop("__prev")


def require_contiguous(df: DataFrame, series: Series) -> DataFrame:
    """``df``, or an error at run time in the row where a series skips or repeats a step."""
    ok = F.col("__prev").isNull() | (F.col(series.ts) - F.col("__prev") == series.step_ms)
    rows = with_previous(df, series).withColumn("__ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("series is not contiguous at "), F.col(series.ts).cast("string"))).cast("boolean")))
    return rows.where("__ok").drop("__ok", "__prev")


def coverage(df: DataFrame, series: Series) -> DataFrame:
    """Per series: rows, expected rows, missing, duplicates, invalid open interest, first and last time."""
    distinct = df.groupBy(*series.keys, series.ts).agg(F.count("*").alias("n"), F.count_if(F.col("open_interest") < 0).alias("bad_oi"))
    out = distinct.groupBy(*series.keys).agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("distinct_ts"),
        F.min(series.ts).alias("start_ms"),
        F.max(series.ts).alias("end_ms"),
        F.sum("bad_oi").alias("invalid_oi"),
    )
    expected = (F.floor((F.col("end_ms") - F.col("start_ms")) / series.step_ms) + 1).cast("long")
    return out.select(*series.keys, "rows", expected.alias("expected"), (expected - F.col("distinct_ts")).alias("missing"), (F.col("rows") - F.col("distinct_ts")).alias("duplicates"), "invalid_oi", "start_ms", "end_ms")


def field_coverage(df: DataFrame, series: Series, fields: list[str]) -> DataFrame:
    """(series, field, present, share, first_ms, last_ms): times at which a field is there, not its values."""
    long = df.select(*series.keys, series.ts, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("there")) for f in fields))).alias("x"))
    at = F.when(F.col("x.there"), F.col(series.ts))
    return long.groupBy(*series.keys, F.col("x.field").alias("field")).agg(
        F.count(at).alias("present"), (F.count(at) / F.count("*")).alias("share"), F.min(at).alias("first_ms"), F.max(at).alias("last_ms")
    )


def dataset_coverage(df: DataFrame, series: Series) -> DataFrame:
    """Per series: rows, days with rows, first and last time."""
    day = F.floor(F.col(series.ts) / 86_400_000)
    daily = df.groupBy(*series.keys, day.alias("day")).agg(F.count("*").alias("n"), F.min(series.ts).alias("a"), F.max(series.ts).alias("b"))
    return daily.groupBy(*series.keys).agg(F.sum("n").alias("rows"), F.count("*").alias("days"), F.min("a").alias("start_ms"), F.max("b").alias("end_ms"))


def live_integrity(df: DataFrame, series: Series, window_rows: int = 240) -> DataFrame:
    """Per series: gaps in the last ``window_rows`` steps (fatal), gaps before, incoherent rows."""
    last = df.groupBy(*series.keys).agg(F.max(series.ts).alias("__last"))
    rows = with_previous(df, series).withColumn("__delta", F.col(series.ts) - F.col("__prev")).join(last, list(series.keys))
    gap = F.col("__delta") != series.step_ms
    recent = F.col(series.ts) > F.col("__last") - window_rows * series.step_ms
    out = rows.groupBy(*series.keys).agg(F.count_if(gap & recent).alias("recent_gaps"), F.count_if(gap & ~recent).alias("older_gaps"), F.count_if(~coherent() | (F.col("volume") < 0)).alias("bad_rows"))
    return out.withColumn("ok", (F.col("recent_gaps") == 0) & (F.col("bad_rows") == 0))


TICK_KEY = ("source", "instrument", "event_ts", "sequence", "last", "bid", "ask")


def tick_problems(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """(source, code, ticks): RETRANSMIT, OUT_OF_ORDER, SEQUENCE_REPEAT, SEQUENCE_GAP, CROSSED, LAST_OFF_MID in arrival order."""
    first = Window.partitionBy(*TICK_KEY).orderBy(arrival)
    rows = df.withColumn("__copy", F.row_number().over(first) > 1)
    by_arrival = Series(keys=("source", "instrument"), ts=arrival, step_ms=1)
    fresh = framed(rows.where("not __copy"), by_arrival, 1, 0, lambda w: {"__t": F.lag("event_ts").over(w), "__s": F.lag("sequence").over(w)})
    middle = (F.col("bid") + F.col("ask")) / 2
    codes = {
        "OUT_OF_ORDER": F.col("event_ts") < F.col("__t"),
        "SEQUENCE_REPEAT": F.col("sequence") <= F.col("__s"),
        "SEQUENCE_GAP": F.col("sequence") > F.col("__s") + 1,
        "CROSSED": F.col("bid") > F.col("ask"),
        "LAST_OFF_MID": F.abs(F.col("last") - middle) > 0.05 * middle,
    }
    marks = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items())), lambda x: x.isNotNull())
    out = fresh.select("source", F.explode(marks).alias("code")).unionByName(rows.where("__copy").select("source", F.lit("RETRANSMIT").alias("code")))
    return out.groupBy("source", "code").agg(F.count("*").alias("ticks"))


def source_health(df: DataFrame, now_ms: int, stale_ms: int = 15_000) -> DataFrame:
    """Per source: its latest tick, age, and whether it is stale or in the future."""
    latest = df.groupBy("source", "source_role").agg(F.max("event_ts").alias("latest_ts"), F.count("*").alias("ticks"))
    age = F.lit(now_ms) - F.col("latest_ts")
    return latest.withColumn("age_ms", age).withColumn("stale", age > stale_ms).withColumn("future", age < 0).withColumn("healthy", ~(F.col("stale") | F.col("future")))


def missing_roles(health: DataFrame, required: list[str]) -> DataFrame:
    """Required roles without a healthy source."""
    want = health.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, required))).alias("source_role"))
    return want.join(health.where("healthy"), "source_role", "left_anti")


def split_ticks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the contract of a tick; bad rows carry the rules they break."""
    rules = {
        "received_before_event": F.col("received_ts") < F.col("event_ts"),
        "crossed": F.col("bid") > F.col("ask"),
        "nonpositive": F.least("last", "bid", "ask") <= 0,
        "no_time": F.col("event_ts").isNull(),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    rows = df.withColumn("broken", broken)
    return rows.where(F.size("broken") == 0).drop("broken"), rows.where(F.size("broken") > 0)


LABEL_PREFIXES = ("fwd_", "label_", "target_", "future_", "mfe", "mae", "tp_", "sl_", "barrier_", "exec_ret")
RAW_PRICES = frozenset(BAR_COLUMNS)


def is_label(name: str) -> bool:
    return name.startswith(LABEL_PREFIXES)


def model_features(df: DataFrame, exclude: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """Numeric columns that are no label, no raw price and not excluded."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and not is_label(f.name) and f.name not in RAW_PRICES and f.name not in exclude]


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop warm-up rows: those with a null in ``columns``."""
    return df.dropna(subset=columns)


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & finite(c)
    return df.where(keep)


def causal_window(bars: DataFrame, decisions: DataFrame, series: Series, at: str = "at_ms", rows: int = 3000) -> DataFrame:
    """For each decision the last ``rows`` bars at or before it.

    An equi-join on time blocks of ``rows`` steps with the block before, so no decision meets the whole series.
    Needs a series of one row a step at most.
    """
    span = rows * series.step_ms
    left = decisions.withColumn("__b", F.explode(F.array(F.floor(F.col(at) / span), F.floor(F.col(at) / span) - 1)))
    right = bars.withColumn("__b", F.floor(F.col(series.ts) / span))
    both = left.join(right, [*series.keys, "__b"]).where((F.col(series.ts) <= F.col(at)) & (F.col(series.ts) > F.col(at) - span))
    return both.drop("__b")


def sample_times(spark, end_ms: int, count: int, step_ms: int) -> DataFrame:
    """``count`` times, ``step_ms`` apart, the last at ``end_ms`` - ``step_ms``."""
    return spark.range(count).select((F.lit(end_ms) - (F.col("id") + 1) * step_ms).alias("at_ms"))


def non_overlapping(df: DataFrame, series: Series, horizon: int) -> DataFrame:
    """Every ``horizon``-th row of each series."""
    return with_row_index(df, series).where(F.col("row_idx") % horizon == 0).drop("row_idx")


def keyword_filter(df: DataFrame, column: str, keywords: list[str]) -> DataFrame:
    """Rows whose text contains any keyword, whatever its case."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.lower(column).contains(k.lower())
    return df.where(hit)
