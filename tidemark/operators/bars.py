"""Trades to bars, bars to longer bars, flow bars, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import bucket
from tidemark.plans.quantiles import with_quantiles
from tidemark.spec import Series

STEPS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "4h": 14_400_000}


def trades_to_bars(trades: DataFrame, series: Series, order: list[str], price: str = "price", quantity: str = "quantity") -> DataFrame:
    """OHLCV per step; ``order`` breaks ties of time, so open and close do not depend on the shuffle."""
    at = F.struct(series.ts, *order)
    return trades.groupBy(*series.keys, bucket(series.ts, series.step_ms).alias("__bar")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum(quantity).alias("volume"),
        F.count("*").alias("trade_count"),
    ).withColumnRenamed("__bar", series.ts)


def roll_up(bars: DataFrame, series: Series, steps: dict[str, int] | None = None) -> DataFrame:
    """Bars of several longer steps at once: frame, bucket start, OHLC, sum of volume, last funding and OI, bar count, complete."""
    steps = steps or STEPS
    frames = F.array(*(F.struct(F.lit(k).alias("frame"), F.lit(ms).cast("long").alias("step")) for k, ms in steps.items()))
    rows = bars.withColumn("__f", F.explode(frames)).withColumn("bucket_ms", F.col(series.ts) - F.pmod(F.col(series.ts), F.col("__f.step")))
    ts = F.col(series.ts)
    out = rows.groupBy(*series.keys, F.col("__f.frame").alias("frame"), F.col("__f.step").alias("step_ms"), "bucket_ms").agg(
        F.min_by("open", ts).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"),
        F.max_by("funding_rate", ts).alias("funding_rate"),
        F.max_by("open_interest", ts).alias("open_interest"),
        F.count("*").alias("bars"),
        F.max(ts).alias("last_ms"),
    )
    return out.withColumn("complete", F.col("bars") == F.floor(F.col("step_ms") / series.step_ms)).drop("step_ms")


def complete_buckets(rolled: DataFrame, series: Series, as_of_ms: int | None = None) -> DataFrame:
    """Buckets with every bar, closed at ``as_of_ms`` where it is given."""
    out = rolled.where("complete")
    return out if as_of_ms is None else out.where(F.col("last_ms") + series.step_ms <= as_of_ms)


def large_threshold(trades: DataFrame, series: Series, q: float = 0.99, scope: str = "trailing_day", notional: Column | None = None) -> DataFrame:
    """(keys, day, threshold) of trade size in money: of the day before by default, or over all days for each day."""
    value = notional if notional is not None else F.col("price") * F.col("quantity")
    day = F.floor(F.col(series.ts) / 86_400_000).cast("long")
    rows = trades.select(*series.keys, day.alias("day"), value.alias("v"))
    if scope == "global":
        limit = rows.groupBy(*series.keys).agg(F.percentile_approx("v", q, 10_000).alias("threshold"))
        return rows.select(*series.keys, "day").distinct().join(limit, list(series.keys))
    return rows.groupBy(*series.keys, "day").agg(F.percentile_approx("v", q, 10_000).alias("threshold")).withColumn("day", F.col("day") + 1)


def flow_bars(trades: DataFrame, series: Series, thresholds: DataFrame | None = None, exact_median: bool = True) -> DataFrame:
    """Per step: buy and sell volume and money by aggressor, trades, size sum and median, money in large trades."""
    price, qty = F.col("price"), F.col("quantity")
    rows = trades.withColumn("day", F.floor(F.col(series.ts) / 86_400_000).cast("long"))
    rows = rows.join(thresholds, [*series.keys, "day"], "left") if thresholds is not None else rows.withColumn("threshold", F.lit(None).cast("double"))
    buy = ~F.col("is_buyer_maker")
    money = price * qty
    median = F.percentile(qty, 0.5) if exact_median else F.percentile_approx(qty, 0.5)
    side = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    return rows.groupBy(*series.keys, bucket(series.ts, series.step_ms).alias("__bar")).agg(
        side(buy, qty).alias("buy_volume"),
        side(~buy, qty).alias("sell_volume"),
        side(buy, money).alias("buy_notional"),
        side(~buy, money).alias("sell_notional"),
        F.count("*").alias("trade_count"),
        F.sum(qty).alias("sum_trade_size"),
        median.alias("median_trade_size"),
        F.sum(F.when(money >= F.col("threshold"), money).otherwise(0.0)).alias("large_trade_notional"),
        F.sum(money).alias("total_notional"),
    ).withColumnRenamed("__bar", series.ts)


def aggressor_split(trades: DataFrame, keys: list[str]) -> DataFrame:
    buy = ~F.col("is_buyer_maker")
    return trades.groupBy(*keys).agg(F.sum(F.when(buy, F.col("quantity")).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(~buy, F.col("quantity")).otherwise(0.0)).alias("sell_volume"))


def distribution(df: DataFrame, value: Column, keys: list[str], exact: bool = True) -> DataFrame:
    """n, mean, median, sd, share positive and negative, 5/25/75/95 % of ``value`` per key."""
    points = [0.05, 0.25, 0.5, 0.75, 0.95]
    rows = df.select(*keys, value.alias("v")).where("v is not null and not isnan(v)")
    names = ["p05", "p25", "median", "p75", "p95"]
    share = lambda c: F.avg(c.cast("double"))
    stats = [F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), share(F.col("v") > 0).alias("p_pos"), share(F.col("v") < 0).alias("p_neg")]
    if not exact:
        out = rows.groupBy(*keys).agg(*stats, F.percentile_approx("v", points, 10_000).alias("__p"))
        return out.select(*keys, "n", "mean", "sd", "p_pos", "p_neg", *(F.get("__p", i).alias(n) for i, n in enumerate(names)))
    return with_quantiles(rows.groupBy(*keys).agg(*stats), rows, keys, {"v": F.col("v")}, {n: ("v", q) for n, q in zip(names, points, strict=True)})


def unpivoted(df: DataFrame, keep: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per row and column: several columns become one aggregation's groups."""
    pairs = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns))
    return df.select(*keep, F.explode(pairs).alias("__x")).select(*keep, f"__x.{name}", f"__x.{value}")


def tail_statistics(df: DataFrame, returns: list[str], keys: list[str], bps: list[int]) -> DataFrame:
    """Per key and horizon: n, mean, median, sd and the share of moves beyond each size, up and down."""
    rows = unpivoted(df, keys, returns, "horizon", "r").where("r is not null")
    tails = [F.avg((F.col("r") > k / 1e4).cast("double")).alias(f"p_up_{k}") for k in bps] + [F.avg((F.col("r") < -k / 1e4).cast("double")).alias(f"p_dn_{k}") for k in bps]
    out = rows.groupBy(*keys, "horizon").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), *tails)
    return with_quantiles(out, rows, [*keys, "horizon"], {"r": F.col("r")}, {"median": ("r", 0.5)})
