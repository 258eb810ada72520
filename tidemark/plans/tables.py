"""The driver's tables as market data: line items as trades, orders as funding prints, events as ticks. SQL twins beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bars import trades_to_bars
from tidemark.operators.joins import as_of
from tidemark.plans.shared import write_table
from tidemark.spec import DAY, HOUR, Series, epoch_ms

DAILY = Series(step_ms=DAY, chunk=256)
HOURLY = Series(step_ms=HOUR, chunk=256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("x").alias("venue"),
        F.col("l_linestatus").alias("instrument"),
        epoch_ms("l_shipdate").alias("ts_ms"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("is_buyer_maker"),
    )


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular events: a funding rate and an open interest per order date and status."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("x").alias("venue"), F.col("o_orderstatus").alias("instrument"), epoch_ms("o_orderdate").alias("ts_ms"), (F.col("o_totalprice") / 1e8).alias("funding_rate"), F.col("o_totalprice").alias("open_interest"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_to_bars(trades(spark, sf_dir), DAILY, ["trade_id"])


def full_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with funding and open interest, written once: they are far fewer than trades and are read many times."""
    bars = write_table(daily_bars(spark, sf_dir), "bars")
    return write_table(as_of(bars, prints(spark, sf_dir), DAILY, ["funding_rate", "open_interest"]), "full-bars")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("x").alias("venue"), F.col("event_type").alias("instrument"), epoch_ms("ts").alias("ts_ms"), F.col("event_id").alias("trade_id"), F.col("value").alias("price"), (F.col("user_id") % 7 + 1).cast("double").alias("quantity"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"), "user_id", "props")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_to_bars(ticks(spark, sf_dir), HOURLY, ["trade_id"])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts long: results that compare."""
    kinds = {f.name: f.dataType for f in df.schema}

    def one(c):
        if isinstance(kinds[c], T.DoubleType):
            return (F.round(c, digits) + F.lit(0.0)).alias(c)  # no negative zero
        return F.col(c).cast("long").alias(c) if isinstance(kinds[c], (T.IntegerType, T.ShortType, T.ByteType)) else F.col(c)

    return df.select(*map(one, df.columns))


TRADES_SQL = """trades AS (
  SELECT 'x' AS venue, l_linestatus AS instrument, epoch_ms(l_shipdate) AS ts_ms, l_orderkey * 10 + l_linenumber AS trade_id,
         l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_returnflag = 'R' AS is_buyer_maker FROM lineitem)"""
BARS_SQL = (
    TRADES_SQL
    + """, bars AS (
  SELECT venue, instrument, ts_ms - ts_ms % 86400000 AS ts_ms, first(price ORDER BY ts_ms, trade_id) AS open, max(price) AS high,
         min(price) AS low, last(price ORDER BY ts_ms, trade_id) AS close, sum(quantity) AS volume, count(*) AS trade_count
  FROM trades GROUP BY ALL)"""
)
PRINTS_SQL = """prints AS (
  SELECT 'x' AS venue, o_orderstatus AS instrument, epoch_ms(o_orderdate) AS ts_ms, max(o_totalprice / 1e8) AS funding_rate,
         max(o_totalprice) AS open_interest FROM orders GROUP BY ALL)"""
FULL_SQL = (
    BARS_SQL
    + ", "
    + PRINTS_SQL
    + """, full_bars AS (
  SELECT b.*, p.funding_rate, p.open_interest FROM bars b
  ASOF LEFT JOIN prints p ON b.venue = p.venue AND b.instrument = p.instrument AND b.ts_ms >= p.ts_ms)"""
)
TICKS_SQL = """ticks AS (
  SELECT 'x' AS venue, event_type AS instrument, epoch_us(ts) // 1000 AS ts_ms, event_id AS trade_id, value AS price,
         (user_id % 7 + 1)::DOUBLE AS quantity, user_id % 2 = 0 AS is_buyer_maker, user_id, props FROM events)"""
HOURLY_SQL = (
    TICKS_SQL
    + """, hours AS (
  SELECT venue, instrument, ts_ms - ts_ms % 3600000 AS ts_ms, first(price ORDER BY ts_ms, trade_id) AS open, max(price) AS high,
         min(price) AS low, last(price ORDER BY ts_ms, trade_id) AS close, sum(quantity) AS volume, count(*) AS trade_count
  FROM ticks GROUP BY ALL)"""
)


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)
