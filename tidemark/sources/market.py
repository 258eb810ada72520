"""Landed market data to canonical tables, and sinks. Every reader has an explicit schema; nothing is inferred."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import fixed_point, to_epoch_ms
from tidemark.operators.joins import as_of
from tidemark.operators.quality import finalize_bars, keep_last
from tidemark.plans.series import framed
from tidemark.plans.shared import write_table
from tidemark.spec import DAY, Series

BARS = "venue string, instrument string, ts_ms long, open double, high double, low double, close double, volume double, funding_rate double, open_interest double"
TRADES = "venue string, instrument string, trade_id long, ts_ms long, price double, quantity double, notional double, is_buyer_maker boolean"
#: venue -> names of its fields for klines, funding and open interest
VENUES = {
    "a": {"funding_ts": "fundingTime", "funding_rate": "fundingRate", "oi_ts": "timestamp", "oi": "sumOpenInterest"},
    "b": {"funding_ts": "fundingRateTimestamp", "funding_rate": "fundingRate", "oi_ts": "timestamp", "oi": "openInterest"},
}


DAY_COLUMN = "trade_date"


def _days(df: DataFrame, start_ms: int | None, end_ms: int | None, ts: str = "ts_ms") -> DataFrame:
    """Rows in [start, end): by time, which reaches the files, and by day, which leaves out the other days' folders."""
    day = lambda ms: F.lit(dt.datetime.fromtimestamp(ms / 1000, dt.UTC).date())
    if start_ms is not None:
        df = df.where((F.col(ts) >= start_ms) & (F.col(DAY_COLUMN) >= day(start_ms)))
    return df if end_ms is None else df.where((F.col(ts) < end_ms) & (F.col(DAY_COLUMN) <= day(end_ms - 1)))


def read_bars(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None, schema: str = BARS) -> DataFrame:
    """Bars in [start, end) of a store partitioned by trade_date: folders of other days are neither listed nor read.

    Days that are not there give no rows. The table is not sorted; operators order what they need.
    """
    return _days(spark.read.schema(f"{schema}, {DAY_COLUMN} date").parquet(path), start_ms, end_ms).drop(DAY_COLUMN)


def with_oi_change(bars: DataFrame, series: Series) -> DataFrame:
    return framed(bars, series, 1, 0, lambda w: {"open_interest_change": F.col("open_interest") - F.lag("open_interest").over(w)})


def read_trades(spark: SparkSession, path: str, start_date: str, end_date: str) -> DataFrame:
    """Trades of the days in [start, end) of a store partitioned by trade_date: other days are not listed or read."""
    return spark.read.schema(f"{TRADES}, trade_date date").parquet(path).where((F.col("trade_date") >= F.lit(start_date).cast("date")) & (F.col("trade_date") < F.lit(end_date).cast("date")))


def write_partitioned(df: DataFrame, path: str, ts: str = "ts_ms", name: str = DAY_COLUMN) -> None:
    """Overwrite only the days that ``df`` holds, four files a day at most."""
    rows = df.withColumn(name, F.to_date(F.timestamp_millis(ts)))
    rows.repartition(name, F.pmod(F.xxhash64(ts), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def replace_stored_range(spark: SparkSession, path: str, fresh: DataFrame, start_ms: int, end_ms: int, ts: str = "ts_ms") -> None:
    """Put ``fresh`` in place of all rows of a partitioned store in [start, end); the same however often it runs.

    Only the days that the range touches are read and written. What a first or last day holds outside the range stays;
    a day left without rows is removed, one folder each.
    """
    schema = spark.read.parquet(path).drop(DAY_COLUMN).schema
    stored = _days(spark.read.parquet(path), start_ms - start_ms % DAY, end_ms + (-end_ms) % DAY, ts)
    outside = stored.where((F.col(ts) < start_ms) | (F.col(ts) >= end_ms)).drop(DAY_COLUMN)
    inside = fresh.where((F.col(ts) >= start_ms) & (F.col(ts) < end_ms))
    rows = write_table(outside.unionByName(inside.select(*(F.col(f.name).cast(f.dataType) for f in schema))), "replaced")
    before = {r[0] for r in stored.select(DAY_COLUMN).distinct().collect()}  # days of the range
    after = {r[0] for r in rows.select(F.to_date(F.timestamp_millis(ts))).distinct().collect()}
    if after:
        write_partitioned(rows, path, ts)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for day in sorted(before - after):
        folder = hadoop.Path(f"{path.rstrip('/')}/{DAY_COLUMN}={day}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def kline_pages(pages: DataFrame, payload: str, keys: dict[str, str | Column], series: Series, start_ms: int, end_ms: int) -> DataFrame:
    """Bars from pages that are arrays of [open_time, open, high, low, close, volume, ...]; later pages win.

    ``keys`` holds the name of a venue or instrument, or the column of ``pages`` with each page's own.
    """
    row = F.explode(F.from_json(payload, "array<array<string>>"))
    rows = pages.select(*(F.lit(v).alias(k) for k, v in keys.items()), F.monotonically_increasing_id().alias("arrival"), row.alias("k"))
    names = ("open", "high", "low", "close", "volume")
    out = rows.select(*keys, F.get("k", 0).cast("long").alias(series.ts), *(F.get("k", i + 1).cast("double").alias(n) for i, n in enumerate(names)), "arrival")
    out = out.where((F.col(series.ts) >= start_ms) & (F.col(series.ts) < end_ms))
    return finalize_bars(out, series, ["arrival"])


def kline_csv(spark: SparkSession, path: str, keys: dict[str, str], series: Series) -> DataFrame:
    """Bars of archive CSV files (header rows fall out: their time is no number)."""
    schema = "t string, open string, high string, low string, close string, volume string, rest string"
    rows = spark.read.schema(schema).csv(path, enforceSchema=True).where(F.col("t").try_cast("long").isNotNull())
    return finalize_bars(rows.select(*(F.lit(v).alias(k) for k, v in keys.items()), F.col("t").cast("long").alias(series.ts), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume"))), series)


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of every file in zip archives: one archive a task, whatever the file system."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            block = []
                            for raw in f:
                                block.append(raw.decode().rstrip("\r\n"))
                                if len(block) >= 10_000:
                                    yield pd.DataFrame({"path": p, "line": block})
                                    block = []
                            yield pd.DataFrame({"path": p, "line": block})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "path string, line string")


def funding_events(pages: DataFrame, payload: str, keys: dict[str, str], series: Series, venue: str = "a") -> DataFrame:
    """(keys, ts, funding_rate) from pages of funding objects, in text or numbers."""
    names = VENUES[venue]
    schema = f"array<struct<{names['funding_ts']}: string, {names['funding_rate']}: string>>"
    rows = pages.select(F.monotonically_increasing_id().alias("arrival"), F.explode(F.from_json(payload, schema)).alias("x"))
    out = rows.select(*(F.lit(v).alias(k) for k, v in keys.items()), to_epoch_ms(F.col(f"x.{names['funding_ts']}")).alias(series.ts), fixed_point(F.col(f"x.{names['funding_rate']}")).alias("funding_rate"), "arrival")
    return keep_last(out.dropna(subset=[series.ts, "funding_rate"]), [*series.keys, series.ts], ["arrival"]).drop("arrival")


def interest_events(rows: DataFrame, keys: dict[str, str], series: Series) -> DataFrame:
    """(keys, ts, open_interest) from tables whose time column is timestamp, create_time or datetime, text or number."""
    times = [c for c in ("timestamp", "create_time", "datetime") if c in rows.columns]
    if not times:
        raise ValueError("no time column")
    value = next(c for c in ("sum_open_interest", "sumOpenInterest", "open_interest", "openInterest") if c in rows.columns)
    ts = F.coalesce(*(to_epoch_ms(c) for c in times))
    out = rows.select(*(F.lit(v).alias(k) for k, v in keys.items()), ts.alias(series.ts), fixed_point(value).alias("open_interest")).dropna(subset=[series.ts, "open_interest"])
    return out.groupBy(*series.keys, series.ts).agg(F.max("open_interest").alias("open_interest"))


def build_bars(archive: DataFrame, api: DataFrame, funding: DataFrame, interest: DataFrame, series: Series) -> DataFrame:
    """Archive bars, API bars where the archive has none, then funding and open interest as of each bar."""
    rows = archive.withColumn("__p", F.lit(1)).unionByName(api.withColumn("__p", F.lit(0)), allowMissingColumns=True)
    bars = finalize_bars(rows, series, ["__p"]).drop("funding_rate", "open_interest")
    return as_of(as_of(bars, funding, series, ["funding_rate"]), interest, series, ["open_interest"])


def months(spark: SparkSession, start_ms: int, end_ms: int) -> DataFrame:
    """(year, month) of every calendar month that [start, end) touches."""
    at = lambda ms: F.trunc(F.to_date(F.timestamp_millis(F.lit(ms))), "MM")
    m = spark.range(1).select(F.explode(F.sequence(at(start_ms), at(end_ms - 1), F.expr("interval 1 month"))).alias("m"))
    return m.select(F.year("m").alias("year"), F.month("m").alias("month"))


MARKET_A = "struct<id: string, question: string, conditionId: string, outcomePrices: string, clobTokenIds: string, bestBid: string, bestAsk: string, volume: string, liquidity: string, endDate: string, bids: array<struct<price: string, size: string>>, asks: array<struct<price: string, size: string>>>"


def _book_depth(levels: str, n: int = 10) -> Column:
    return F.aggregate(F.slice(F.coalesce(F.col(levels), F.array().cast("array<struct<price: string, size: string>>")), 1, n), F.lit(0.0), lambda a, x: a + F.coalesce(fixed_point(x["size"]), F.lit(0.0)))


def snapshot_a(payloads: DataFrame, payload: str = "payload", fetched: str = "fetched_ms") -> DataFrame:
    """Prediction-market rows of the first venue: JSON in text inside JSON, top of book, depth of ten levels, mid and spread."""
    r = payloads.select(fetched, payload, F.from_json(payload, MARKET_A).alias("m")).select(fetched, payload, "m.*")
    prices = F.from_json("outcomePrices", "array<string>")
    bid, ask = fixed_point("bestBid"), fixed_point("bestAsk")
    yes = F.coalesce(fixed_point(F.get(prices, 0)), (bid + ask) / 2)
    out = r.select(
        F.lit("a").alias("platform"),
        F.coalesce("id", "conditionId").alias("market_id"),
        "question",
        F.get(F.from_json("clobTokenIds", "array<string>"), 0).alias("token_id"),
        yes.alias("yes_price"),
        F.coalesce(fixed_point(F.get(prices, 1)), 1 - yes).alias("no_price"),
        bid.alias("bid"),
        ask.alias("ask"),
        F.coalesce((bid + ask) / 2, yes).alias("mid"),
        (ask - bid).alias("spread"),
        fixed_point("volume").alias("volume"),
        fixed_point("liquidity").alias("liquidity"),
        _book_depth("bids").alias("bid_depth"),
        _book_depth("asks").alias("ask_depth"),
        to_epoch_ms("endDate").alias("end_ms"),
        F.col(fetched).alias("ts_ms"),
        F.when(F.coalesce("id", "conditionId").isNull(), F.col(payload)).alias("bad"),
    )
    return out


MARKET_B = "struct<ticker: string, title: string, yes_bid: string, yes_ask: string, last_price: string, volume: string, liquidity: string, notional_value: string, close_time: string>"


def snapshot_b(payloads: DataFrame, payload: str = "payload", fetched: str = "fetched_ms") -> DataFrame:
    """The second venue: prices in cents, contracts times notional."""
    r = payloads.select(fetched, payload, F.from_json(payload, MARKET_B).alias("m")).select(fetched, payload, "m.*")
    cents = lambda c: fixed_point(c) / 100
    bid, ask, last = cents("yes_bid"), cents("yes_ask"), cents("last_price")
    notional = F.coalesce(fixed_point("notional_value") / 100, F.lit(1.0))
    yes = F.coalesce((bid + ask) / 2, last)
    return r.select(
        F.lit("b").alias("platform"), F.col("ticker").alias("market_id"), F.col("title").alias("question"), F.lit(None).cast("string").alias("token_id"),
        yes.alias("yes_price"), (1 - yes).alias("no_price"), bid.alias("bid"), ask.alias("ask"), yes.alias("mid"), (ask - bid).alias("spread"),
        (fixed_point("volume") * notional).alias("volume"), (fixed_point("liquidity") / 100).alias("liquidity"), F.lit(0.0).alias("bid_depth"), F.lit(0.0).alias("ask_depth"),
        to_epoch_ms("close_time").alias("end_ms"), F.col(fetched).alias("ts_ms"), F.when(F.col("ticker").isNull(), F.col(payload)).alias("bad"),
    )


def snapshot_table(*snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(latest row per market, newest first; quarantined payloads)."""
    rows = snapshots[0]
    for s in snapshots[1:]:
        rows = rows.unionByName(s)
    good = keep_last(rows.where("bad is null").drop("bad"), ["platform", "market_id"], ["ts_ms"]).orderBy(F.desc("ts_ms"), "platform", "market_id")
    return good, rows.where("bad is not null").select("platform", "ts_ms", "bad")


def probability_bars(history: DataFrame, once: bool = True) -> DataFrame:
    """(platform, market_id, ts_ms, OHLC of the YES probability): missing open, high and low are the close.

    The last arrival of a time wins; without ``once`` every point is a bar.
    """
    c = F.coalesce(fixed_point("close"), fixed_point("price"))
    o, h, low = (F.coalesce(fixed_point(x), c) for x in ("open", "high", "low"))
    rows = history.select("platform", "market_id", to_epoch_ms("t").alias("ts_ms"), o.alias("open"), F.greatest(h, o, c).alias("high"), F.least(low, o, c).alias("low"), c.alias("close"), "arrival")
    rows = rows.where("ts_ms is not null and close is not null")
    return (keep_last(rows, ["platform", "market_id", "ts_ms"], ["arrival"]) if once else rows).drop("arrival")


def replace_range(existing: DataFrame, fresh: DataFrame, series: Series, start_ms: int, end_ms: int) -> DataFrame:
    """Rows outside [start, end) as they are, inside only the fresh ones: the same however often it runs."""
    ts = F.col(series.ts)
    inside = (ts >= start_ms) & (ts < end_ms)
    return existing.where(~inside).unionByName(fresh.where(inside), allowMissingColumns=True)


def merge_bars(existing: DataFrame, fresh: DataFrame, series: Series) -> DataFrame:
    """Append; for equal times the fresh row stays."""
    rows = existing.withColumn("__p", F.lit(0)).unionByName(fresh.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return keep_last(rows, [*series.keys, series.ts], ["__p"]).drop("__p")


RAW_NAMES = {"a": "trade_id", "agg_trade_id": "trade_id", "p": "price", "q": "quantity", "qty": "quantity", "T": "ts_ms", "transact_time": "ts_ms", "trade_timestamp": "ts_ms", "m": "is_buyer_maker"}


def normalize_trades(raw: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Archive or API columns to the trade schema; money is price times quantity."""
    renamed = raw.select(*(F.col(c).alias(RAW_NAMES.get(c, c)) for c in raw.columns))
    price, qty = F.col("price").cast("double"), F.col("quantity").cast("double")
    return renamed.select(*(F.lit(v).alias(k) for k, v in keys.items()), F.col("trade_id").cast("long"), F.col("ts_ms").cast("long"), price.alias("price"), qty.alias("quantity"), (price * qty).alias("notional"), F.col("is_buyer_maker").cast("boolean"))


EXPORT = {"ts_ms": "Timestamp", "open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume", "funding_rate": "FundingRate", "open_interest": "OpenInterest"}


def backtest_columns(bars: DataFrame) -> DataFrame:
    """Capitalized columns; one that is not there, or null, is 0.0."""
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in bars.columns else F.lit(0.0)
    return bars.select(*(F.col(c).alias(n) if c == "ts_ms" else value(c).alias(n) for c, n in EXPORT.items()))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a log whose lines carry their number in the field ``seq``."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.select(F.get_json_object("line", "$.seq").cast("long").alias("seq"), "line")


def composite(streams: dict[str, DataFrame], primary: str) -> DataFrame:
    """Ticks of all venues with their role; only the primary venue's make bars."""
    out = None
    for name, df in streams.items():
        part = df.withColumn("source_role", F.lit("primary" if name == primary else "secondary"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


