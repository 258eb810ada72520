"""Point-in-time, range, spine and reconciliation joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.series import block_scan
from tidemark.spec import Series


def as_of(bars: DataFrame, events: DataFrame, series: Series, values: list[str], event_ts: str = "ts_ms") -> DataFrame:
    """Each bar with the latest event at or before it; ``values`` are columns of ``events``. Leading bars stay null.

    Both sides are laid together in time (events first at equal times) and the last event is carried forward by a
    block scan, across blocks without any event as well. Every value keeps its own last non-null event.
    """
    tie = "__bar"
    left = bars.withColumn(tie, F.lit(1))
    right = events.groupBy(*series.keys, F.col(event_ts).alias(series.ts)).agg(*(F.max(v).alias(v) for v in values)).withColumn(tie, F.lit(0))
    rows = left.select(*bars.columns, tie, *(F.lit(None).cast(events.schema[v].dataType).alias(f"__e_{v}") for v in values)).unionByName(
        right.select(*series.keys, series.ts, tie, *(F.col(v).alias(f"__e_{v}") for v in values)), allowMissingColumns=True
    )
    # a doubled clock puts events before bars of the same time
    clock = rows.withColumn("__clock", F.col(series.ts) * 2 + F.col(tie))
    scanned = block_scan(clock, series.at(ts="__clock", step_ms=2 * series.step_ms), {v: F.col(f"__e_{v}") for v in values}, "last")
    return scanned.where(F.col(tie) == 1).select(*bars.columns, *values)


def spine_join(spine: DataFrame, flow: DataFrame, series: Series, zero: list[str]) -> DataFrame:
    """Bars with flow columns by time; ``zero`` columns are 0 where a bar had no trade."""
    out = spine.join(flow, [*series.keys, series.ts], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero})


def range_join(decisions: DataFrame, bars: DataFrame, series: Series, at: str, horizon: int) -> DataFrame:
    """Bars in (at, at + horizon steps] of each decision: an equi-join on time blocks, so work grows with the matches."""
    span = horizon * series.step_ms
    block = F.floor(F.col(at) / span)
    left = decisions.withColumn("__b", F.explode(F.array(block, block + 1)))
    right = bars.withColumn("__b", F.floor(F.col(series.ts) / span))
    inside = (F.col(series.ts) > F.col(at)) & (F.col(series.ts) <= F.col(at) + span)
    return left.join(right, [*series.keys, "__b"]).where(inside).drop("__b")


def observed_outcome(decisions: DataFrame, bars: DataFrame, series: Series, at: str, horizon: int) -> DataFrame:
    """Each decision (keys, at, side, price) with the last, best and worst close return after it, signed by side."""
    hits = range_join(decisions, bars.select(*series.keys, series.ts, "close"), series, at, horizon)
    ret = F.col("side") * (F.col("close") / F.col("price") - 1)
    keys = [*series.keys, at, "side", "price"]
    out = hits.groupBy(*keys).agg(F.count("*").alias("n_bars"), F.max_by(ret, series.ts).alias("last_return"), F.max(ret).alias("best_return"), F.min(ret).alias("worst_return"))
    return decisions.join(out, keys, "left")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status): matched, missing (left only) or extra (right only)."""
    a, b = left.select(F.col(key).alias("a")).distinct(), right.select(F.col(key).alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("matched")
    return both.select(F.coalesce("a", "b").alias(key), status.alias("status"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key ``parent`` does not have; null keys have no parent."""
    return child.join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(child_key) == F.col("__p"), "left_anti")


def state_at(trades: DataFrame, states: DataFrame, series: Series, columns: list[str]) -> DataFrame:
    """Trades with state columns of the row at their time."""
    return trades.join(states.select(*series.keys, series.ts, *columns), [*series.keys, series.ts], "left")


def paired(rows: DataFrame, key: str, arm: str, value: str, arms: tuple[str, str] = ("baseline", "treatment")) -> DataFrame:
    """(key, baseline, treatment, changed): one aggregation instead of a self join."""
    picks = [F.max(F.when(F.col(arm) == a, F.col(value))).alias(a) for a in arms]
    out = rows.groupBy(key).agg(*picks)
    return out.withColumn("changed", ~F.col(arms[0]).eqNullSafe(F.col(arms[1])))


def environment(bars: DataFrame, ticks: DataFrame, series: Series) -> DataFrame:
    """Latest tick at or before each bar's close, with mid, basis, imbalances and the price/OI relation.

    ``ticks``: keys, ts_ms, bid, ask, mark, index, bid_depth, ask_depth, buy_volume, sell_volume, tick_oi.
    """
    values = ["bid", "ask", "mark", "index", "bid_depth", "ask_depth", "buy_volume", "sell_volume", "tick_oi"]
    rows = as_of(bars, ticks, series, values)
    diff = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b))
    return rows.withColumns(
        {
            "mid": (F.col("bid") + F.col("ask")) / 2,
            "basis": F.try_divide(F.col("mark") - F.col("index"), F.col("index")),
            "flow_imbalance": diff("buy_volume", "sell_volume"),
            "depth_imbalance": diff("bid_depth", "ask_depth"),
            "top_notional": F.col("bid") * F.col("bid_depth") + F.col("ask") * F.col("ask_depth"),
        }
    )
