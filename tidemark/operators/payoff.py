"""Costs, payoffs, gates, trade selection and roll-ups. Longs pay positive funding; funding is rate times mark over entry."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.quantiles import with_quantiles
from tidemark.plans.series import block_scan, framed, with_row_index
from tidemark.plans.shared import write_table
from tidemark.spec import Series

FEE, SLIPPAGE = 0.0005, 0.0002
EIGHT_HOURS = 28_800_000
# Cost scenarios as (fee multiplier, extra slippage a side, cost of delay), and measured costs in bps.
STRESS = {
    "1x_base": (1.0, 0.0, 0.0),
    "2x_cost": (2.0, 0.0, 0.0),
    "3x_cost": (3.0, 0.0, 0.0),
    "increased_slippage": (1.0, 0.0005, 0.0),
    "execution_delay": (1.0, 0.0, 0.0002),
}
STUDY_COST_BPS, BARRIER_COST_BPS = 11.006, 15.0068


def round_trip_cost(fee_mult=1.0, extra_slippage=0.0, fee: float = FEE, slippage: float = SLIPPAGE):
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return 2 * (fee * lit(fee_mult) + slippage + lit(extra_slippage))


def stressed(df: DataFrame, stress: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """Each row under each cost scenario: an explode of literals, no join."""
    names = ("fee_mult", "extra_slippage", "delay_cost")
    rows = [F.struct(F.lit(k).alias("scenario"), *(F.lit(x).alias(n) for n, x in zip(names, v, strict=True))) for k, v in (stress or STRESS).items()]
    return df.withColumn("__s", F.explode(F.array(*rows))).select(*df.columns, "__s.*")


def components(entry: str = "entry", leave: str = "exit", side: str = "side", funding: str | Column = "funding", fee_mult=1.0, extra_slippage=0.0) -> dict[str, Column]:
    """Fills, gross, slippage, fees, funding cost and net of one trade, as fractions of the entry."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    s, e, x = F.col(side), F.col(entry), F.col(leave)
    slip = SLIPPAGE + lit(extra_slippage)
    fill_in, fill_out = e * (1 + s * slip), x * (1 - s * slip)
    raw = s * (x / e - 1)
    gross = s * (fill_out / fill_in - 1)
    fees = FEE * lit(fee_mult) * (1 + fill_out / fill_in)
    cost = s * (funding if isinstance(funding, Column) else F.col(funding))
    return {"fill_in": fill_in, "fill_out": fill_out, "raw": raw, "gross": gross, "slippage_cost": raw - gross, "fees": fees, "funding_cost": cost, "net": gross - fees - cost}


def funding_index(bars: DataFrame, series: Series) -> DataFrame:
    """Running sum of rate times mark over the bars at which funding is printed (its value changes), and their count."""
    rows = framed(bars, series, 1, 0, lambda w: {"__print": (F.col("funding_rate") != F.lag("funding_rate").over(w)).cast("int")})
    on = F.coalesce(F.col("__print"), F.lit(0))
    return block_scan(rows, series, {"funding_paid": on * F.col("funding_rate") * F.col("close"), "funding_prints": on}).drop("__print")


def funding_between(trades: DataFrame, index: DataFrame, series: Series, entry_ts: str = "entry_ts", exit_ts: str = "exit_ts") -> DataFrame:
    """Funding rate paid per unit of entry and the prints in (entry, exit], by the difference of running sums."""
    at = lambda name, ts: index.select(*series.keys, F.col(series.ts).alias(ts), F.col("funding_paid").alias(f"__p{name}"), F.col("funding_prints").alias(f"__n{name}"))
    rows = trades.join(at("0", entry_ts), [*series.keys, entry_ts], "left").join(at("1", exit_ts), [*series.keys, exit_ts], "left")
    return rows.withColumns({"funding": (F.col("__p1") - F.col("__p0")) / F.col("entry"), "n_prints": F.col("__n1") - F.col("__n0")}).drop("__p0", "__p1", "__n0", "__n1")


def expected_prints(entry_ts: Column, exit_ts: Column, every: int = EIGHT_HOURS) -> Column:
    """Settlement times in (entry, exit]."""
    return (F.floor(exit_ts / every) - F.floor(entry_ts / every)).cast("long")


def expected_value(p_tp: Column, p_sl: Column, p_timeout: Column, target: Column, stop: Column, timeout: Column, cost: Column) -> dict[str, Column]:
    """Gross and net expectation; null where the probabilities are no distribution."""
    ok = (F.least(p_tp, p_sl, p_timeout) >= 0) & (F.abs(p_tp + p_sl + p_timeout - 1) < 1e-6)
    gross = F.when(ok, p_tp * target - p_sl * stop + p_timeout * timeout)
    return {"ev_gross": gross, "ev_net": gross - cost}


#: Least net edge as a multiple of the cost, and what a prediction must hold before it may trade.
MIN_EDGE, RISK_FIELDS = 2.0, ("expected_downside", "favorable_excursion", "adverse_excursion", "uncertainty", "holding_minutes")


def economic_gate(df: DataFrame, fee_mult=1.0, extra_slippage=0.0, delay_cost=0.0, funding_rate=0.0, hold_bars: int = 15, min_edge: float = MIN_EDGE) -> DataFrame:
    """Costs, net edge, edge less the penalty for uncertainty, TRADE or NO_TRADE, and the conditions that failed.

    Columns: side (1 or -1), p_up, p_flat, p_down, expected_return, cost_other and RISK_FIELDS. The candidate's
    direction must be the likeliest of three, the adjusted edge ``min_edge`` times the cost at least, and every risk
    field present. Cost inputs are numbers or columns; the funding rate is per eight hours, bars are minutes.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    side = F.col("side")
    out = df.withColumns(
        {
            "expected_gross": side * F.col("expected_return"),
            "cost_fees": 2 * FEE * lit(fee_mult),
            "cost_slippage": 2 * (SLIPPAGE + lit(extra_slippage)),
            "cost_funding": lit(funding_rate) * (max(0, hold_bars) / 480.0),
            "cost_delay": lit(delay_cost),
        }
    )
    gross = F.col("expected_gross")
    cost = F.col("cost_fees") + F.col("cost_slippage") + F.col("cost_funding") + F.col("cost_delay") + F.coalesce(F.col("cost_other"), F.lit(0.0))
    out = out.withColumn("total_cost", cost).withColumn("expected_net_edge", gross - F.col("total_cost"))
    out = out.withColumn("uncertainty_penalty", F.coalesce(F.col("uncertainty"), F.lit(0.0)) * F.abs(gross))
    out = out.withColumn("adjusted_edge", F.col("expected_net_edge") - F.col("uncertainty_penalty"))
    own, other = F.when(side == 1, F.col("p_up")).otherwise(F.col("p_down")), F.when(side == 1, F.col("p_down")).otherwise(F.col("p_up"))
    complete = F.lit(True)
    for name in RISK_FIELDS:
        complete = complete & F.col(name).isNotNull()
    passed = {
        "direction": (own >= other) & (own >= F.col("p_flat")),
        "edge": F.col("uncertainty").isNotNull() & (F.col("adjusted_edge") >= min_edge * F.col("total_cost")),
        "risk": complete,
    }
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in passed.items())), lambda x: x.isNotNull())
    return out.withColumn("reasons", failed).withColumn("trade_decision", F.when(F.size("reasons") == 0, "TRADE").otherwise("NO_TRADE"))


def stress_suite(df: DataFrame, **options) -> DataFrame:
    """The gate under every cost scenario."""
    return economic_gate(stressed(df), fee_mult=F.col("fee_mult"), extra_slippage=F.col("extra_slippage"), delay_cost=F.col("delay_cost"), **options)


def edge_summary(df: DataFrame, keys: list[str], edge: str = "edge", cost: float | None = None) -> DataFrame:
    c = F.lit(cost if cost is not None else 2 * (FEE + SLIPPAGE))
    e = F.abs(edge)
    out = df.groupBy(*keys).agg(F.count(edge).alias("n"), F.avg(e).alias("mean_abs_edge"), F.avg((e > c).cast("double")).alias("share_above_cost"), F.max(e).alias("max_abs_edge"))
    return with_quantiles(out, df, keys, {"e": e}, {"median_abs_edge": ("e", 0.5)})


def survival(train: DataFrame, outcome: str = "outcome", offset: str = "holding", longest: int = 60) -> DataFrame:
    """(outcome, offset, survival): share of an outcome's training trades that last beyond an offset."""
    counts = train.where(F.col(outcome).isNotNull()).groupBy(F.col(outcome).alias("outcome"), F.least(F.col(offset), F.lit(longest)).alias("offset")).count()
    grid = counts.select("outcome").distinct().withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(longest))))
    filled = grid.join(counts, ["outcome", "offset"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    w = Window.partitionBy("outcome").orderBy("offset")  # longest + 1 rows an outcome
    total = F.sum("count").over(Window.partitionBy("outcome"))
    return filled.withColumn("survival", 1 - F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).drop("count")


#: Rows of a block of chunks, and blocks that are joined to one: how choices are carried along a series.
BLOCK_ROWS, BLOCKS_JOINED = 16_384, 256


def select_non_overlapping(df: DataFrame, series: Series, eligible: str, horizon: int, block_rows: int = BLOCK_ROWS, joined: int = BLOCKS_JOINED) -> DataFrame:
    """Greedy choice of eligible rows at least ``horizon`` rows apart, earliest first; returns the chosen rows.

    A chunk of ``horizon`` rows holds one choice at most: the first eligible row at or after the place from which the
    choice before it frees the chunk. So a chunk is a map from that place to the place of its own choice, which is where
    the next chunk becomes free. Maps are composed over blocks of chunks and over runs of blocks, both in parallel; the
    few runs of a series are walked through in order, and their starts are handed down to blocks and chunks, where the
    choices are read off. Only eligible rows are moved, and nothing holds more than a run's maps.
    """
    rows = with_row_index(df, series).where(F.col(eligible))
    h = int(horizon)
    if h <= 1:
        return rows.drop("row_idx")
    keys = list(series.keys)
    per_block = max(16, min(512, block_rows // h))
    chunk = F.floor(F.col("row_idx") / h).cast("long")
    places = rows.select(*keys, chunk.alias("c"), (F.col("row_idx") % h).cast("int").alias("at")).groupBy(*keys, "c").agg(F.sort_array(F.collect_list("at")).alias("at"))  # ``horizon`` places at most
    chunks = places.select(*keys, "c", F.floor(F.col("c") / per_block).cast("long").alias("b"), _choices("at", h).alias("map"))
    blocks = chunks.groupBy(*keys, "b").agg(F.sort_array(F.collect_list(F.struct(F.col("c").alias("i"), "map"))).alias("steps"))
    blocks = write_table(blocks.withColumns({"map": _composed("steps", F.col("b") * per_block, per_block, h), "r": F.floor(F.col("b") / joined).cast("long")}), "choices")
    runs = blocks.groupBy(*keys, "r").agg(F.sort_array(F.collect_list(F.struct(F.col("b").alias("i"), "map"))).alias("steps"))
    runs = runs.withColumn("map", _composed("steps", F.col("r") * joined, joined, h))
    series_of = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("r").alias("i"), "map"))).alias("steps"))
    # the starts of runs, of blocks in a run, of chunks in a block
    at_runs = series_of.select(*keys, F.explode(_starts("steps", F.lit(0))).alias("x")).select(*keys, F.col("x.i").alias("r"), F.col("x.start").alias("start"))
    at_blocks = runs.join(at_runs, [*keys, "r"]).select(*keys, F.explode(_starts("steps", F.col("start"), F.col("r") * joined)).alias("x")).select(*keys, F.col("x.i").alias("b"), F.col("x.start").alias("start"))
    at_chunks = blocks.join(at_blocks, [*keys, "b"]).select(*keys, F.explode(_starts("steps", F.col("start"), F.col("b") * per_block)).alias("x"))
    picked = at_chunks.select(*keys, (F.col("x.i") * h + F.get("x.map", F.col("x.start"))).alias("row_idx"), F.get("x.map", F.col("x.start")).alias("__at")).where("__at >= 0").drop("__at")
    return rows.join(picked, [*keys, "row_idx"], "left_semi").drop("row_idx")


def _choices(at: str, h: int) -> Column:
    """For each place from 0 to h - 1 the first of the sorted places ``at`` that is not before it, or -1."""
    before = F.concat(F.array(F.lit(-1)), F.col(at))
    filled = F.flatten(F.transform(at, lambda p, i: F.array_repeat(p, p - F.get(before, i))))
    return F.concat(filled, F.array_repeat(F.lit(-1), h - 1 - F.element_at(F.col(at), -1)))


def _passed(step: Column, at: Column, place: Column) -> Column:
    """Where the step after ``step`` is free, if ``step`` is free from ``place`` on and the step before it was ``at - 1``.

    A step that is missing, as one without an eligible row is, frees the next one from its start.
    """
    free = F.get(step["map"], F.when(step["i"] == at, place).otherwise(F.lit(0)))
    return F.greatest(free, F.lit(0))


def _composed(steps: str, first: Column, n: int, h: int) -> Column:
    """The map of ``n`` steps from number ``first`` on, of which ``steps`` (i, map) are there."""
    start = lambda place: F.struct(first.cast("long").alias("i"), place.cast("int").alias("p"))
    walk = lambda acc, s: F.struct((s["i"] + 1).alias("i"), _passed(s, acc["i"], acc["p"]).alias("p"))
    end = lambda acc: F.when(acc["i"] == first + n, acc["p"]).otherwise(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda place: F.aggregate(steps, start(place), walk, end))


def _starts(steps: str, place: Column, first: Column | None = None) -> Column:
    """Each step with the place from which it is free: (i, map, start)."""
    first = F.col(steps)[0]["i"] if first is None else first
    kind = "array<struct<i: bigint, start: int>>"
    zero = F.struct(first.cast("long").alias("i"), place.cast("int").alias("p"), F.array().cast(kind).alias("out"))

    def walk(acc, s):
        free = F.when(s["i"] == acc["i"], acc["p"]).otherwise(F.lit(0))
        out = F.concat(acc["out"], F.array(F.struct(s["i"].alias("i"), free.alias("start"))))
        return F.struct((s["i"] + 1).alias("i"), _passed(s, acc["i"], acc["p"]).alias("p"), out.alias("out"))

    starts = F.aggregate(steps, zero, walk, lambda acc: acc["out"])
    return F.zip_with(steps, starts, lambda s, x: F.struct(s["i"].alias("i"), s["map"].alias("map"), x["start"].alias("start")))


def barrier_trades(touched: DataFrame, series: Series, side: int, horizon: int, chosen: str | None = None) -> DataFrame:
    """Trade rows of first-touch outcomes: exit level, holding and cost components (funding column optional)."""
    rows = touched.where(F.col("outcome").isNotNull())
    rows = rows.where(F.col(chosen)) if chosen else rows
    rows = rows.withColumns({"side": F.lit(side), "exit": F.col("entry") * (1 + side * F.col("realized"))})
    if "funding" not in rows.columns:
        rows = rows.withColumn("funding", F.lit(0.0))
    return rows.withColumns(components())


def best_side(long: Column, short: Column) -> dict[str, Column]:
    return {"best_net": F.greatest(long, short), "best_side": F.when(long >= short, 1).when(short > long, -1)}


def fixed_horizon_trades(df: DataFrame, series: Series, horizon: int, threshold: float, prediction: str = "prediction", delay: int = 0) -> DataFrame:
    """Gate by predicted size, de-overlap, then realized components at open[t+1] and open[t+h+1]."""
    rows = framed(df, series, 0, horizon + 2 + delay, lambda w: {"entry": F.lead("open", 1 + delay).over(w), "exit": F.lead("open", horizon + 1 + delay).over(w)})
    rows = rows.withColumns({"side": F.signum(prediction).cast("int"), "__go": (F.abs(F.col(prediction)) > threshold) & F.col("exit").isNotNull()})
    picked = select_non_overlapping(rows, series, "__go", horizon).drop("__go")
    if "funding" not in picked.columns:
        picked = picked.withColumn("funding", F.lit(0.0))
    return picked.withColumns(components())


def edge_gated_trades(df: DataFrame, series: Series, horizon: int, prediction: str = "prediction", uncertainty: str | None = None, min_edge: float = 2.0) -> DataFrame:
    """Fixed-horizon trades whose predicted net return is ``min_edge`` times the cost of a round trip with funding.

    The prediction is priced like the trade itself, with the rate visible at the decision (column funding, 0 if absent);
    with ``uncertainty`` that share of the predicted gross size is taken off first. Then as ``fixed_horizon_trades``.
    """
    rows = framed(df, series, 0, horizon + 2, lambda w: {"entry": F.lead("open", 1).over(w), "exit": F.lead("open", horizon + 1).over(w)})
    rows = rows if "funding" in rows.columns else rows.withColumn("funding", F.lit(0.0))
    rows = rows.withColumn("side", F.signum(prediction).cast("int"))
    rows = rows.withColumn("__aim", F.col("entry") * (1 + F.col("side") * F.abs(prediction)))
    aim = components(leave="__aim")
    penalty = F.coalesce(F.col(uncertainty), F.lit(0.0)) * F.abs(aim["gross"]) if uncertainty else F.lit(0.0)
    rows = rows.withColumns({"predicted_net": aim["net"], "adjusted_net": aim["net"] - penalty, "required_edge": min_edge * (round_trip_cost() + F.abs(aim["funding_cost"]))})
    go = (F.col("side") != 0) & (F.col("adjusted_net") >= F.col("required_edge")) & ~F.isnan("adjusted_net") & F.col("exit").isNotNull()
    return select_non_overlapping(rows.withColumn("__go", go), series, "__go", horizon).drop("__go", "__aim").withColumns(components())


def scorecard(study: DataFrame, cost_bps: float = STUDY_COST_BPS, least: int = 30) -> DataFrame:
    """Study rows with the signed gross edge, cost, net edge and viability in bps; the cost as a multiple of a positive edge."""
    gross = F.col("diff") * 1e4
    rows = study.where(F.col("diff").isNotNull() & (F.col("n") >= least))
    return rows.withColumns(
        {
            "gross_bps": gross,
            "cost_bps": F.lit(cost_bps),
            "net_bps": gross - cost_bps,
            "viable": gross - cost_bps > 0,
            "cost_multiple": F.when(gross > 0, cost_bps / gross),
        }
    )


def barrier_gate(p_target: Column, p_stop: Column, p_timeout: Column, target: Column, stop: Column, timeout_return: Column | None = None, cost_bps: float = BARRIER_COST_BPS) -> dict[str, Column]:
    """Expected gross and net of a target/stop bet in bps under a fixed cost, and whether it is worth taking."""
    timeout = F.lit(0.0) if timeout_return is None else timeout_return
    gross = (p_target * target - p_stop * stop + p_timeout * timeout) * 10_000
    return {"gross_bps": gross, "net_bps": gross - cost_bps, "eligible": gross - cost_bps > 0}


def required_probability(target: Column, stop: Column, cost: Column) -> Column:
    """P(target) at which a target/stop bet breaks even."""
    return F.try_divide(stop + cost, target + stop)


def book_walk(books: DataFrame, key: str, levels: str, notional: float) -> DataFrame:
    """Average fill of a market order of ``notional``: sizes taken level by level, and the share that is filled."""
    rows = books.select(key, F.posexplode(levels).alias("pos", "lv"))
    w = Window.partitionBy(key).orderBy("pos")  # a book's levels
    money = F.col("lv.price") * F.col("lv.size")
    before = F.coalesce(F.sum(money).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    taken = F.greatest(F.least(money, F.lit(notional) - before), F.lit(0.0))
    out = rows.withColumn("taken", taken).groupBy(key).agg(F.sum("taken").alias("filled"), F.sum(F.col("taken") / F.col("lv.price")).alias("size"))
    return out.select(key, F.try_divide(F.col("filled"), F.col("size")).alias("average_price"), (F.col("filled") / notional).alias("fill_share"))


def next_bar_fills(decisions: DataFrame, bars: DataFrame, series: Series) -> DataFrame:
    """Decisions (keys, ts, side) filled at the next open with slippage and fee."""
    nxt = framed(bars.select(*series.keys, series.ts, "open"), series, 0, 1, lambda w: {"__next": F.lead("open").over(w)})
    rows = decisions.join(nxt, [*series.keys, series.ts], "left")
    return rows.withColumns({"fill": F.col("__next") * (1 + F.col("side") * SLIPPAGE), "fee": F.col("__next") * FEE}).drop("__next", "open")


def equity_curve(trades: DataFrame, series: Series, net: str = "net") -> DataFrame:
    """Running profit, its peak (never below zero) and the drawdown, by block scans."""
    rows = block_scan(trades, series, {"equity": F.col(net)})
    rows = block_scan(rows, series, {"peak": F.col("equity")}, "max")
    return rows.withColumn("peak", F.greatest("peak", F.lit(0.0))).withColumn("drawdown", F.col("peak") - F.col("equity"))


def trade_metrics(trades: DataFrame, series: Series, net: str = "net") -> DataFrame:
    """Per series: count, win rate, expectancy, totals, per-trade Sharpe and Sortino, drawdown, profit factor."""
    curve = equity_curve(trades, series, net)
    n = F.col(net)
    down = F.sqrt(F.avg(F.least(n, F.lit(0.0)) * F.least(n, F.lit(0.0))))
    return curve.groupBy(*series.keys).agg(
        F.count("*").alias("n_trades"),
        F.avg((n > 0).cast("double")).alias("win_rate"),
        F.avg(n).alias("expectancy"),
        F.sum(n).alias("net_sum"),
        F.try_divide(F.avg(n), F.stddev_samp(n)).alias("sharpe_per_trade"),
        F.try_divide(F.avg(n), down).alias("sortino_per_trade"),
        F.max("drawdown").alias("max_drawdown"),
        F.try_divide(F.sum(F.when(n > 0, n).otherwise(0.0)), -F.sum(F.when(n < 0, n).otherwise(0.0))).alias("profit_factor"),
    )


def yearly(trades: DataFrame, series: Series, net: str = "net") -> DataFrame:
    """Per series and calendar year: trades, net, and the drawdown within the year."""
    rows = trades.withColumn("year", F.year(F.timestamp_millis(series.ts)))
    by = series.at(keys=(*series.keys, "year"))
    return equity_curve(rows, by, net).groupBy(*by.keys).agg(F.count("*").alias("n_trades"), F.sum(net).alias("net_sum"), F.max("drawdown").alias("max_drawdown"), F.min_by("equity", series.ts).alias("first_equity"), F.max_by("equity", series.ts).alias("last_equity"))


def candidate_levels(df: DataFrame, target_atr: float = 2.0, stop_atr: float = 1.0, least: float = 0.002, atr: str = "atr_14") -> DataFrame:
    """Target and stop fractions from ATR, never below ``least``."""
    fraction = F.col(atr) / F.col("close")
    return df.withColumns({"target_fraction": F.greatest(target_atr * fraction, F.lit(least)), "stop_fraction": F.greatest(stop_atr * fraction, F.lit(least / 2))})


def propose(df: DataFrame, entry_rules: dict[str, Column], exit_rules: dict[str, Column], position: str = "position") -> DataFrame:
    """action (ENTER, EXIT, HOLD) and the names of the rules that say so; entry needs all of its rules, exit any."""
    against = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in entry_rules.items())), lambda x: x.isNotNull())
    leave = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in exit_rules.items())), lambda x: x.isNotNull())
    rows = df.withColumns({"__against": against, "__leave": leave})
    flat = F.col(position) == 0
    action = F.when(flat & (F.size("__against") == 0), "ENTER").when(~flat & (F.size("__leave") > 0), "EXIT").otherwise("HOLD")
    return rows.withColumn("action", action).withColumn("reasons", F.when(flat, F.col("__against")).otherwise(F.col("__leave"))).drop("__against", "__leave")


@dataclass(frozen=True)
class Limits:
    """Limits and cost assumptions of sizing; money in account currency, spreads and costs in bps."""

    position_notional: float = 300_000.0
    leverage: float = 3.0
    capital_at_risk: float = 1_000.0
    risk_per_trade_pct: float = 1.0
    trade_loss: float = 1_000.0
    spread_bps: float = 10.0
    slippage_bps: float = 10.0
    liquidity_notional: float = 10_000.0
    fee_bps_per_side: float = 5.0
    fee_multiplier: float = 1.0
    slippage_bps_per_side: float = 2.0
    latency_bps: float = 1.0


def sized(df: DataFrame, capital: float, limits: Limits = Limits()) -> DataFrame:
    """Quantity, notional and largest loss of each proposal, and the limits that reject it (quantity 0 then).

    Columns: side (1 or -1), entry, stop, max_holding_seconds, funding, spread and slippage (fractions, null allowed),
    top_notional. The loss of a unit is the distance to the stop, the round trip's cost and the funding that is paid;
    quantity is the least of capital at risk and largest trade loss over it, and of the notional cap over the entry.
    """
    entry, side = F.col("entry"), F.col("side")
    distance = F.abs(entry - F.col("stop"))
    notional_cap = min(limits.position_notional, capital * limits.leverage)
    risk_cap = min(limits.capital_at_risk, capital * limits.risk_per_trade_pct / 100)
    trip = entry * (2 * limits.fee_bps_per_side * limits.fee_multiplier + 2 * limits.slippage_bps_per_side + limits.latency_bps) / 10_000
    adverse = F.greatest(F.lit(0.0), side * F.coalesce(F.col("funding"), F.lit(0.0)))
    paid = entry * adverse * F.col("max_holding_seconds") / (EIGHT_HOURS / 1000)
    rows = df.withColumn("loss_per_unit", distance + trip + paid)
    loss = F.col("loss_per_unit")
    quantity = F.least(F.try_divide(F.lit(risk_cap), loss), F.try_divide(F.lit(limits.trade_loss), loss), F.try_divide(F.lit(notional_cap), entry))
    slip = F.coalesce(F.col("slippage") * 10_000, F.lit(limits.slippage_bps_per_side))
    rules = {
        "spread_limit": F.col("spread") * 10_000 > limits.spread_bps,
        "slippage_limit": slip > limits.slippage_bps,
        "missing_liquidity_data": F.col("top_notional").isNull(),
        "minimum_liquidity": F.col("top_notional") < limits.liquidity_notional,
        "invalid_stop_distance": ~F.coalesce(distance > 0, F.lit(False)),
        "risk_size_zero": ~F.coalesce(quantity > 0, F.lit(False)),
    }
    rows = rows.withColumn("reasons", F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull()))
    rows = rows.withColumn("quantity", F.when(F.size("reasons") == 0, quantity).otherwise(0.0))
    return rows.withColumns({"notional": F.col("quantity") * entry, "maximum_loss": F.col("quantity") * loss})


def exposure(fills: DataFrame, keys: list[str], capital: float) -> DataFrame:
    """Per key: share of rows with an open position, fills, and turnover (money of all fills over the capital).

    Columns: position after the row, fill_quantity (null or 0 where nothing was filled), fill_price.
    """
    money = F.abs(F.col("fill_quantity") * F.col("fill_price"))
    return fills.groupBy(*keys).agg(
        F.avg((F.col("position") != 0).cast("double")).alias("exposure"),
        F.count_if(F.col("fill_quantity") != 0).alias("fills"),
        (F.coalesce(F.sum(money), F.lit(0.0)) / capital).alias("turnover"),
    )


def order_rates(orders: DataFrame, keys: list[str], ts: str = "ts_ms", window_ms: int = 60_000, most: int = 10, cooldown_ms: int = 300_000, bucket_ms: int = 3_600_000) -> DataFrame:
    """Orders in the trailing window, and whether rate or cooldown after the last exit forbids this one.

    An order counts from its time until ``window_ms`` after it: it is added there and taken away behind, so that a running
    sum is what lies in the window, in as many steps as there are orders. A window covers one time bucket of a key; what the
    buckets before leave is a scan over one row a bucket. An order without a time counts those without one.
    """
    width = max(bucket_ms, window_ms)
    bucket = F.floor(F.col(ts) / width).cast("long")
    exit_ts = F.when(F.col("kind") == "EXIT", F.col(ts))
    place = lambda at, change: F.struct(at.alias("__time"), F.floor(at / width).cast("long").alias("__bucket"), F.lit(change).cast("long").alias("__change"))
    changes = F.filter(F.array(place(F.col(ts), 1), place(F.col(ts) + (window_ms + 1), -1)), lambda c: (c["__change"] > 0) | c["__time"].isNotNull())
    own = F.col("__change") > 0
    # what is taken away needs no columns but the keys
    carried = [c for c in orders.columns if c not in keys]
    rows = orders.select(*keys, F.struct(*carried).alias("__order"), exit_ts.alias("__exit"), F.explode(changes).alias("__c")).select(*keys, F.when(F.col("__c.__change") > 0, F.col("__order")).alias("__order"), F.when(F.col("__c.__change") > 0, F.col("__exit")).alias("__exit"), "__c.*")
    w = Window.partitionBy(*keys, "__bucket").orderBy("__time")
    totals = rows.groupBy(*keys, "__bucket").agg(F.max("__exit").alias("__exit"), F.sum("__change").alias("__change"))
    rows = rows.withColumn("recent_orders", F.sum("__change").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("last_exit_ts", F.max("__exit").over(w.rangeBetween(Window.unboundedPreceding, -1)))
    rows = rows.where(own).select(*keys, "__order.*", "__bucket", "recent_orders", "last_exit_ts")
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    dated = F.when(F.col("__bucket").isNotNull(), F.col("__change"))
    exits = totals.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col("__bucket").alias("__at"), F.max("__exit").over(before).alias("__carry"), F.sum(dated).over(before).alias("__open"))
    same = F.col("__bucket").eqNullSafe(F.col("__at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    rows = rows.join(exits, same).withColumns({"last_exit_ts": F.coalesce("last_exit_ts", "__carry"), "recent_orders": F.col("recent_orders") + F.coalesce("__open", F.lit(0))})
    rows = rows.drop("__bucket", "__at", "__carry", "__open", *(f"__key_{k}" for k in keys))
    return rows.select(*orders.columns, "recent_orders", "last_exit_ts").withColumns({"rate_limited": F.col("recent_orders") > most, "cooling_down": F.coalesce(F.col(ts) - F.col("last_exit_ts") < cooldown_ms, F.lit(False))})


def cost_decomposition(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of the parts of a trade and cost as a multiple of gross size."""
    parts = {
        "gross": F.abs("gross"),
        "fees": F.col("fees"),
        "slippage": F.col("slippage_cost"),
        "funding": F.col("funding_cost"),
        "cost_multiple": F.try_divide(F.col("fees") + F.col("slippage_cost"), F.abs("gross")),
    }
    return with_quantiles(trades.groupBy(*keys).agg(F.count("*").alias("n")), trades, keys, parts, {k: (k, 0.5) for k in parts})


def empirical_friction(bars: DataFrame, series: Series) -> DataFrame:
    """Per series the median of |open[t+1] - close[t]| over close."""
    rows = framed(bars, series, 0, 1, lambda w: {"__f": F.abs(F.lead("open").over(w) - F.col("close")) / F.col("close")})
    return with_quantiles(rows.groupBy(*series.keys).agg(F.count("__f").alias("n")), rows, list(series.keys), {"f": F.col("__f")}, {"friction": ("f", 0.5)})


def accounting_comparison(trades: DataFrame, keys: list[str], a: dict, b: dict) -> DataFrame:
    """Net of the same trades under two cost conventions and the difference."""
    one, two = components(**a)["net"], components(**b)["net"]
    return trades.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(one).alias("net_a"), F.sum(two).alias("net_b"), F.sum(one - two).alias("difference"))

