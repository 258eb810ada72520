"""Events, market states, and studies of what follows them, from counts and sums per group."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import EPS, two_sided_p
from tidemark.operators.bars import unpivoted
from tidemark.operators.features import change, zscore
from tidemark.plans.quantiles import with_quantiles
from tidemark.plans.series import framed
from tidemark.spec import Series


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


# Thresholds of the signals, the columns they are z-scores of, and the events.
SIGNAL_LIMITS = {
    "volume_zscore": 2.0,
    "volume_imbalance": 0.30,
    "oi_change_zscore": 2.0,
    "spread_zscore": 2.0,
    "depth_imbalance": 0.30,
    "return_zscore": 2.5,
}
ZSCORES = {"volume_zscore": "total_volume", "oi_change_zscore": "oi_change_pct", "spread_zscore": "bid_ask_spread_bps", "return_zscore": "close"}
IMBALANCES = {"volume_imbalance": "volume_imbalance_5m", "depth_imbalance": "top_level_imbalance"}
EVENTS = (
    "EVENT_VOLUME_SHOCK",
    "EVENT_FLOW_SHOCK",
    "EVENT_OI_SHOCK",
    "EVENT_SPREAD_SHOCK",
    "EVENT_BOOK_SHOCK",
    "EVENT_PRICE_SHOCK",
    "EVENT_FLOW_BREAKOUT",
    "EVENT_FLOW_REVERSAL",
    "EVENT_OI_PRICE_CONFIRMATION",
    "EVENT_OI_PRICE_DIVERGENCE",
)
INTENSITY = ("volume_imbalance", "depth_imbalance", "return_zscore", "oi_change_zscore")


def event_signals(df: DataFrame, series: Series, window: int = 288, least: int = 60) -> DataFrame:
    """z-scores, imbalances, return in bps, and an EVENT column for each signal whose inputs are there.

    Volume fires on the upper side alone, everything else on both. A flag is null where its z-score is (fewer than
    ``least`` rows). Columns that are absent make no flags.
    """
    z = {k: c for k, c in ZSCORES.items() if c in df.columns}
    rows = framed(
        df,
        series,
        window,
        0,
        lambda w: {k: zscore(F.col(c), w, window, least) for k, c in z.items()} | {"return_bps": change("close", 1, w) * 10_000},
    )
    rows = rows.withColumns({k: F.col(c) for k, c in IMBALANCES.items() if c in df.columns})
    limit, flow = SIGNAL_LIMITS, SIGNAL_LIMITS["volume_imbalance"]
    size = lambda k: F.abs(k) >= limit[k]
    flags = {
        "EVENT_VOLUME_SHOCK": ("volume_zscore", lambda: F.col("volume_zscore") >= limit["volume_zscore"]),
        "EVENT_FLOW_SHOCK": ("volume_imbalance", lambda: size("volume_imbalance")),
        "EVENT_OI_SHOCK": ("oi_change_zscore", lambda: size("oi_change_zscore")),
        "EVENT_SPREAD_SHOCK": ("spread_zscore", lambda: size("spread_zscore")),
        "EVENT_BOOK_SHOCK": ("depth_imbalance", lambda: size("depth_imbalance")),
        "EVENT_PRICE_SHOCK": ("return_zscore", lambda: size("return_zscore")),
        "EVENT_FLOW_BREAKOUT": ("volume_imbalance", lambda: (F.col("volume_imbalance") >= flow) & (F.col("return_bps") > 0)),
        "EVENT_FLOW_REVERSAL": ("volume_imbalance", lambda: (F.col("volume_imbalance") <= -flow) & (F.col("return_bps") > 0)),
        "EVENT_OI_PRICE_CONFIRMATION": ("price_up_oi_up", lambda: F.col("price_up_oi_up") == 1),
        "EVENT_OI_PRICE_DIVERGENCE": ("price_up_oi_down", lambda: F.col("price_up_oi_down") == 1),
    }
    return rows.withColumns({k: rule() for k, (needs, rule) in flags.items() if needs in rows.columns})


def available_events(df: DataFrame) -> list[str]:
    return [e for e in EVENTS if e in df.columns]


def extract_events(signals: DataFrame, series: Series, names: list[str] | None = None, direction: str | None = None) -> DataFrame:
    """(series, time, event, direction, intensity, features): every fired flag as a row, all events at once.

    intensity is the size of the first of INTENSITY that is not null, 0 where all are; direction is 0 where unknown.
    """
    names = available_events(signals) if names is None else names
    have = [F.col(c) for c in INTENSITY if c in signals.columns]
    intensity = F.abs(F.coalesce(*have, F.lit(0.0)))
    side = F.coalesce(F.col(direction).cast("int"), F.lit(0)) if direction else F.lit(0)
    shown = [c for c in ("volume_imbalance_5m", "oi_change_pct", "return_bps") if c in signals.columns]
    features = F.create_map(*[x for c in shown for x in (F.lit(c), F.col(c).cast("double"))]) if shown else F.create_map()
    fired = F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return signals.select(
        *series.keys,
        series.ts,
        F.explode(fired).alias("event"),
        side.alias("direction"),
        intensity.alias("intensity"),
        F.map_filter(features, lambda _, v: v.isNotNull()).alias("features"),
    )


def environment_rows(measured: DataFrame, series: Series, widths: dict[str, int], fast: str, slow: str) -> DataFrame:
    """A row per closed bucket of the slow frame: its measurements and the fast frame's volatility at the same time.

    ``measured`` comes from ``timeframe_measurements``; ``widths`` is the milliseconds of a bucket of each frame.
    """
    end = lambda frame: F.col("bucket_ms") + F.lit(widths[frame])
    one = measured.where(F.col("frame") == slow).withColumn("decision_ms", end(slow))
    two = measured.where(F.col("frame") == fast).select(*series.keys, end(fast).alias("decision_ms"), F.col("realized_volatility").alias("fast_volatility"))
    return one.join(two, [*series.keys, "decision_ms"], "left")


# Limits of the environment events.
ENVIRONMENT_LIMITS = {
    "volatility_expansion_ratio": 1.5,
    "volume_shock_z": 2.0,
    "return_shock_sigma": 3.0,
    "oi_shock_fraction": 0.03,
    "funding_extreme": 0.0005,
    "trend_acceleration": 0.001,
    "spread_expansion": 0.0005,
    "order_flow_imbalance": 0.5,
}


def environment_events(env: DataFrame, keys: list[str], limits: dict[str, float] | None = None) -> DataFrame:
    """Conditions of an environment row as event rows (keys, event_type, severity from 0 to 1).

    Columns, each optional: fast_volatility, realized_volatility, volume_z, return_fraction, open, close,
    previous_high, previous_low, trend_direction, previous_trend_direction, trend_acceleration, oi_change, funding,
    liquidations (map of numbers), spread, flow_imbalance. One that is null or not there fires nothing.
    """
    limit = ENVIRONMENT_LIMITS | (limits or {})
    kinds = {"trend_direction": "string", "previous_trend_direction": "string", "liquidations": "map<string,double>"}
    c = lambda n: F.col(n) if n in env.columns else F.lit(None).cast(kinds.get(n, "double"))
    ratio = F.try_divide(c("fast_volatility"), F.nullif(c("realized_volatility"), F.lit(0.0)))
    most = F.lit(limit["volatility_expansion_ratio"])
    up, down = c("close") > c("previous_high"), c("close") < c("previous_low")
    z, accelerated = F.abs(c("volume_z")), F.abs(c("trend_acceleration"))
    shock = F.abs(c("return_fraction")) >= limit["return_shock_sigma"] * F.nullif(c("realized_volatility"), F.lit(0.0))
    forced = F.exists(F.map_values(c("liquidations")), lambda v: v > 0)
    rules = [
        ("volatility_expansion", ratio > most, F.lit(0.7)),
        ("volatility_compression", ratio < 1 / most, F.lit(0.6)),
        ("volume_shock", z >= limit["volume_shock_z"], z / (2 * limit["volume_shock_z"])),
        ("return_shock", shock, F.lit(0.8)),
        ("range_breakout", F.coalesce(up, F.lit(False)) | F.coalesce(down, F.lit(False)), F.lit(0.8)),
        ("range_failure", (c("open") >= c("previous_high")) & (c("close") < c("previous_high")), F.lit(0.8)),
        ("range_failure", (c("open") <= c("previous_low")) & (c("close") > c("previous_low")), F.lit(0.8)),
        ("trend_transition", c("previous_trend_direction") != c("trend_direction"), F.lit(0.7)),
        ("trend_acceleration", accelerated >= limit["trend_acceleration"], accelerated / limit["trend_acceleration"]),
        ("oi_shock", F.abs(c("oi_change")) >= limit["oi_shock_fraction"], F.lit(0.7)),
        ("funding_extreme", F.abs(c("funding")) >= limit["funding_extreme"], F.lit(0.6)),
        ("liquidation_burst", forced, F.lit(0.7)),
        ("spread_expansion", c("spread") > limit["spread_expansion"], F.lit(0.6)),
        ("order_flow_imbalance", F.abs(c("flow_imbalance")) >= limit["order_flow_imbalance"], F.lit(0.6)),
    ]
    within = lambda v: F.least(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(1.0))
    rows = F.array(*(F.when(cond, F.struct(F.lit(k).alias("event_type"), within(v).alias("severity"))) for k, cond, v in rules))
    return env.select(*keys, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e")).select(*keys, "e.event_type", "e.severity")


STATE_COLUMNS = ("trend_state", "vol_state", "range_state", "oi_state", "funding_state", "price_location_state")
# Cuts of the market states.
STATE_CUTS = {
    "trend_z": 0.5,
    "vol_low_z": -0.5,
    "vol_high_z": 1.0,
    "vol_extreme_z": 2.0,
    "range_expansion_z": 0.5,
    "oi_z": 0.5,
    "funding_z": 1.0,
    "location_high": 0.8,
    "location_low": 0.2,
}
STATE_INPUTS = {
    "ret_4h": "ret_4h",
    "realized_vol_24h": "realized_vol_24h",
    "atr_frac_24h": "atr_frac_24h",
    "atr_frac_72h": "atr_frac_72h",
    "oi_change_1h": "oi_change_pct_1h_true",
    "funding_zscore": "funding_zscore",
    "donchian_pos_24h": "donchian_pos_24h",
}


def market_states(df: DataFrame, series: Series, window: int = 1440, source: dict[str, str] | None = None, steps: int = 240) -> DataFrame:
    """Six categorical states; a state whose inputs are absent is left out, and it is null while they are null.

    Trend is the 4 h return over volatility times sqrt(``steps``); volatility and open interest are z-scores over
    ``window`` rows, from a quarter of them on; range is the ratio of two ATR fractions; location is the place in the
    Donchian channel. ``source`` names the input columns where they differ from STATE_INPUTS.
    """
    at = STATE_INPUTS | (source or {})
    have = lambda *names: all(at[n] in df.columns for n in names)
    c, cut = (lambda n: F.col(at[n])), STATE_CUTS
    z = {k: n for k, n in {"__vol_z": "realized_vol_24h", "__oi_z": "oi_change_1h"}.items() if have(n)}
    rows = framed(df, series, window, 0, lambda w: {k: zscore(c(n), w, window, window // 4) for k, n in z.items()}) if z else df
    trend = c("ret_4h") / (c("realized_vol_24h") * F.sqrt(F.lit(float(steps))) + EPS)
    spread = c("atr_frac_24h") / (c("atr_frac_72h") + EPS)
    place, vol, oi, funding = c("donchian_pos_24h"), F.col("__vol_z"), F.col("__oi_z"), c("funding_zscore")
    narrow, wide = 1 - cut["range_expansion_z"] / 2, 1 + cut["range_expansion_z"]

    def three(x: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
        return F.when(x < low, names[0]).when(x > high, names[2]).when(x.isNotNull(), names[1])

    states = {
        "trend_state": (("ret_4h", "realized_vol_24h"), lambda: three(trend, -cut["trend_z"], cut["trend_z"], ("DOWN", "NEUTRAL", "UP"))),
        "vol_state": (
            ("realized_vol_24h",),
            lambda: F.when(vol >= cut["vol_extreme_z"], "EXTREME").when(vol >= cut["vol_high_z"], "HIGH").when(vol < cut["vol_low_z"], "LOW").when(vol.isNotNull(), "NORMAL"),
        ),
        "range_state": (
            ("atr_frac_24h", "atr_frac_72h"),
            lambda: F.when(spread < narrow, "COMPRESSED").when(spread >= wide, "EXPANDING").when(spread.isNotNull(), "NORMAL"),
        ),
        "oi_state": (("oi_change_1h",), lambda: three(oi, -cut["oi_z"], cut["oi_z"], ("FALLING", "NEUTRAL", "RISING"))),
        "funding_state": (("funding_zscore",), lambda: three(funding, -cut["funding_z"], cut["funding_z"], ("LOW", "NORMAL", "HIGH"))),
        "price_location_state": (("donchian_pos_24h",), lambda: three(place, cut["location_low"], cut["location_high"], ("LOW", "MID", "HIGH"))),
    }
    return rows.withColumns({k: rule() for k, (needs, rule) in states.items() if have(*needs)}).drop(*z)


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))


def welch(n1, s1, q1, n0, s0, q0) -> dict[str, Column]:
    """Difference of means and Welch's t from counts, sums and sums of squares."""
    m1, m0 = F.try_divide(s1, n1), F.try_divide(s0, n0)
    var = lambda n, s, q: F.try_divide(F.greatest(q - F.try_divide(s * s, n), F.lit(0.0)), n - 1)
    se2 = F.try_divide(var(n1, s1, q1), n1) + F.try_divide(var(n0, s0, q0), n0)
    return {"mean": m1, "mean_rest": m0, "diff": m1 - m0, "t_stat": F.when((n1 > 1) & (n0 > 1) & (se2 > 0), (m1 - m0) / F.sqrt(se2))}


def state_study(df: DataFrame, states: list[str], returns: list[str], depth: int = 2, least: int = 30) -> DataFrame:
    """Each state, and each combination of up to ``depth`` states, against all other rows, for every horizon.

    One aggregation by GROUPING SETS over unpivoted horizons gives counts and sums; the rest of a group is the
    horizon's total less the group. Columns: states, horizon, n, n_rest, mean, mean_rest, diff, t_stat.
    """
    rows = unpivoted(df, states, returns, "horizon", "r") if not states else df.select(*states, F.explode(F.array(*(F.struct(F.lit(c).alias("horizon"), F.col(c).cast("double").alias("r")) for c in returns))).alias("x")).select(*states, "x.horizon", "x.r")
    rows = rows.where("r is not null")
    sets = [c for k in range(1, depth + 1) for c in combinations(states, k)]
    known = rows
    grouped = known.groupingSets([[*(F.col(s) for s in c), F.col("horizon")] for c in sets], *[F.col(s) for s in states], F.col("horizon"))
    cells = grouped.agg(F.count("*").alias("n"), F.sum("r").alias("s1"), F.sum(F.col("r") * F.col("r")).alias("s2"), F.grouping_id().alias("gid"))
    # a state that is in the set but null (warm-up) is no level
    bit = {s: 1 << (len(states) - i) for i, s in enumerate(states)}
    ok = F.lit(True)
    for s in states:
        ok = ok & (F.col(s).isNotNull() | (F.col("gid").bitwiseAND(F.lit(bit[s])) != 0))
    total = known.groupBy("horizon").agg(F.count("*").alias("all_n"), F.sum("r").alias("all_s1"), F.sum(F.col("r") * F.col("r")).alias("all_s2"))
    out = cells.where(ok & (F.col("n") >= least)).join(total, "horizon")
    stats = welch(F.col("n"), F.col("s1"), F.col("s2"), F.col("all_n") - F.col("n"), F.col("all_s1") - F.col("s1"), F.col("all_s2") - F.col("s2"))
    return out.select(*states, "horizon", "n", (F.col("all_n") - F.col("n")).alias("n_rest"), *(v.alias(k) for k, v in stats.items()))


def with_q_values(study: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """p values (normal) of t_stat and Benjamini-Hochberg q values within ``keys``; for tables of statistics."""
    keys = keys or []
    rows = study.withColumn("p_value", two_sided_p("t_stat"))
    tested = rows.where("p_value is not null")
    w = Window.partitionBy(*keys).orderBy("p_value")
    m = F.count("*").over(Window.partitionBy(*keys))
    ranked = tested.withColumn("__q", F.col("p_value") * m / F.rank().over(w))
    down = Window.partitionBy(*keys).orderBy(F.desc("p_value")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q_value", F.least(F.min("__q").over(down), F.lit(1.0))).drop("__q").unionByName(rows.where("p_value is null").withColumn("q_value", F.lit(None).cast("double")))


def event_study(df: DataFrame, events: list[str], returns: list[str], extra: list[str] | None = None, least: int = 30) -> DataFrame:
    """Per event (and level of ``extra``) and horizon: returns where the event fired against all others."""
    extra = extra or []
    marks = F.array(*(F.struct(F.lit(e).alias("event"), F.col(e).alias("on")) for e in events))
    rows = unpivoted(df.withColumn("__e", marks), [*extra, "__e"], returns, "horizon", "r").where("r is not null")
    rows = rows.select(*extra, "horizon", "r", F.explode("__e").alias("x")).select(*extra, "horizon", "r", "x.event", "x.on")
    on = F.col("on") == 1
    r2 = F.col("r") * F.col("r")
    out = rows.groupBy("event", *extra, "horizon").agg(
        F.count_if(on).alias("n"), F.sum(F.when(on, F.col("r"))).alias("s1"), F.sum(F.when(on, r2)).alias("q1"), F.count_if(~on).alias("n_rest"), F.sum(F.when(~on, F.col("r"))).alias("s0"), F.sum(F.when(~on, r2)).alias("q0"),
        F.avg(F.when(on, (F.col("r") > 0).cast("double"))).alias("p_pos"),
    )
    out = with_quantiles(out.where(F.col("n") >= least), rows.where(on), ["event", *extra, "horizon"], {"r": F.col("r")}, {"median": ("r", 0.5)})
    stats = welch(F.col("n"), F.col("s1"), F.col("q1"), F.col("n_rest"), F.col("s0"), F.col("q0"))
    return out.select("event", *extra, "horizon", "n", "n_rest", "median", "p_pos", *(v.alias(k) for k, v in stats.items()))


def regime_study(df: DataFrame, events: list[str], returns: list[str], regimes: list[str], least: int = 30) -> DataFrame:
    """The event study within each level of each regime column."""
    long = df.withColumn("__g", F.explode(F.array(*(F.struct(F.lit(g).alias("regime"), F.col(g).cast("string").alias("level")) for g in regimes))))
    return event_study(long.withColumns({"regime": F.col("__g.regime"), "level": F.col("__g.level")}).where("level is not null"), events, returns, ["regime", "level"], least)


def year_stability(df: DataFrame, series: Series, state: str, level: str, ret: str, least: int = 10) -> DataFrame:
    """Per calendar year: the state's mean return against the rest, where both sides have ``least`` rows."""
    on = F.col(state) == level
    rows = df.where(F.col(ret).isNotNull() & F.col(state).isNotNull()).withColumn("year", F.year(F.timestamp_millis(series.ts)))
    r, r2 = F.col(ret), F.col(ret) * F.col(ret)
    g = rows.groupBy("year").agg(F.count_if(on).alias("n"), F.sum(F.when(on, r)).alias("s1"), F.sum(F.when(on, r2)).alias("q1"), F.count_if(~on).alias("n_rest"), F.sum(F.when(~on, r)).alias("s0"), F.sum(F.when(~on, r2)).alias("q0"))
    stats = welch(F.col("n"), F.col("s1"), F.col("q1"), F.col("n_rest"), F.col("s0"), F.col("q0"))
    return g.where((F.col("n") >= least) & (F.col("n_rest") >= least)).select("year", "n", "n_rest", *(v.alias(k) for k, v in stats.items()))


#: Funding (per 8 h) from which derivatives count as crowded.
CROWDED = 0.0005


def assessed_regime(trends: list[str], volatility: str, structure: str, funding: str) -> dict[str, Column]:
    """trend (two of the frames' directions agree), volatility, structure, derivatives, confidence and reason.

    ``trends`` names the direction columns of three frames; confidence is the larger share of them, 0.3 at least where
    they are mixed.
    """
    count = lambda name: sum((F.coalesce(F.col(t) == name, F.lit(False)).cast("int") for t in trends), F.lit(0))
    up, down = count("UP"), count("DOWN")
    trend = F.when(up >= 2, "BULLISH").when(down >= 2, "BEARISH").otherwise("MIXED")
    crowd = F.when(F.abs(F.coalesce(F.col(funding), F.lit(0.0))) >= CROWDED, "CROWDED").otherwise("NEUTRAL")
    share = F.greatest(up, down) / len(trends)
    vol = F.col(volatility).cast("string")
    return {
        "trend": trend,
        "volatility": vol,
        "structure": F.col(structure),
        "derivatives": crowd,
        "confidence": F.least(F.lit(1.0), F.greatest(F.when(trend == "MIXED", 0.3).otherwise(0.0), share)),
        "reason": F.concat(F.lit("higher-timeframe trend="), trend, F.lit("; volatility="), F.coalesce(vol, F.lit("None")), F.lit("; derivatives="), crowd),
    }


def classified_regime(vol_regime: str, trend_score: str, funding_z: str) -> dict[str, Column]:
    """Three independent fields; an input that is null counts as 0, as in warm-up."""
    v, t, f = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (vol_regime, trend_score, funding_z))
    return {
        "volatility": F.when(v < -0.3, "low").when(v > 0.5, "high").otherwise("normal"),
        "trend": F.when(F.abs(t) < 0.15, "flat").otherwise("trending"),
        "funding": F.when(f > 2.0, "extreme_long").when(f < -2.0, "extreme_short").otherwise("normal"),
    }


def _finite(c: str) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def tertile_regimes(train: DataFrame, rows: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """low, normal or high of each column by the tertiles of the finite training values; a bound belongs below.

    Null and NaN have no regime. The tertiles are one row.
    """
    points = {f"__{k}_{c}": (c, k / 3) for c in columns for k in (1, 2)}
    cuts = with_quantiles(train.agg(F.count("*").alias("__n")), train, [], {c: F.when(_finite(c), F.col(c)) for c in columns}, points)
    out = rows.crossJoin(F.broadcast(cuts))  # an aggregate: one row
    name = lambda c: F.when(F.col(c) <= F.col(f"__1_{c}"), "low").when(F.col(c) <= F.col(f"__2_{c}"), "normal").when(~F.isnan(c), "high")
    return out.withColumns({f"{c}_regime": name(c) for c in columns}).drop("__n", *points)


def digest_alerts(digests: DataFrame, series: Series) -> DataFrame:
    """(keys, time, alert, subject, severity, action) from window digests.

    Columns of ``digests``: regime, cost_ratio, calibration_drift, histograms (map of a question's name to the shares
    of ten bins), net_per_trade. A regime other than the one before, costs over 0.8 of gross, drift over 0.15 and, for
    each question, more than 0.8 of the answers between 0.3 and 0.7 are warnings to review; a negative edge with costs
    over half of gross is critical and halts.
    """
    rows = framed(digests, series, 1, 0, lambda w: {"__before": F.lag("regime").over(w)})
    middle = lambda h: F.aggregate(F.slice(h, 4, 4), F.lit(0.0), lambda a, x: a + x)
    dull = F.map_keys(F.map_filter("histograms", lambda _, h: (F.size(h) > 0) & (middle(h) > 0.8)))
    alert = lambda name, subject, severity, action: F.struct(
        F.lit(name).alias("alert"), subject.cast("string").alias("subject"), F.lit(severity).alias("severity"), F.lit(action).alias("action")
    )
    none = F.lit(None)
    single = F.array(
        F.when(F.col("__before") != F.col("regime"), alert("regime_change", none, "warning", "review")),
        F.when(F.col("cost_ratio") > 0.8, alert("cost_erosion", none, "warning", "review")),
        F.when(F.col("calibration_drift") > 0.15, alert("calibration_drift", none, "warning", "review")),
        F.when((F.col("net_per_trade") < 0) & (F.col("cost_ratio") > 0.5), alert("negative_edge", none, "critical", "halt")),
    )
    each = F.transform(F.coalesce(dull, F.array().cast("array<string>")), lambda q: alert("no_information", q, "warning", "review"))
    found = F.concat(F.filter(single, lambda x: x.isNotNull()), each)
    return rows.select(*series.keys, series.ts, F.explode(found).alias("e")).select(*series.keys, series.ts, "e.*")


def alignment(trends: Column, reference: Column) -> Column:
    """Share of a map's values that equal the reference trend."""
    values = F.map_values(trends)
    return F.try_divide(F.size(F.filter(values, lambda v: v == reference)).cast("double"), F.size(values))


def largest_edge(study: DataFrame) -> DataFrame:
    """Per horizon the largest absolute difference of means."""
    return study.groupBy("horizon").agg(F.max(F.abs("diff")).alias("largest_edge"))
