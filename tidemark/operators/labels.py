"""Forward labels: execution returns, excursions, direction, first touch of barriers. Windows that are not full are null.

A decision at a closed bar t enters at open[t+1]; its path is bars t+1..t+h and its exit is open[t+h+1].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.plans.quantiles import exact_quantiles
from tidemark.plans.series import CHUNK, INDEX, ahead, framed, with_chunks
from tidemark.spec import Series

LONG, SHORT = 1, -1
#: Horizons up to which a path is an array in a window; longer ones are searched along extremes of blocks.
ARRAY_HORIZON = 120
TOLERANCE = 1e-12


def close_returns(w: WindowSpec, horizons) -> dict[str, Column]:
    return {f"fwd_ret_{h}": F.lead("close", h).over(w) / F.col("close") - 1 for h in horizons}


def execution_return(w: WindowSpec, h: int, delay: int = 0) -> Column:
    return F.lead("open", h + 1 + delay).over(w) / F.lead("open", 1 + delay).over(w) - 1


def full(column: Column, w: WindowSpec, h: int) -> Column:
    return F.when(F.count("close").over(ahead(w, h)) == h, column)


def excursions(w: WindowSpec, h: int, entry: Column) -> dict[str, Column]:
    """Favourable and adverse excursion of a long as magnitudes against ``entry``, and the offsets of the first extremes."""
    over = ahead(w, h)
    high, low = F.max("high").over(over), F.min("low").over(over)
    top = F.max(F.struct(F.col("high").alias("v"), (-F.col(INDEX)).alias("i"))).over(over)
    bottom = F.min(F.struct(F.col("low").alias("v"), F.col(INDEX).alias("i"))).over(over)
    return {
        f"mfe_{h}": full(F.greatest(high / entry - 1, F.lit(0.0)), w, h),
        f"mae_{h}": full(F.greatest(1 - low / entry, F.lit(0.0)), w, h),
        f"time_to_mfe_{h}": full(-top["i"] - F.col(INDEX), w, h),
        f"time_to_mae_{h}": full(bottom["i"] - F.col(INDEX), w, h),
    }


def direction(value: Column, threshold: float) -> Column:
    """1 above, -1 below, 0 between; null stays null."""
    return F.when(value > threshold, 1).when(value < -threshold, -1).when(value.isNotNull(), 0)


def forward_labels(bars: DataFrame, series: Series, horizons=(5, 15, 30, 60), threshold: float = 0.001, delay: int = 0) -> DataFrame:
    """Close and execution returns, excursions from the next open, direction and its class, for all horizons in one pass."""

    def columns(w: WindowSpec):
        out = close_returns(w, horizons)
        for h in horizons:
            ret = execution_return(w, h, delay)
            out[f"exec_ret_{h}"] = ret
            out[f"label_dir_{h}"] = direction(ret, threshold)
            out[f"label_class_{h}"] = direction(ret, threshold) + 1
            out |= excursions(w, h, F.lead("open", 1).over(w))
        return out

    return framed(bars, series, 0, max(horizons) + 2 + delay, columns)


def long_horizon_targets(bars: DataFrame, series: Series, horizons=(60, 240, 720, 1440), bps=(20, 50, 100, 200, 500), truncate: bool = True) -> DataFrame:
    """Execution return, its size and sign, excursions, forward realized volatility and threshold events; rows without the longest window go."""
    rows = framed(bars, series, 1, 0, lambda w: {"__lr": F.when(F.lag("close").over(w) > 0, F.ln(F.col("close") / F.lag("close").over(w)))})

    def columns(w: WindowSpec):
        out: dict[str, Column] = {}
        for h in horizons:
            ret = execution_return(w, h)
            out |= {f"exec_ret_{h}": ret, f"target_abs_{h}": F.abs(ret), f"target_pos_{h}": F.when(ret.isNotNull(), (ret > 0).cast("int"))}
            out |= {k: v for k, v in excursions(w, h, F.lead("open", 1).over(w)).items() if "time" not in k}
            vol = F.col("__lr")
            out[f"target_rv_{h}"] = full(F.when(F.count(vol).over(ahead(w, h)) >= max(2, h // 2), F.stddev_samp(vol).over(ahead(w, h))), w, h)
            for b in bps:
                out[f"target_up_{b}_{h}"] = F.when(ret.isNotNull(), (ret > b / 1e4).cast("int"))
                out[f"target_dn_{b}_{h}"] = F.when(ret.isNotNull(), (ret < -b / 1e4).cast("int"))
        return out

    out = framed(rows, series, 0, max(horizons) + 2, columns).drop("__lr")
    return out.where(F.col(f"exec_ret_{max(horizons)}").isNotNull()) if truncate else out


def _path(w: WindowSpec, h: int, reference: str) -> dict[str, Column]:
    over = ahead(w, h)
    entry = F.lead("open", 1).over(w) if reference == "next_open" else F.col("close")
    return {"__high": full(F.collect_list("high").over(over), w, h), "__low": full(F.collect_list("low").over(over), w, h), "entry": entry, "__exit": F.lead("open", h + 1).over(w) if reference == "next_open" else F.lead("close", h).over(w)}


def _offset(path: str, hit) -> Column:
    """1-based offset of the first bar that touches, null if none or if the path is not full."""
    return F.nullif(F.array_position(F.transform(path, hit), True).cast("int"), F.lit(0))


def _reaches(level: Column, side: int):
    """Whether a price lies at or beyond a level, to a relative tolerance."""
    slack = F.abs(level) * TOLERANCE
    return (lambda x: x >= level - slack) if side == LONG else (lambda x: x <= level + slack)


def outcome(tp: Column, sl: Column, valid: Column) -> dict[str, Column]:
    """Which barrier came first: a bar that touches both counts as the stop; ``ambiguous`` marks it."""
    return {
        "tp_offset": F.when(valid, tp),
        "sl_offset": F.when(valid, sl),
        "outcome": F.when(valid, F.when(sl.isNotNull() & (tp.isNull() | (sl <= tp)), "SL").when(tp.isNotNull(), "TP").otherwise("TIMEOUT")),
        "ambiguous": F.when(valid, F.coalesce(tp == sl, F.lit(False)).cast("int")),
    }


def first_touch(bars: DataFrame, series: Series, target, stop, horizon: int, side: int = LONG, reference: str = "next_open") -> DataFrame:
    """entry, tp_offset, sl_offset, outcome, ambiguous, holding and realized return of one barrier pair.

    ``target`` and ``stop`` are fractions of the entry: numbers, or names of columns for a level per row. Touches
    beyond the horizon do not count. Short paths are arrays in one window; long ones are searched by ``touch_times``.
    """
    t, s = (F.lit(float(x)) if not isinstance(x, str) else F.col(x) for x in (target, stop))
    if horizon > ARRAY_HORIZON:
        levels = {"__tp": (t, side), "__sl": (s, -side)}
        found = touch_times(bars, series, [horizon], levels, reference).withColumnsRenamed({f"exit_{horizon}": "__exit", f"whole_{horizon}": "__valid"})
        rows = bars.withColumns({"__t": t, "__s": s}).join(found, [*series.keys, series.ts])
    else:
        rows = framed(bars.withColumns({"__t": t, "__s": s}), series, 0, horizon + 2, lambda w: _path(w, horizon, reference))
        up, down = F.col("entry") * (1 + side * F.col("__t")), F.col("entry") * (1 - side * F.col("__s"))
        tp = _offset("__high" if side == LONG else "__low", _reaches(up, side))
        sl = _offset("__low" if side == LONG else "__high", _reaches(down, -side))
        rows = rows.withColumns({"__tp": tp, "__sl": sl}).withColumn("__valid", F.col("__high").isNotNull() & F.col("__exit").isNotNull() & F.col("entry").isNotNull())
    rows = rows.withColumns(outcome(F.col("__tp"), F.col("__sl"), F.col("__valid")))
    held = F.when(F.col("outcome") == "TIMEOUT", F.lit(horizon)).otherwise(F.least("tp_offset", "sl_offset"))
    realized = F.when(F.col("outcome") == "TP", F.col("__t")).when(F.col("outcome") == "SL", -F.col("__s")).when(F.col("outcome") == "TIMEOUT", side * (F.col("__exit") / F.col("entry") - 1))
    return rows.withColumns({"holding": held, "realized": realized}).drop("__high", "__low", "__exit", "__tp", "__sl", "__valid", "__t", "__s")


def touch_times(bars: DataFrame, series: Series, horizons: list[int], levels: dict[str, tuple[Column, int]], reference: str = "next_open") -> DataFrame:
    """Keys, time, entry, for each horizon exit_h and whole_h, and for each level the bars until its first touch.

    A level is a fraction of the entry and a side: 1 above it, touched by a high, -1 below it, touched by a low. A touch
    counts up to the longest horizon; null is none. whole_h says that h bars follow and that entry and exit are known.

    A halo chunk is one row of arrays. Its extremes over 1, 2, 4, ... bars ahead are built once, and each bar halves its
    way along them: over the longest stretch that does not touch, then the next shorter one. So a search takes as many
    steps as the horizon has binary digits, whatever the horizon and the number of levels.
    """
    longest = max(horizons)
    wanted = [series.ts, "open", "high", "low", "close"]
    rows = bars.select(*series.keys, *wanted, *(fraction.cast("double").alias(f"__f{i}") for i, (fraction, _) in enumerate(levels.values())))
    rows = with_chunks(rows, series, 0, longest + 2)
    bar = F.struct(F.col(INDEX).alias("i"), *wanted, *(f"__f{i}" for i in range(len(levels))))
    chunks = rows.groupBy(*series.keys, CHUNK).agg(F.sort_array(F.collect_list(bar)).alias("p"), F.count_if(F.floor(F.col(INDEX) / series.chunk) == F.col(CHUNK)).alias("own"))
    top = longest.bit_length() - 1
    chunks = chunks.withColumns({"hi": _extremes("p", "high", top, F.greatest), "lo": _extremes("p", "low", top, F.least)}).where("own > 0")

    kept = [series.ts, "entry", *(f"exit_{h}" for h in horizons), *(f"whole_{h}" for h in horizons)]

    def prepared(i: Column) -> Column:
        """A bar's entry, exits and price levels."""
        here, after = F.get("p", i), lambda k: F.get("p", i + k)
        entry = after(1)["open"] if reference == "next_open" else here["close"]
        known = lambda x: x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0)))
        leave = {h: after(h + 1)["open"] if reference == "next_open" else after(h)["close"] for h in horizons}
        whole = {h: after(h)["i"].isNotNull() & known(entry) & known(leave[h]) for h in horizons}
        prices = {f"l{n}": entry * (1 + side * here[f"__f{n}"]) for n, (_, side) in enumerate(levels.values())}
        slack = {f"l{n}": prices[f"l{n}"] - side * F.abs(prices[f"l{n}"]) * TOLERANCE for n, (_, side) in enumerate(levels.values())}
        cells = [here[series.ts], entry, *(leave[h] for h in horizons), *(whole[h] for h in horizons)]
        return F.struct(i.alias("i"), *(c.alias(k) for k, c in zip(kept, cells, strict=True)), *(c.alias(k) for k, c in slack.items()))

    steps, powers = F.sequence(F.lit(top), F.lit(0), F.lit(-1)), F.array(*(F.lit(1 << x) for x in range(top + 1)))

    def search(x: Column, n: int, side: int) -> Column:
        """Bars until the first touch of a bar's level ``n``."""
        level, table = x[f"l{n}"], F.col("hi" if side == LONG else "lo")

        def passed(skip: Column, k: Column) -> Column:
            extreme = F.get(F.get(table, k), x["i"] + 1 + skip)
            clear = extreme < level if side == LONG else extreme > level
            further = skip + F.element_at(powers, k + 1)
            return F.when((further <= longest) & F.coalesce(clear, F.lit(True)), further).otherwise(skip)

        skip = F.aggregate(steps, F.lit(0), passed)
        return F.when(level.isNotNull() & (skip < longest), skip + 1)

    ready = chunks.withColumn("q", F.transform(F.sequence(F.lit(0), (F.col("own") - 1).cast("int")), prepared))
    found = F.transform("q", lambda x: F.struct(*(x[k].alias(k) for k in kept), *(search(x, n, side).alias(name) for n, (name, (_, side)) in enumerate(levels.items()))))
    return ready.select(*series.keys, F.explode(found).alias("x")).select(*series.keys, "x.*")


def _extremes(bars: str, name: str, top: int, pick) -> Column:
    """Arrays 0 to ``top``: the extreme of 1, 2, 4, ... bars from each bar on, or of those that are left."""
    first = F.transform(bars, lambda b: b[name])

    def doubled(tables: Column, k: Column) -> Column:
        last = F.element_at(tables, -1)
        shifted = F.slice(last, F.element_at(F.array(*(F.lit((1 << x) + 1) for x in range(max(top, 1)))), k), F.size(last))
        return F.concat(tables, F.array(F.zip_with(last, shifted, lambda a, b: pick(a, b))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(top)), F.array(first), doubled) if top else F.array(first)


def barrier_grid(spark, targets, stops, horizons) -> DataFrame:
    """All cells of target x stop x horizon."""
    one = lambda name, values, kind: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).cast(kind).alias(name))
    return one("target", targets, "double").crossJoin(one("stop", stops, "double")).crossJoin(one("horizon", horizons, "int"))  # literals only


def execution_barriers(bars: DataFrame, series: Series, targets, stops, horizons) -> DataFrame:
    """Outcomes of every cell and both sides: one first-touch offset per level and side, then cells as rows.

    The path of the longest horizon is read once; a touch counts for a cell if its offset lies within the horizon.
    """
    longest = max(horizons)

    def columns(w: WindowSpec):
        out = _path(w, longest, "next_open")
        out |= {f"__exit_{h}": F.lead("open", h + 1).over(w) for h in horizons} | {f"__full_{h}": F.count("close").over(ahead(w, h)) == h for h in horizons}
        over = ahead(w, longest)
        return out | {"__high": F.collect_list("high").over(over), "__low": F.collect_list("low").over(over)}

    rows = framed(bars, series, 0, longest + 2, columns)
    e, touch = F.col("entry"), {}
    number = {level: i for i, level in enumerate(sorted({*targets, *stops}))}
    for level, i in number.items():
        touch[f"__up_{i}"] = _offset("__high", _reaches(e * (1 + level), LONG))
        touch[f"__dn_{i}"] = _offset("__low", _reaches(e * (1 - level), SHORT))
    rows = rows.withColumns(touch)
    cells = []
    for side in (LONG, SHORT):
        for t in targets:
            for s in stops:
                for h in horizons:
                    tp, sl = F.col(f"__{'up' if side == LONG else 'dn'}_{number[t]}"), F.col(f"__{'dn' if side == LONG else 'up'}_{number[s]}")
                    valid = F.col(f"__full_{h}") & F.col(f"__exit_{h}").isNotNull() & e.isNotNull()
                    o = outcome(F.when(tp <= h, tp), F.when(sl <= h, sl), valid)
                    timeout = side * (F.col(f"__exit_{h}") / e - 1)
                    cells.append(F.struct(F.lit(side).alias("side"), F.lit(float(t)).alias("target"), F.lit(float(s)).alias("stop"), F.lit(h).alias("horizon"), *(v.alias(k) for k, v in o.items()), F.when(valid, timeout).alias("timeout_return")))
    return rows.select(*series.keys, series.ts, "entry", F.explode(F.array(*cells)).alias("c")).select(*series.keys, series.ts, "entry", "c.*")


def atr_barriers(bars: DataFrame, series: Series, target_atr: float, stop_atr: float, horizon: int, side: int = LONG, atr: str = "atr_14") -> DataFrame:
    """First touch at levels that are multiples of each row's ATR; rows without an ATR have no outcome."""
    rows = bars.withColumns({"target_fraction": target_atr * F.col(atr) / F.col("close"), "stop_fraction": stop_atr * F.col(atr) / F.col("close")})
    return first_touch(rows, series, "target_fraction", "stop_fraction", horizon, side)


def path_samples(touched: DataFrame, series: Series, n: int = 500) -> DataFrame:
    """The last ``n`` completed rows of each series: only the time buckets that can hold them are ranked."""
    done = touched.where("outcome is not null").withColumn("__b", F.floor(F.col(series.ts) / (series.chunk * series.step_ms)))
    later = Window.partitionBy(*series.keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = done.groupBy(*series.keys, "__b").agg(F.count("*").alias("__n"))
    last = sizes.withColumn("__later", F.coalesce(F.sum("__n").over(later), F.lit(0))).where(F.col("__later") < n)
    few = done.join(last.select(*series.keys, "__b"), [*series.keys, "__b"], "left_semi")
    rank = F.row_number().over(Window.partitionBy(*series.keys).orderBy(F.desc(series.ts)))  # n rows and a bucket at most
    return few.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r", "__b")


def path_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """P(target), P(stop), P(timeout), mean return and holding, and 1/sqrt(n)."""
    share = lambda k: F.avg((F.col("outcome") == k).cast("double"))
    return samples.where("outcome is not null").groupBy(*keys).agg(
        F.count("*").alias("n"), share("TP").alias("p_target"), share("SL").alias("p_stop"), share("TIMEOUT").alias("p_timeout"), F.avg("realized").alias("mean_return"), F.avg("holding").alias("mean_holding"), (1 / F.sqrt(F.count("*"))).alias("uncertainty")
    )


#: Targets and stops in multiples of the average true range, horizons in bars.
GEOMETRY = tuple((t, s, h) for t in (0.5, 1.0, 2.0, 3.0, 5.0) for s in (0.5, 1.0, 2.0) for h in (15, 30, 60, 120, 240, 480))


def geometry_bound(bars: DataFrame, series: Series, cells: Sequence[tuple[float, float, int]] = GEOMETRY, side: int = LONG, atr: str = "atr_14") -> DataFrame:
    """Per ATR cell (target, stop, horizon): P(target), P(stop), P(timeout), median fractions and the bound target - P(stop) * stop.

    One search of the paths gives the first touch of every distinct level; cells are exploded literals over it. The
    median of a multiple of the range is that multiple of the median, so each horizon has one. A bar without a range
    takes part with levels at its entry where ``atr`` is 0, and not at all where it is null.
    """
    horizons = sorted({h for _, _, h in cells})
    levels, number = {}, {}
    for kind, way, place in (("target", side, 0), ("stop", -side, 1)):
        for multiple in sorted({c[place] for c in cells}):
            number[kind, multiple] = name = f"__{kind}_{len(number)}"
            levels[name] = (multiple * F.col(atr) / F.col("close"), way)
    fraction = (F.col(atr) / F.col("close")).alias("__range")
    rows = touch_times(bars, series, horizons, levels).join(bars.select(*series.keys, series.ts, fraction), [*series.keys, series.ts])
    keys = list(series.keys)
    table = []
    for t, s, h in cells:
        tp, sl = F.col(number["target", t]), F.col(number["stop", s])
        found = outcome(F.when(tp <= h, tp), F.when(sl <= h, sl), F.col(f"whole_{h}"))["outcome"]
        table.append(F.struct(F.lit(float(t)).alias("target_atr"), F.lit(float(s)).alias("stop_atr"), F.lit(h).alias("horizon"), found.alias("outcome")))
    share = lambda k: F.avg((F.col("outcome") == k).cast("double"))
    known = rows.where("__range is not null")
    per_cell = known.select(*keys, F.explode(F.array(*table)).alias("c")).select(*keys, "c.*").where("outcome is not null")
    per_cell = per_cell.groupBy(*keys, "target_atr", "stop_atr", "horizon").agg(F.count("*").alias("n"), share("TP").alias("p_target"), share("SL").alias("p_stop"), share("TIMEOUT").alias("p_timeout"))
    whole = known.select(*keys, "__range", F.explode(F.array(*(F.when(F.col(f"whole_{h}"), F.lit(h)) for h in horizons))).alias("horizon")).where("horizon is not null")
    medians = exact_quantiles(whole, [*keys, "horizon"], {"range": F.col("__range")}, {"__median": ("range", 0.5)})
    out = per_cell.join(medians, [*keys, "horizon"]).withColumns({f"{k}_fraction": F.col(f"{k}_atr") * F.col("__median") for k in ("target", "stop")}).drop("__median")
    return out.withColumn("bound", F.col("target_fraction") - F.col("p_stop") * F.col("stop_fraction"))


def viability(bounds: DataFrame, profiles: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Each geometry under each cost profile (fee and slippage a side, latency; in bps): the bound less the cost, and whether it is above it."""
    rows = [F.struct(F.lit(k).alias("profile"), F.lit(2 * fee + 2 * slip + late).alias("total_bps")) for k, (fee, slip, late) in profiles.items()]
    out = bounds.withColumn("__p", F.explode(F.array(*rows))).select(*bounds.columns, "__p.*")
    left = F.col("bound") * 1e4 - F.col("total_bps")
    return out.withColumns({"bound_minus_cost_bps": left, "viable": left > 0})


def delayed(df: DataFrame, series: Series, columns: list[str], k: int) -> DataFrame:
    """Decision columns moved ``k`` bars later."""
    return framed(df, series, k, 0, lambda w: {f"{c}_delayed": F.lag(c, k).over(w) for c in columns})

