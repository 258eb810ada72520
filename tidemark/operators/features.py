"""Causal features: every column at t reads rows up to t only. Windows that are not full are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import EPS, clip, eps_ratio, microprice, minutes_cycle, ratio
from tidemark.plans.series import block_scan, ema, framed, min_rows, staged, trailing, with_row_index
from tidemark.spec import Series

RETURNS, VOLS = (1, 5, 15, 60), (5, 30)
STRUCTURAL = (60, 240, 720, 1440, 2880, 4320)


def change(c: str, n: int, w: WindowSpec) -> Column:
    """c / c[-n] - 1, null where the earlier value is zero."""
    return ratio(F.col(c), F.nullif(F.lag(c, n).over(w), F.lit(0.0))) - 1


def log_return(c: str, w: WindowSpec) -> Column:
    before = F.lag(c).over(w)
    return F.when((F.col(c) > 0) & (before > 0), F.ln(F.col(c) / before))


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def zscore(c: Column, w: WindowSpec, n: int, least: int | None = None, eps: float = EPS) -> Column:
    """(x - mean) / sd over the last n rows, from ``least`` rows on; 0 where the window is constant but for rounding."""
    over, least = trailing(w, n), least or n
    mean, sd = F.avg(c).over(over), F.stddev_samp(c).over(over)
    z = F.when(sd > 1e-9 * F.abs(mean), (c - mean) / (sd + eps)).when(sd.isNotNull(), 0.0)
    return F.when(F.count(c).over(over) >= least, z)


def state_features(bars: DataFrame, series: Series, atr: int = 14, regime: int = 1440, z: int = 1440, spans: tuple[int, int, int] = (20, 50, 200)) -> DataFrame:
    """Returns, realized volatility, ATR, EMAs, volume z-score, trend score, volatility regime, OI change."""
    steps = [
        lambda w: {"log_ret": log_return("close", w), "tr": true_range(w)},
        lambda w: {f"ret_{n}": change("close", n, w) for n in RETURNS}
        | {f"rv_{n}": min_rows(F.col("log_ret"), trailing(w, n), F.stddev_samp, n) for n in VOLS}
        | {f"atr_{atr}": min_rows(F.col("tr"), trailing(w, atr), F.avg, atr), "volume_z": zscore(F.col("volume"), w, z), "funding_z": zscore(F.col("funding_rate"), w, z), "oi_change_1d": change("open_interest", regime, w)},
        lambda w: {"vol_regime": F.col("rv_30") / F.greatest(min_rows(F.col("rv_30"), trailing(w, regime), F.avg, regime), F.lit(EPS)) - 1},
    ]
    # one numbering serves both, and the wide windows stand above the self-join of the exponential means
    rows = ema(with_row_index(bars, series), series, {f"ema_{s}": (F.col("close"), s, s) for s in spans}, keep_index=True)
    rows = staged(rows, series, max(regime, z) + 64, 0, steps)
    a, b, c = (f"ema_{s}" for s in spans)
    return rows.withColumns(
        {
            "ema_gap": F.col(a) / F.col(c) - 1,
            "trend_score": clip((F.col(a) / F.col(c) - 1) / F.greatest("rv_30", F.lit(EPS)), -1.0, 1.0),
            "close_to_ema": F.col("close") / F.col(b) - 1,
        }
    ).drop("tr")


def phase_features(features: DataFrame, series: Series, atr: str = "atr_14") -> DataFrame:
    """Trend acceleration and duration, normalized returns and the funding-OI interaction, on state features."""
    steps = [
        lambda w: {"trend_accel": (F.col("ema_20") - F.lag("ema_20", 15).over(w)) / F.greatest(F.col(atr), F.lit(EPS))},
        lambda w: {"trend_duration": min_rows((F.col("ema_20") > F.col("ema_50")).cast("int"), trailing(w, 60), F.sum, 60)},
    ]
    out = staged(features, series, 64, 0, steps)
    return out.withColumns(
        {
            "ret_over_atr": F.col("ret_15") * F.col("close") / F.greatest(F.col(atr), F.lit(EPS)),
            "ret_over_rv": F.col("ret_15") / F.greatest("rv_30", F.lit(EPS)),
            "funding_oi": F.col("funding_z") * F.col("oi_change_1d"),
        }
    )


def structural_features(bars: DataFrame, series: Series, horizons: tuple[int, ...] = STRUCTURAL) -> DataFrame:
    """Long-horizon returns, volatility, ATR fraction, Donchian position and distances, in one shuffle and sort."""
    longest = max(horizons)

    def first(w: WindowSpec):
        return {"log_ret": log_return("close", w), "tr": true_range(w)} | {f"sret_{h}": change("close", h, w) for h in horizons}

    def second(w: WindowSpec):
        out: dict[str, Column] = {}
        for h in horizons:
            over = trailing(w, h)
            high, low = F.max("high").over(over), F.min("low").over(over)
            full = F.count("close").over(over) >= h
            out[f"srv_{h}"] = min_rows(F.col("log_ret"), over, F.stddev_samp, max(2, h // 4))
            out[f"atr_frac_{h}"] = min_rows(F.col("tr"), over, F.avg, max(2, h // 4)) / F.col("close")
            out[f"donchian_{h}"] = F.when(full, (F.col("close") - low) / (high - low + EPS))
            out[f"from_high_{h}"] = F.when(full, F.col("close") / high - 1)
            out[f"from_low_{h}"] = F.when(full, F.col("close") / low - 1)
        return out

    rows = staged(bars, series, 2 * longest, 0, [first, second])
    a, b, c = horizons[0], horizons[len(horizons) // 2], horizons[-1]
    return rows.withColumns({"momentum_spread": F.col(f"sret_{b}") - F.col(f"sret_{a}"), "vol_ratio": ratio(f"srv_{a}", f"srv_{c}"), "vol_spread": F.col(f"srv_{b}") - F.col(f"srv_{c}")}).drop("tr")


def structural_emas(bars: DataFrame, series: Series, spans: dict[int, int] | None = None) -> DataFrame:
    """Weighted exponential means of long spans (span -> rows needed) and the distances between them and the close."""
    spans = spans or {720: 60, 2880: 240, 10_080: 720}
    rows = ema(bars, series, {f"wema_{s}": (F.col("close"), s, least) for s, least in spans.items()}, adjust=True)
    names = [f"wema_{s}" for s in spans]
    out = {f"close_over_{n}": F.col("close") / F.col(n) - 1 for n in names}
    out |= {f"{a}_over_{b}": F.col(a) / F.col(b) - 1 for a, b in zip(names, names[1:], strict=False)}
    return rows.withColumns(out)


def quadrants(price_change: Column, oi_change: Column) -> dict[str, Column]:
    """Four flags of price and open interest moving up or down."""
    up, oi = price_change > 0, oi_change > 0
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "price_up_oi_up": flag(up & oi),
        "price_up_oi_down": flag(up & (oi_change < 0)),
        "price_down_oi_up": flag((price_change < 0) & oi),
        "price_down_oi_down": flag((price_change < 0) & (oi_change < 0)),
    }


def oi_funding_features(bars: DataFrame, series: Series, zs: tuple[int, ...] = (60, 360), sums: tuple[int, ...] = (720, 2880)) -> DataFrame:
    """Open-interest changes and z-scores, price/OI quadrants, funding level, change, z-scores, rolling mean and sum."""

    def columns(w: WindowSpec):
        oi, fund = F.col("open_interest"), F.col("funding_rate")
        out = {f"oi_change_{n}": oi - F.lag(oi, n).over(w) for n in (1, 5, 15, 60)} | {f"oi_pct_{n}": change("open_interest", n, w) for n in (1, 5, 15, 60)}
        out |= {f"oi_z_{n}": zscore(oi, w, n) for n in zs} | {f"funding_z_{n}": zscore(fund, w, n) for n in zs}
        out["funding_change"] = fund - F.lag(fund).over(w)
        for n in sums:
            out[f"funding_mean_{n}"] = min_rows(fund, trailing(w, n), F.avg, n // 4)
            out[f"funding_sum_{n}"] = min_rows(fund, trailing(w, n), F.sum, n // 4)
        return out | quadrants(F.col("close") - F.lag("close").over(w), oi - F.lag(oi).over(w))

    return framed(bars, series, max(*zs, *sums), 0, columns)


def seasonality(bars: DataFrame, series: Series) -> DataFrame:
    return bars.withColumns(minutes_cycle(series.ts))


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Products of feature pairs, where both columns are there."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs if a in df.columns and b in df.columns})


FLOW = ("buy_volume", "sell_volume", "buy_notional", "sell_notional")


def flow_features(flow: DataFrame) -> DataFrame:
    """Net flow, imbalances, share of buys, mean size, share of large trades."""
    net = F.col("buy_volume") - F.col("sell_volume")
    total = F.col("buy_volume") + F.col("sell_volume")
    money = F.col("buy_notional") + F.col("sell_notional")
    return flow.withColumns(
        {
            "net_volume": net,
            "volume_imbalance": eps_ratio(net, total),
            "notional_imbalance": eps_ratio(F.col("buy_notional") - F.col("sell_notional"), money),
            "aggressor_ratio": eps_ratio(2 * F.col("buy_volume"), total),
            "mean_trade_size": eps_ratio(F.col("sum_trade_size"), F.col("trade_count")),
            "large_trade_share": eps_ratio(F.col("large_trade_notional"), F.col("total_notional")),
        }
    )


def rolling_flow(flow: DataFrame, series: Series, windows: tuple[int, ...] = (1, 5, 15, 30)) -> DataFrame:
    def columns(w: WindowSpec):
        out = {}
        for n in windows:
            buy, sell = F.sum("buy_volume").over(trailing(w, n)), F.sum("sell_volume").over(trailing(w, n))
            out |= {f"buy_{n}": buy, f"sell_{n}": sell, f"imbalance_{n}": (buy - sell) / (buy + sell + EPS)}
        return out

    return framed(flow, series, max(windows), 0, columns)


def cvd_features(flow: DataFrame, series: Series, lags: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    """Cumulative volume delta by a block scan, and its changes."""
    delta = F.coalesce(F.col("buy_volume"), F.lit(0.0)) - F.coalesce(F.col("sell_volume"), F.lit(0.0))
    rows = block_scan(flow, series, {"cvd": delta})
    return framed(rows, series, max(lags), 0, lambda w: {f"cvd_change_{n}": F.col("cvd") - F.lag("cvd", n).over(w) for n in lags})


def price_cvd_divergence(df: DataFrame, series: Series, n: int = 15) -> DataFrame:
    """Flags: price up while CVD falls, price down while CVD rises."""

    def columns(w: WindowSpec):
        move = F.col("close") - F.lag("close", n).over(w)
        cvd = F.col("cvd") - F.lag("cvd", n).over(w)
        return {"bearish_divergence": ((move > 0) & (cvd < 0)).cast("int"), "bullish_divergence": ((move < 0) & (cvd > 0)).cast("int")}

    return framed(df, series, n, 0, columns)


def book_features(book: DataFrame) -> DataFrame:
    mid = (F.col("bid_price") + F.col("ask_price")) / 2
    micro = microprice("bid_price", "ask_price", "bid_qty", "ask_qty")
    return book.withColumns(
        {
            "book_spread": F.col("ask_price") - F.col("bid_price"),
            "book_mid": mid,
            "spread_bps": ratio(F.col("ask_price") - F.col("bid_price"), mid) * 1e4,
            "book_imbalance": eps_ratio(F.col("bid_qty") - F.col("ask_qty"), F.col("bid_qty") + F.col("ask_qty")),
            "microprice": micro,
            "microprice_deviation": ratio(micro - mid, mid),
        }
    )


def micro_regimes(df: DataFrame, series: Series, vol: int = 60, look: int = 240) -> DataFrame:
    """Hour of day, volatility above or below its rolling median, price above or below its rolling mean; null in warm-up."""
    steps = [
        lambda w: {"log_ret": log_return("close", w)},
        lambda w: {"roll_vol": min_rows(F.col("log_ret"), trailing(w, vol), F.stddev_samp, vol)},
        lambda w: {"__m": F.when(F.count("roll_vol").over(trailing(w, look)) >= look, F.percentile("roll_vol", 0.5).over(trailing(w, look))), "__p": min_rows(F.col("close"), trailing(w, vol), F.avg, vol)},
    ]
    rows = staged(df, series, vol + look + 2, 0, steps)
    return rows.withColumns(
        {
            "hour_bucket": F.floor(F.pmod(F.col(series.ts), F.lit(86_400_000)) / 3_600_000 / 6).cast("long"),
            "vol_regime": F.when(F.col("__m").isNotNull(), F.when(F.col("roll_vol") > F.col("__m"), "HIGH").otherwise("LOW")),
            "trend_regime": F.when(F.col("__p").isNotNull(), F.when(F.col("close") > F.col("__p"), "UP").otherwise("DOWN")),
        }
    ).drop("__m", "__p")


def timeframe_measurements(rolled: DataFrame, series: Series) -> DataFrame:
    """Measurements of each frame at each bucket, over all of the frame's buckets up to it.

    Return and its change, population volatility of log returns, mean true range of the last 14 buckets over close,
    exponential means of 20, 50 and 200 (null until so many buckets), volume-weighted price (typical prices take the
    newest close), distance from it, place of the close in the bucket's own range (0.5 where it has none), volume
    against the buckets before, share of the last 20 returns that go with the direction, and direction, high and low of
    this bucket and the one before. Running sums are block scans: no frame's history is in one task.
    """
    by = series.at(keys=(*series.keys, "frame"), ts="bucket_ms")
    close, volume, ret = F.col("close"), F.col("volume"), F.col("return_fraction")
    toward = lambda now, before: F.when(now > before, "UP").when(now < before, "DOWN").otherwise("FLAT")

    def first(w: WindowSpec):
        before = F.lag("close").over(w)
        return {
            "return_fraction": F.when(before > 0, close / before - 1),
            "__log": log_return("close", w),
            "__tr": true_range(w),
            "previous_high": F.lag("high").over(w),
            "previous_low": F.lag("low").over(w),
            "trend_direction": toward(close, before),
        }

    def second(w: WindowSpec):
        last = trailing(w, 20)
        return {
            "atr_fraction": F.when(close > 0, F.avg("__tr").over(trailing(w, 14)) / close),
            "trend_acceleration": ret - F.lag("return_fraction").over(w),
            "previous_trend_direction": F.lag("trend_direction").over(w),
            "__ups": F.count_if(ret > 0).over(last),
            "__downs": F.count_if(ret < 0).over(last),
            "__returns": F.count("return_fraction").over(last),
        }

    rows = ema(rolled, by, {f"ema{n}": (close, n, n) for n in (20, 50, 200)}, keep_index=True)
    rows = staged(rows, by, 24, 0, [first, second])
    sums = {
        "__n": F.col("__log").isNotNull().cast("long"),
        "__l1": F.col("__log"),
        "__l2": F.col("__log") * F.col("__log"),
        "__rows": F.lit(1).cast("long"),
        "__v1": volume,
        "__v2": volume * volume,
        "__hl": (F.col("high") + F.col("low")) * volume,
    }
    rows = block_scan(rows, by, sums)
    n, before = F.col("__n"), F.col("__rows") - 1
    spread = lambda s1, s2, k: F.sqrt(F.greatest(s2 / k - (s1 / k) * (s1 / k), F.lit(0.0)))
    mean = (F.col("__v1") - volume) / F.greatest(before, F.lit(1))
    sd = F.when(before > 0, spread(F.col("__v1") - volume, F.col("__v2") - volume * volume, before))
    vwap = F.when(F.col("__v1") > 0, (F.col("__hl") + close * F.col("__v1")) / (3 * F.col("__v1")))
    direction = F.when(F.col("ema20").isNotNull() & F.col("ema50").isNotNull(), F.when(F.col("ema20") >= F.col("ema50"), "UP").otherwise("DOWN")).otherwise(F.col("trend_direction"))
    along = F.when(direction == "UP", F.col("__ups")).when(direction == "DOWN", F.col("__downs")).otherwise(F.lit(0))
    out = rows.withColumns(
        {
            "realized_volatility": F.when(n > 0, spread(F.col("__l1"), F.col("__l2"), n)),
            "vwap": vwap,
            "distance_from_vwap": F.try_divide(close - vwap, vwap),
            "range_position": F.when(F.col("high") > F.col("low"), (close - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5),
            # below this the buckets before are alike but for rounding
            "volume_z": F.when(sd > F.greatest(F.lit(1e-12), 1e-9 * F.abs(mean)), (volume - mean) / sd),
            "trend_persistence": F.try_divide(along.cast("double"), F.col("__returns")),
        }
    )
    return out.drop("__log", "__tr", "__ups", "__downs", "__returns", *sums)


def feature_bundle(bars: DataFrame, series: Series, flow: DataFrame | None = None) -> DataFrame:
    """State and phase features, seasonality and, with flow bars, flow features on the bars' spine."""
    out = seasonality(phase_features(state_features(bars, series), series), series)
    if flow is not None:
        from tidemark.operators.joins import spine_join

        out = flow_features(spine_join(out, flow, series, [*FLOW, "sum_trade_size", "large_trade_notional", "total_notional"]))
    return out


def running_peak(df: DataFrame, series: Series, value: Column, name: str) -> DataFrame:
    return block_scan(df, series, {name: value}, "max")

