"""Column builders: number parsing, time buckets, guarded arithmetic, hashes, microstructure scalars, scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-12


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed_point(c) -> Column:
    """A number written as text; '', 'null', 'None', '0x' and what is no number are null."""
    s = F.trim(col(c).cast("string"))
    return F.when(~s.isin("", "null", "None", "0x"), s.try_cast("double"))


def scaled(c, factor) -> Column:
    """A nullable value times a factor; null stays null."""
    return col(c) * (factor if isinstance(factor, Column) else F.lit(factor))


def to_epoch_ms(c) -> Column:
    """Epoch milliseconds of text: ISO-8601, or unix seconds or milliseconds told apart by magnitude."""
    s = F.trim(col(c).cast("string"))
    n = s.try_cast("double")
    iso = F.unix_millis(F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00")))
    return F.when(n.isNotNull(), F.when(F.abs(n) < 1e11, n * 1000).otherwise(n).cast("long")).otherwise(iso)


def nearest_ms(c) -> Column:
    """Epoch milliseconds of a timestamp to the nearest, halves away from 1970, as DuckDB's epoch_ms; spec.epoch_ms rounds down."""
    us = F.unix_micros(col(c).cast("timestamp"))
    shifted = us + F.when(us < 0, -500).otherwise(500)
    return ((shifted - shifted % 1000) / 1000).cast("long")


def bucket(ts, step) -> Column:
    """Start of the step that a time lies in."""
    t = col(ts)
    return t - F.pmod(t, F.lit(step) if not isinstance(step, Column) else step)


def hour_of_day(ts) -> Column:
    return F.floor(F.pmod(col(ts), F.lit(86_400_000)) / 3_600_000).cast("long")


def day_of_week(ts) -> Column:
    """0 is Monday; the epoch was a Thursday."""
    return F.pmod(F.floor(col(ts) / 86_400_000) + 3, F.lit(7)).cast("long")


def ratio(a, b) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def eps_ratio(a, b) -> Column:
    return col(a) / (col(b) + F.lit(EPS))


def clip(c, low: float, high: float) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(F.least(col(c), F.lit(high)), F.lit(low)))


def finite(c) -> Column:
    """Whether a value is a number: not null, not NaN, not infinite."""
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))


def finite_or_null(c) -> Column:
    return F.when(finite(c), col(c))


def sentinel_to_null(c, sentinel=-1) -> Column:
    return F.when(col(c) != sentinel, col(c))


def minutes_cycle(ts) -> dict[str, Column]:
    """Sine and cosine of the hour of the day and the day of the week."""
    day = 2 * math.pi / 24 * hour_of_day(ts)
    week = 2 * math.pi / 7 * day_of_week(ts)
    return {"hour_sin": F.sin(day), "hour_cos": F.cos(day), "dow_sin": F.sin(week), "dow_cos": F.cos(week)}


def mid(bid, ask) -> Column:
    return (col(bid) + col(ask)) / 2


def spread_fraction(bid, ask) -> Column:
    return ratio(col(ask) - col(bid), mid(bid, ask))


def microprice(bid, ask, bid_qty, ask_qty) -> Column:
    """Mid weighted by the other side's depth."""
    return eps_ratio(col(bid) * col(ask_qty) + col(ask) * col(bid_qty), col(bid_qty) + col(ask_qty))


def depth(levels, n: int = 10) -> Column:
    """Sum of the sizes of the first n (price, size) levels."""
    return F.aggregate(F.slice(col(levels), 1, n), F.lit(0.0), lambda a, x: a + F.coalesce(x["size"], F.lit(0.0)))


def notional(levels, n: int = 10) -> Column:
    """Sum of price times size of the first n levels."""
    return F.aggregate(F.slice(col(levels), 1, n), F.lit(0.0), lambda a, x: a + F.coalesce(x["price"] * x["size"], F.lit(0.0)))


def canonical_json(*columns) -> Column:
    """Fields in the given order, which callers keep alphabetical, without white space; nulls are left out."""
    return F.to_json(F.struct(*columns))


def content_hash(text, bits: int = 256) -> Column:
    return F.sha1(col(text)) if bits == 160 else F.sha2(col(text), bits)


def state_map(*names: str) -> Column:
    """Numeric columns as a map without nulls and NaN."""
    m = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    return F.map_filter(m, lambda _, v: v.isNotNull() & ~F.isnan(v))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def quality_scores(trend_score, volume_z, vol_regime, funding_z) -> dict[str, Column]:
    """Market-quality scores from 0 to 1: sigmoids of the inputs, a missing input counting as 0.

    Failure is the larger of two risks, from extreme funding and extreme volatility; 0.5 where neither is known.
    """
    t, z, v, f = (F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in (trend_score, volume_z, vol_regime, funding_z))
    unknown = col(vol_regime).isNull() & col(funding_z).isNull()
    breakout = sigmoid(2.0 * t)
    failure = F.when(unknown, 0.5).otherwise(F.greatest(sigmoid((F.abs(f) - 2.0) * 2.0), sigmoid((F.abs(v) - 2.0) * 2.0)))
    return {
        "breakout": breakout,
        "liquidity_ok": sigmoid(z),
        "vol_risk": sigmoid(2.0 * v),
        "failure_regime": failure,
        "trade_ok": 0.5 * breakout + 0.5 * (1.0 - failure),
    }


def weighted_score(weights: dict[str, float]) -> Column:
    """Weighted sum of component columns; a missing component counts as zero."""
    total = F.lit(0.0)
    for name, w in sorted(weights.items()):
        total = total + F.lit(w) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return total


@F.pandas_udf(T.DoubleType())
def two_sided_p(t: pd.Series) -> pd.Series:
    """Normal two-sided p-value of a t statistic: erfc(|t| / sqrt 2). For tables of statistics, which are small."""
    return pd.Series([None if x is None or np.isnan(x) else math.erfc(abs(x) / math.sqrt(2)) for x in t.astype(float)])
