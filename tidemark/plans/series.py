"""Long series as many tasks: row numbers, halo chunks for bounded frames, block scans for unbounded ones.

No operator here puts a whole series in one task. A row number comes from counts per time bucket, scanned over the
buckets. A halo chunk is a run of rows with copies of its neighbours' edges, so that a bounded frame is exact inside.
A block scan is a scan inside each chunk plus the carry of all chunks before it, of which there is one row a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.spec import Series

INDEX, CHUNK = "row_idx", "__chunk"


def with_row_index(df: DataFrame, series: Series, name: str = INDEX) -> DataFrame:
    """Add the 0-based position of each row in its series, without sorting a series in one task.

    Rows are numbered inside buckets of ``chunk`` steps; a bucket's offset is the count of rows in buckets before it.
    Timestamps must be unique in a series (see keep_last). A column of that name is taken as the numbering.
    """
    if name in df.columns:
        return df
    bucket = F.floor(F.col(series.ts) / (series.chunk * series.step_ms)).cast("long")
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy(*series.keys, "__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*series.keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*series.keys, "__bucket", before.alias("__before"))
    numbered = rows.withColumn("__own", F.row_number().over(series.window("__bucket")) - 1)
    out = numbered.join(offsets, [*series.keys, "__bucket"])
    return out.withColumn(name, F.col("__before") + F.col("__own")).drop("__bucket", "__before", "__own")


def with_chunks(df: DataFrame, series: Series, back: int, ahead: int, contiguous: bool = False) -> DataFrame:
    """Copy rows into the chunks whose frames reach them: columns row_idx and __chunk.

    ``contiguous`` takes the position from the timestamp alone (a gap-free grid): no counting pass.
    """
    if contiguous:
        rows = df.withColumn(INDEX, F.floor(F.col(series.ts) / series.step_ms).cast("long"))
    else:
        rows = with_row_index(df, series)
    first = F.floor((F.col(INDEX) - ahead) / series.chunk)
    last = F.floor((F.col(INDEX) + back) / series.chunk)
    if not contiguous:
        first = F.greatest(first, F.lit(0))
    return rows.withColumn(CHUNK, F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def framed(df: DataFrame, series: Series, back: int, ahead: int, columns: Callable[[WindowSpec], Mapping[str, Column]], contiguous: bool = False) -> DataFrame:
    """``df`` with window columns whose frames reach ``back`` rows behind and ``ahead`` rows ahead.

    ``columns`` gets the window (keys and chunk, by time) and returns named columns; all share one shuffle and sort.
    Several steps that need each other's results can nest calls on the returned frame of one ``staged`` call.
    """
    return staged(df, series, back, ahead, [columns], contiguous)


def staged(df: DataFrame, series: Series, back: int, ahead: int, steps: list[Callable[[WindowSpec], Mapping[str, Column]]], contiguous: bool = False) -> DataFrame:
    """Like ``framed``, in steps that may use columns of earlier steps; ``back`` and ``ahead`` cover all steps together."""
    rows = with_chunks(df, series, back, ahead, contiguous)
    w = series.window(CHUNK)
    for step in steps:
        rows = rows.withColumns(dict(step(w)))
    own = F.floor(F.col(INDEX) / series.chunk) == F.col(CHUNK)
    return rows.where(own).drop(CHUNK, INDEX)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def ahead(w: WindowSpec, h: int) -> WindowSpec:
    return w.rowsBetween(1, h)


def min_rows(value: Column, over: WindowSpec, aggregate: Callable[[Column], Column], least: int) -> Column:
    """An aggregate over a frame, null while the frame holds fewer than ``least`` values."""
    return F.when(F.count(value).over(over) >= least, aggregate(value).over(over))


def block_scan(df: DataFrame, series: Series, values: Mapping[str, Column], how: str = "sum") -> DataFrame:
    """Running sum, max, min or last non-null of a series: ``values`` maps result names to columns.

    Inside a time bucket it is a window; the buckets' totals, one row each, are scanned and joined back.
    """
    pick = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least, "last": lambda a, b: F.coalesce(b, a)}[how]
    rows = df.withColumn("__bucket", F.floor(F.col(series.ts) / (series.chunk * series.step_ms)).cast("long"))
    rows = rows.withColumns({f"__v_{k}": c for k, c in values.items()})
    w = series.window("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"__s_{k}": pick(F.col(f"__v_{k}")).over(w) for k in values})
    if how == "last":
        totals = rows.groupBy(*series.keys, "__bucket").agg(*(F.max_by(F.col(f"__v_{k}"), F.when(F.col(f"__v_{k}").isNotNull(), F.col(series.ts))).alias(f"__t_{k}") for k in values))
    else:
        totals = rows.groupBy(*series.keys, "__bucket").agg(*(pick(F.col(f"__v_{k}")).alias(f"__t_{k}") for k in values))
    carry = Window.partitionBy(*series.keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*series.keys, "__bucket", *(pick(F.col(f"__t_{k}")).over(carry).alias(f"__c_{k}") for k in values))
    out = local.join(carried, [*series.keys, "__bucket"])
    out = out.withColumns({k: join(F.col(f"__c_{k}"), F.col(f"__s_{k}")) for k in values})
    return out.drop("__bucket", *(f"__{x}_{k}" for k in values for x in "vsc"))


def _weakened(factor: float) -> Callable[[Column, Column], Column]:
    return lambda total, end: total * F.lit(factor) + end


def ema(df: DataFrame, series: Series, spans: Mapping[str, tuple[Column, int, int]], adjust: bool = False, keep_index: bool = False) -> DataFrame:
    """Exponential means: name -> (column, span, rows needed). Null until that many rows.

    y[k] = (1-a) y[k-1] + a x[k] is affine in what comes in, so a chunk is (1-a)^m * carry + its own part. Inside a
    chunk the own part is a sum of x * (1-a)^-k, which stays finite because chunks are short enough for the span.
    ``adjust`` divides by the weights so far instead of starting from the first value; ``keep_index`` keeps row_idx.
    """
    shortest = min(s for _, s, _ in spans.values())
    chunk = max(16, min(series.chunk, int(200 * (shortest + 1) / 2)))
    rows = with_row_index(df, series).withColumn("__block", F.floor(F.col(INDEX) / chunk).cast("long"))
    k = F.col(INDEX) % chunk
    w = series.window("__block").rowsBetween(Window.unboundedPreceding, 0)
    local, totals = {}, {}
    for name, (x, span, _) in spans.items():
        q = 1 - 2 / (span + 1)
        weight = F.when(F.col(INDEX) == 0, F.lit(1.0)).otherwise(F.lit(1 - q)) if not adjust else F.lit(1.0)
        local[f"__y_{name}"] = F.sum(x * weight * F.pow(F.lit(q), -k)).over(w) * F.pow(F.lit(q), k)
        if adjust:
            local[f"__d_{name}"] = F.sum(F.pow(F.lit(q), -k)).over(w) * F.pow(F.lit(q), k)
    rows = rows.withColumns(local)
    parts = [*local]
    q_of = {p: 1 - 2 / (spans[p[4:]][1] + 1) for p in parts}
    ends = rows.groupBy(*series.keys, "__block").agg(F.count("*").alias("__m"), *(F.max_by(p, F.col(INDEX)).alias(p.replace("__", "__e", 1)) for p in parts))
    # the carry of a block: each earlier block's end, weakened by the rows between; blocks are full but the last, and
    # the frame ends where a weight is no longer a positive double
    carried = ends
    for p in parts:
        e = p.replace("__", "__e", 1)
        deep = max(1, int(-745 / (chunk * math.log(q_of[p]))) + 1)
        past = Window.partitionBy(*series.keys).orderBy("__block").rowsBetween(-deep, -1)
        powers = F.collect_list(F.col(e)).over(past)
        carried = carried.withColumn(p.replace("__", "__c", 1), F.aggregate(powers, F.lit(0.0), _weakened(q_of[p] ** chunk)))
    carried = carried.select(*series.keys, "__block", *(p.replace("__", "__c", 1) for p in parts))
    out = rows.join(carried, [*series.keys, "__block"])
    for name, (_, span, least) in spans.items():
        q = 1 - 2 / (span + 1)
        full = lambda p: F.col(p) + F.pow(F.lit(q), k + 1) * F.col(p.replace("__", "__c", 1))  # noqa: E731, B023
        y = full(f"__y_{name}") / full(f"__d_{name}") if adjust else full(f"__y_{name}")
        out = out.withColumn(name, F.when(F.col(INDEX) >= least - 1, y))
    return out.drop("__block", *([] if keep_index else [INDEX]), *parts, *(p.replace("__", "__c", 1) for p in parts))
