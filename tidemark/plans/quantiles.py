"""Exact order statistics of groups of any size, without sorting a group in one task.

A rank is looked for in a range of values. While a range may hold more than ``small`` different values, a sketch of
the range (of bounded size, merged before the shuffle) gives two values that enclose the rank, and a count of the rows
below and between them gives the new range and its place among the ranks. A sketch only proposes; the counts are exact.
At last the different values of each small range are counted, scanned in order, and read off at the ranks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.shared import write_table

#: Different values that one task sorts; cells of a sketch, and the error of its ranks as one in so many.
SMALL_RANGE, CELLS, SKETCH_ACCURACY = 500_000, 500, 10_000


def _inside(lo: str = "lo", hi: str = "hi", strictly: bool = False) -> Column:
    v, lo, hi = F.col("v"), F.col(lo), F.col(hi)
    above, below = (v > lo, v < hi) if strictly else (v >= lo, v <= hi)
    return F.coalesce(above, F.lit(True)) & F.coalesce(below, F.lit(True))


def _narrowed(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """Smaller ranges for ``wide`` (g, rank, lo, hi, before, inner): two neighbouring cells of a sketch of each range."""
    ranges = wide.groupBy("g", "lo", "hi").agg(F.first("before").alias("before"))
    points = [i / CELLS for i in range(CELLS + 1)]
    held = rows.join(ranges, "g").where(_inside())
    sketch = held.groupBy("g", "lo", "hi").agg(F.count("*").alias("n"), F.percentile_approx("v", points, SKETCH_ACCURACY).alias("cells"))
    on = (F.col("w.g") == F.col("s.g")) & F.col("w.lo").eqNullSafe(F.col("s.lo")) & F.col("w.hi").eqNullSafe(F.col("s.hi"))
    at = (F.col("rank") - F.col("before")) / F.greatest(F.col("n") - 1, F.lit(1)) * CELLS
    cell = lambda i: F.get("cells", F.greatest(F.lit(0), F.least(F.lit(CELLS), i)).cast("int"))
    chosen = wide.alias("w").join(sketch.alias("s"), on).select("w.g", "rank", cell(F.floor(at) - 1).alias("lo"), cell(F.ceil(at) + 1).alias("hi"))
    chosen = write_table(chosen, "proposals")  # a sketch depends on the order in which its parts arrive, and is used twice
    counts = rows.join(chosen.select("g", "lo", "hi").distinct(), "g").groupBy("g", "lo", "hi")
    counts = counts.agg(F.count_if(F.col("v") < F.col("lo")).alias("before"), F.count_if(_inside()).alias("__in"), F.count_if(_inside(strictly=True)).alias("inner"))
    found = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("__in"))
    checked = F.when(found, F.col("rank")).otherwise(F.raise_error(F.lit("a sketch missed its rank")).cast("long"))
    return chosen.join(counts, ["g", "lo", "hi"]).select("g", checked.alias("rank"), "lo", "hi", "before", "inner")


def exact_quantiles(df: DataFrame, keys: list[str], values: Mapping[str, Column], points: Mapping[str, tuple[str, float]], small: int = SMALL_RANGE) -> DataFrame:
    """``keys`` and a column for each of ``points``: name -> (name in ``values``, quantile between 0 and 1).

    Between two ranks the value is interpolated, as by ``percentile``. Null values count as absent; a group without a
    value in any of ``values`` has no row; ties are counted, not compared. Null keys are a group.
    """
    names = list(values)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), values[name].cast("double").alias("v")) for i, name in enumerate(names))))
    long = df.select(*keys, each.alias("__e")).where("__e.v is not null")
    rows = write_table(long.select(F.struct(*keys, F.col("__e.m").alias("m")).alias("g"), F.col("__e.v").alias("v")), "values")
    sizes = write_table(rows.groupBy("g").agg(F.count("*").alias("n")), "value-counts")
    wanted = F.array(*(F.struct(F.lit(names.index(name)).alias("m"), F.lit(float(q)).alias("q")) for name, q in points.values()))
    of_group = F.transform(F.filter(wanted, lambda p: p["m"] == F.col("g.m")), lambda p: p["q"] * (F.col("n") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(of_group, lambda at: F.array(F.floor(at), F.ceil(at)))))
    none = F.lit(None).cast("double")
    ranges = sizes.select("g", F.explode(ranks).alias("rank"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("before"), F.col("n").alias("inner"))
    while (most := ranges.agg(F.max("inner")).first()[0]) is not None and most > small:
        wide = F.col("inner") > small
        ranges = write_table(ranges.where(~wide).unionByName(_narrowed(rows, ranges.where(wide))), "ranges")
    at_once = ranges.groupBy("g", "lo", "hi", "before").agg(F.collect_set("rank").alias("ranks"))
    cells = rows.join(at_once, "g").where(_inside()).groupBy("g", "lo", "hi", "v").agg(F.count("*").alias("c"), F.first("before").alias("before"), F.first("ranks").alias("ranks"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # a small range
    read = cells.withColumn("upto", upto).select("g", "v", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c")))).alias("rank"))
    found = read.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")).join(sizes, "g")
    columns = {}
    for out, (name, q) in points.items():
        place = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.col("at")[F.floor(place)], F.col("at")[F.ceil(place)]
        value = F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))
        columns[out] = F.max(F.when(F.col("g.m") == names.index(name), value))
    return found.groupBy(*(F.col(f"g.`{k}`").alias(k) for k in keys)).agg(*(c.alias(out) for out, c in columns.items()))


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], values: Mapping[str, Column], points: Mapping[str, tuple[str, float]], small: int = SMALL_RANGE) -> DataFrame:
    """``grouped`` (a row for each group of ``keys``) and the quantiles of the groups' rows in ``df``."""
    if not keys:
        return with_quantiles(grouped.withColumn("__all", F.lit(1)), df.withColumn("__all", F.lit(1)), ["__all"], values, points, small).drop("__all")
    found = exact_quantiles(df, keys, values, points, small).withColumnsRenamed({k: f"__q_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__q_{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return grouped.join(found, condition, "left").drop(*(f"__q_{k}" for k in keys))
