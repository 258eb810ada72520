"""Splits, probability and regression metrics, calibration. Ranks come from a range partition, never from one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.spec import Series

CLIP = 1e-15


def purged_split(df: DataFrame, series: Series, train_end: int, test_start: int, embargo: int) -> DataFrame:
    """``split`` = train, test or null; training ends ``embargo`` steps before the test starts."""
    ts = F.col(series.ts)
    cut = min(train_end, test_start - embargo * series.step_ms)
    return df.withColumn("split", F.when(ts < cut, "train").when(ts >= test_start, "test"))


def split_leaks(df: DataFrame, series: Series, embargo: int) -> DataFrame:
    """One row: last training time, first test time, and whether they are too close."""
    out = df.agg(F.max(F.when(F.col("split") == "train", F.col(series.ts))).alias("train_end"), F.min(F.when(F.col("split") == "test", F.col(series.ts))).alias("test_start"))
    return out.withColumn("leak", F.coalesce(F.col("test_start") - F.col("train_end") < embargo * series.step_ms, F.lit(False)))


def walk_forward(df: DataFrame, series: Series, folds: list[tuple[str, int, int, int]], embargo: int) -> DataFrame:
    """Rows by (fold, train_start, test_start, test_end): expanding training, bounded test; a row may be in several folds."""
    table = F.array(*(F.struct(F.lit(n).alias("fold"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c")) for n, a, b, c in folds))
    rows = df.withColumn("__f", F.explode(table))
    ts, f = F.col(series.ts), F.col("__f")
    part = F.when((ts >= f["a"]) & (ts < f["b"] - embargo * series.step_ms), "train").when((ts >= f["b"]) & (ts < f["c"]), "test")
    return rows.withColumns({"fold": f["fold"], "split": part}).where("split is not null").drop("__f")


def score_counts(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """Positives and rows per distinct score: what every rank metric needs, after map-side combine."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n"))


#: Different scores that one task scans, and the ranges into which more of them are cut.
SCAN_ROWS, RANGES = 200_000, 1024


def _range_of(cuts: Column, score: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``score``, by halving."""
    top = (RANGES - 1).bit_length() - 1
    steps = F.sequence(F.lit(top), F.lit(0), F.lit(-1))
    powers = F.array(*(F.lit(1 << k) for k in range(top + 1)))

    def passed(n: Column, k: Column) -> Column:
        further = n + F.element_at(powers, k + 1)
        return F.when(F.get(cuts, further - 1) <= score, further).otherwise(n)

    return F.aggregate(steps, F.lit(0), passed)


def cumulated(counts: DataFrame, keys: list[str], descending: bool = True, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """Running positives and rows over scores (before and with each score), without one task per key.

    A key with more than ``scan_rows`` different scores is cut into ranges that hold about equally many of them, by a
    sketch; a range's totals, few rows, are scanned and added to the scan inside each range. A row is a different score
    here, so neither outliers nor ties make a range larger than others.
    """
    rows = counts.withColumn("__k", F.struct(*keys) if keys else F.struct(F.lit(0)))  # as a struct, null keys meet too
    many = rows.groupBy("__k").agg(F.count("*").alias("__m")).where(F.col("__m") > scan_rows)
    points = [i / RANGES for i in range(1, RANGES)]
    cuts = rows.join(many, "__k", "left_semi").groupBy("__k").agg(F.percentile_approx("score", points, 20 * RANGES).alias("__cuts"))
    rows = rows.join(cuts, "__k", "left").withColumn("__r", F.coalesce(_range_of(F.col("__cuts"), F.col("score")), F.lit(0))).drop("__cuts")
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = rows.groupBy("__k", "__r").agg(F.sum("pos").alias("__p"), F.sum("n").alias("__n"))
    before = Window.partitionBy("__k").orderBy(order("__r")).rowsBetween(Window.unboundedPreceding, -1)  # ranges of a key
    carry = totals.select("__k", "__r", F.coalesce(F.sum("__p").over(before), F.lit(0)).alias("__bp"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__bn"))
    own = Window.partitionBy("__k", "__r").orderBy(order("score"))
    rows = rows.withColumns({"__op": F.sum("pos").over(own), "__on": F.sum("n").over(own)}).join(carry, ["__k", "__r"])
    return rows.select(*keys, "score", "pos", "n", (F.col("__bp") + F.col("__op")).alias("cum_pos"), (F.col("__bn") + F.col("__on")).alias("cum_n"))


def roc_auc(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Exact area by rank sums with average ranks at ties; null where a class is missing."""
    keys = keys or []
    c = cumulated(score_counts(df, label, score, keys), keys, descending=False)
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    out = c.groupBy(*keys).agg(F.sum(rank * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    return out.select(*keys, F.col("n").cast("long").alias("n"), F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Sum over scores of precision times the recall gained; ties are one step."""
    keys = keys or []
    c = cumulated(score_counts(df, label, score, keys), keys)
    return c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("cum_pos") / F.col("cum_n") * F.col("pos")), F.sum("pos").cast("double")).alias("average_precision"))


def log_loss(label: Column, p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return F.avg(-(label * F.ln(q) + (1 - label) * F.ln(1 - q)))


def brier(label: Column, p: Column) -> Column:
    return F.avg((p - label) * (p - label))


def reliability(df: DataFrame, label: str, p: str, keys: list[str] | None = None, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate): bin k holds probabilities in (k/bins, (k+1)/bins], bin 0 with zero too."""
    keys = keys or []
    b = F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)).cast("long")
    return df.where(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))


def calibration_error(df: DataFrame, label: str, p: str, keys: list[str] | None = None, bins: int = 10) -> DataFrame:
    keys = keys or []
    r = reliability(df, label, p, keys, bins)
    return r.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def calibration_buckets(df: DataFrame, label: str, p: str, edges: list[float], least: int = 20) -> DataFrame:
    """Observed rate between fixed edges, for buckets of at least ``least`` rows."""
    b = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        b = F.when((F.col(p) >= edges[i]) & (F.col(p) < edges[i + 1]), i).otherwise(b)
    out = df.withColumn("bucket", b).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))
    return out.where(F.col("n") >= least)


def binary_metrics(df: DataFrame, label: str, p: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    y, q = F.col(label).cast("double"), F.col(p)
    rows = df.where(F.col(label).isNotNull() & F.col(p).isNotNull())
    one = rows.groupBy(*keys).agg(log_loss(y, q).alias("log_loss"), brier(y, q).alias("brier"), F.avg(y).alias("base_rate"), F.avg(((q >= 0.5) == (y == 1)).cast("double")).alias("accuracy"))
    parts = [roc_auc(df, label, p, keys), average_precision(df, label, p, keys), calibration_error(df, label, p, keys)]
    for part in parts:
        one = one.join(part, keys) if keys else one.crossJoin(F.broadcast(part))  # one row each
    return one


def confusion(df: DataFrame, truth: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*(keys or []), truth, predicted).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall, F1, from the confusion counts."""
    c = confusion(df, truth, predicted)
    t = c.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("said"))
    out = t.join(p, "class", "full_outer").na.fill(0, ["support", "hit", "said"])
    precision, recall = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return out.select("class", "support", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def multiclass_metrics(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """One row: n, accuracy of the likeliest class and the mean of the classes' one-vs-rest areas; null if a class is missing.

    ``probabilities`` maps class names to their columns; equal probabilities go to the class named first. All areas
    come from one pass over rows unpivoted by class.
    """
    rows = df.where(F.col(truth).isNotNull())
    cells = F.array(*(F.struct(F.lit(k).alias("class"), (F.col(truth) == k).cast("int").alias("y"), F.col(c).alias("p")) for k, c in probabilities.items()))
    best = F.greatest(*(F.col(c) for c in probabilities.values()))
    said = F.coalesce(*(F.when(F.col(c) == best, F.lit(k)) for k, c in probabilities.items()))
    one = rows.agg(F.count("*").alias("n"), F.avg((said == F.col(truth)).cast("double")).alias("accuracy"))
    auc = roc_auc(rows.select(F.explode(cells).alias("x")).select("x.*"), "y", "p", ["class"])
    auc = auc.agg(F.when(F.count("auc") == len(probabilities), F.avg("auc")).alias("macro_auc"))
    return one.crossJoin(F.broadcast(auc))  # one row each


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    rows = df.where(a.isNotNull() & p.isNotNull())
    return rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(p - a)).alias("mae"),
        F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        F.corr(p, a).alias("ic"),
        F.avg(a).alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
        F.stddev_samp(a).alias("sd_actual"),
        F.stddev_samp(p).alias("sd_predicted"),
        F.avg((F.signum(p) == F.signum(a)).cast("double")).alias("direction_accuracy"),
    )


def average_ranks(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Join the average rank of ``value`` (from 1, ties share it) to each row."""
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("score")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("pos"))
    rank = (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias(name)
    ranks = cumulated(counts, keys, descending=False).select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("score").alias("__v"), rank)
    same = F.col(value).cast("double") == F.col("__v")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(ranks, same).select(*df.columns, name)


def rank_correlation(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Spearman: Pearson of average ranks."""
    keys = keys or []
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    rows = average_ranks(average_ranks(rows, a, keys, "__ra"), b, keys, "__rb")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__ra", "__rb").alias("spearman"))


def _placed(cells: DataFrame, keys: list[str], order: list[str], scan_rows: int) -> DataFrame:
    """``cells`` (with a count n) and __at, the rows of the same ``keys`` before each in ``order``."""
    first, *rest = order
    groups = cells.groupBy(*keys, F.col(first).cast("double").alias("score")).agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("pos"))
    found = cumulated(groups, keys, False, scan_rows).withColumn("__start", F.col("cum_n") - F.col("n"))
    found = found.select(*(F.col(k).alias(f"__g_{k}") for k in keys), F.col("score").alias("__g"), "__start")
    same = F.col(first).cast("double").eqNullSafe(F.col("__g"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__g_{k}"))
    if not rest:
        return cells.join(found, same).withColumnRenamed("__start", "__at").drop("__g", *(f"__g_{k}" for k in keys))
    inner = _placed(cells, [*keys, first], rest, scan_rows).join(found, same)
    return inner.withColumn("__at", F.col("__at") + F.col("__start")).drop("__start", "__g", *(f"__g_{k}" for k in keys))


def quantile_table(df: DataFrame, predicted: str, actual: str, tiles: int = 10, tie: str | None = None, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """(tile, n, mean predicted, mean realized) of ``tiles`` groups of equal size; leading groups take the remainder.

    Equal predictions are ordered by ``tie`` and then by ``actual``. Rows equal in all of them are one cell with a count,
    which is dealt out over the tiles that its places reach; places come from scans of counts, so that no prediction,
    however frequent, is sorted in one task.
    """
    rows = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    columns = {"__p": predicted, **({"__t": tie} if tie and tie != actual else {}), "__a": actual}
    cells = rows.groupBy(*(F.col(c).alias(k) for k, c in columns.items())).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("__total"))
    at = _placed(cells, [], list(columns), scan_rows).crossJoin(F.broadcast(total))  # one row
    size, extra = F.floor(F.col("__total") / tiles), F.col("__total") % tiles
    big = extra * (size + 1)
    tile_of = lambda pos: F.when(pos < big, F.floor(pos / (size + 1))).otherwise(extra + F.floor(F.try_divide(pos - big, size))).cast("long")
    start = lambda tile: F.when(tile < extra, tile * (size + 1)).otherwise(big + (tile - extra) * size)
    end = F.col("__at") + F.col("n")
    parts = at.withColumn("__tile", F.explode(F.sequence(tile_of(F.col("__at")), tile_of(end - 1))))
    tile = F.col("__tile")
    k = F.least(end, start(tile + 1)) - F.greatest(F.col("__at"), start(tile))
    parts = parts.select((tile + 1).alias("tile"), k.alias("__n"), F.col("__p").alias("p"), F.col("__a").alias("a"))
    mean = lambda c: F.sum(F.col(c) * F.col("__n")) / F.sum("__n")
    return parts.groupBy("tile").agg(F.sum("__n").alias("n"), mean("p").alias("mean_predicted"), mean("a").alias("mean_actual"))


def uncertainty_reliability(df: DataFrame, actual: str, predicted: str, uncertainty: str, bins: int = 5) -> DataFrame:
    """Error by bucket of uncertainty, and whether it rises with it."""
    rows = df.withColumn("__e", F.abs(F.col(predicted) - F.col(actual)))
    out = quantile_table(rows, uncertainty, "__e", bins)
    return out.withColumn("rises", F.col("mean_actual") >= F.coalesce(F.lag("mean_actual").over(Window.orderBy("tile")), F.lit(0.0)))  # ``bins`` rows


def uncertainty_summary(df: DataFrame, actual: str, predicted: str, uncertainty: str, bins: int = 5) -> DataFrame:
    """One row: rank correlation of uncertainty with the error and with a negative outcome, and whether the error rises bucket by bucket."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull() & F.col(uncertainty).isNotNull())
    rows = rows.withColumns({"__err": F.abs(F.col(predicted) - F.col(actual)), "__bad": (F.col(actual) < 0).cast("double")})
    error = rank_correlation(rows, uncertainty, "__err").select("n", F.col("spearman").alias("spearman_error"))
    adverse = rank_correlation(rows, uncertainty, "__bad").select(F.col("spearman").alias("spearman_adverse"))
    rising = uncertainty_reliability(df, actual, predicted, uncertainty, bins).agg(F.every("rises").alias("errors_monotonic"))
    return error.crossJoin(F.broadcast(adverse)).crossJoin(F.broadcast(rising))  # one row each


def top_correlations(df: DataFrame, columns: list[str], limit: int = 8) -> DataFrame:
    """The ``limit`` pairs of columns with the largest absolute correlation, all pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")
    return rows.where("corr is not null and not isnan(corr)").orderBy(F.desc(F.abs("corr")), "a", "b").limit(limit)


def mean_difference(df: DataFrame, columns: list[str], mask: Column) -> DataFrame:
    """Standardized mean difference per column between rows in and out of ``mask``: (m1 - m0) / (s1 + s0)."""
    rows = df.withColumn("__m", mask)
    long = rows.select("__m", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("__m", "x.feature", "x.v")
    on = lambda f, m: f(F.when(F.col("__m") == m, F.col("v")))
    return long.groupBy("feature").agg(F.try_divide(on(F.avg, True) - on(F.avg, False), on(F.stddev_pop, True) + on(F.stddev_pop, False)).alias("smd"), F.count(F.when(F.col("__m"), F.col("v"))).alias("n_in"), F.count(F.when(~F.col("__m"), F.col("v"))).alias("n_out"))


def gate_funnel(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(stage, gate, surviving, lost, share): rows left after each gate in turn."""
    so_far, counts = F.lit(True), []
    for k, c in gates.items():
        so_far = so_far & F.coalesce(c, F.lit(False))
        counts.append(F.count_if(so_far).alias(k))
    one = df.agg(F.count("*").alias("__all"), *counts)
    names = list(gates)
    parts = [F.struct(F.lit(i).alias("stage"), F.lit(k).alias("gate"), F.col(k).alias("surviving"), (F.col("__all" if not i else names[i - 1]) - F.col(k)).alias("lost"), F.try_divide(F.col(k), F.col("__all")).alias("share")) for i, k in enumerate(names)]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
