"""Models: rule baselines, linear fits of many groups and heads at once, and on Spark ML logistic, boosted and multi-class ones.

Nulls are dropped before a fit, never imputed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.metrics import binary_metrics, regression_metrics
from tidemark.operators.quality import finite_rows
from tidemark.plans.series import framed, trailing
from tidemark.spec import Series


def rule_baselines(df: DataFrame, series: Series, label: str, horizon: int, window: int = 1440) -> DataFrame:
    """Momentum sign, EMA trend sign, and the trailing frequency of the label over rows whose label is known by now."""

    def columns(w):
        known = F.lag((F.col(label) > 0).cast("double"), horizon + 1).over(w)
        return {"base_momentum": F.signum(F.col("close") - F.lag("close", horizon).over(w)), "__known": known}

    rows = framed(df, series, horizon + 1, 0, columns)
    rows = framed(rows, series, window, 0, lambda w: {"base_trailing": F.avg("__known").over(trailing(w, window))}).drop("__known")
    return rows.withColumn("base_trend", F.signum(F.col("ema_20") - F.col("ema_200"))) if {"ema_20", "ema_200"} <= set(rows.columns) else rows


def _features(columns: list[str], scale: bool) -> list:
    assemble = VectorAssembler(inputCols=columns, outputCol="__raw" if scale else "features", handleInvalid="error")
    return [assemble, StandardScaler(inputCol="__raw", outputCol="features", withMean=True)] if scale else [assemble]


def _usable(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    return finite_rows(df, [*columns, label])


def fit_ridge(df: DataFrame, columns: list[str], label: str, penalty: float = 1.0) -> PipelineModel:
    return Pipeline(stages=[*_features(columns, True), LinearRegression(labelCol=label, regParam=penalty, elasticNetParam=0.0, predictionCol="prediction")]).fit(_usable(df, columns, label))


def fit_logistic(df: DataFrame, columns: list[str], label: str, penalty: float = 0.01, classes: int = 2) -> PipelineModel:
    family = "binomial" if classes == 2 else "multinomial"
    return Pipeline(stages=[*_features(columns, True), LogisticRegression(labelCol=label, regParam=penalty, family=family)]).fit(_usable(df, columns, label))


def fit_boosted(df: DataFrame, columns: list[str], label: str, classifier: bool, seed: int = 7, trees: int = 20, depth: int = 4) -> PipelineModel:
    kind = GBTClassifier if classifier else GBTRegressor
    return Pipeline(stages=[*_features(columns, False), kind(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)]).fit(_usable(df, columns, label))


def fit_classes(df: DataFrame, columns: list[str], label: str, classes: Iterable[int] = (0, 1, 2)) -> PipelineModel:
    """Multinomial logistic regression over all of ``classes``, also those a fold has no row of: they get no weight."""
    n = max(3, max(classes) + 1)
    known = {"ml_attr": {"name": label, "type": "nominal", "num_vals": n}}
    return fit_logistic(df.withColumn(label, F.col(label).cast("double").alias(label, metadata=known)), columns, label, classes=n)


def score(model: PipelineModel, df: DataFrame, columns: list[str]) -> DataFrame:
    """Predictions, and probabilities as an array where the model has them."""
    out = model.transform(finite_rows(df, columns))
    if "probability" in out.columns:
        out = out.withColumn("probabilities", vector_to_array("probability"))
    return out.drop("features", "__raw", "rawPrediction", "probability")


def linear_fits(df: DataFrame, keys: list[str], columns: list[str], labels: list[str], penalty: float = 1.0) -> DataFrame:
    """(keys, head, n, label_mean, intercept, weights): a ridge regression of each label in each group, in one job.

    Tasks add up products of features and labels, a matrix for each group and label that they see; the matrices are
    summed by group and label and solved there: (X'X + penalty) w = X'y about the means, the intercept free. Rows with a
    feature that is null or not finite are left out, for each label also those without it. A group without rows of a
    label has no row for it; features without variation get the smallest weights that fit.
    """
    d = len(columns)
    names = [f"__x{i}" for i in range(d)] + [f"__y{i}" for i in range(len(labels))]
    rows = finite_rows(df, columns).select(*keys, *(F.col(c).cast("double").alias(n) for c, n in zip([*columns, *labels], names, strict=True)))
    kinds = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    part_schema = T.StructType([*kinds, T.StructField("head", T.StringType()), T.StructField("products", T.ArrayType(T.DoubleType()))])
    fit_schema = T.StructType([*kinds, *(T.StructField(n, k) for n, k in (("head", T.StringType()), ("n", T.LongType()), ("label_mean", T.DoubleType()), ("intercept", T.DoubleType()), ("weights", T.ArrayType(T.DoubleType()))))])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def frame() -> pd.DataFrame:
            out = pd.DataFrame([(*k, m.ravel().tolist()) for k, m in held.items()], columns=part_schema.names)
            held.clear()
            return out

        for pdf in batches:
            for key, own in pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]:
                x = own[names[:d]].to_numpy(float)
                for i, head in enumerate(labels):
                    y = own[f"__y{i}"].to_numpy(float)
                    ok = np.isfinite(y)
                    if ok.any():
                        z = np.column_stack([np.ones(ok.sum()), x[ok], y[ok]])
                        at = (*(None if pd.isna(k) else k for k in key), head)
                        held[at] = held.get(at, 0) + z.T @ z
            if len(held) >= 1000:
                yield frame()
        if held:
            yield frame()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, products in pdf[part_schema.names].itertuples(index=False):
                m = np.array([p["v"] for p in products]).reshape(d + 2, d + 2)
                n = m[0, 0]
                mean = m[0, 1:] / n
                about = m[1:, 1:] - n * np.outer(mean, mean)
                w = np.linalg.lstsq(about[:d, :d] + penalty * np.eye(d), about[:d, d], rcond=None)[0]
                out.append((*key, int(n), mean[d], float(mean[d] - w @ mean[:d]), w.tolist()))
            yield pd.DataFrame(out, columns=fit_schema.names)

    parts = rows.mapInPandas(add_up, part_schema).select(*keys, "head", F.posexplode("products").alias("pos", "v"))
    sums = parts.groupBy(*keys, "head", "pos").agg(F.sum("v").alias("v"))
    matrices = sums.groupBy(*keys, "head").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("products"))  # a matrix
    return matrices.mapInPandas(solve, fit_schema)


def linear_scores(df: DataFrame, fits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``df`` with finite features and a column pred_<head> for each head of their group; null where it has no fit."""
    heads = [r[0] for r in fits.select("head").distinct().orderBy("head").collect()]  # names of labels
    per_group = fits.groupBy(*keys).agg(*(F.first(F.when(F.col("head") == h, F.struct("intercept", "weights")), ignorenulls=True).alias(f"__{h}") for h in heads))
    rows = finite_rows(df, columns)
    rows = rows.join(per_group, keys, "left") if keys else rows.crossJoin(F.broadcast(per_group))  # one row
    weigh = lambda h: sum((F.get(F.col(f"__{h}.weights"), i) * F.col(c) for i, c in enumerate(columns)), F.col(f"__{h}.intercept"))
    return rows.withColumns({f"pred_{h}": weigh(h) for h in heads}).drop(*(f"__{h}" for h in heads))


def fit_ensemble(df: DataFrame, columns: list[str], label: str, seeds: Iterable[int] = (1, 2, 3)) -> list[PipelineModel]:
    return [fit_boosted(df, columns, label, False, seed=s, trees=10) for s in seeds]


def score_ensemble(models: list[PipelineModel], df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean prediction and its standard deviation among the models as uncertainty."""
    names = []
    for i, m in enumerate(models):
        df = score(m, df, columns).withColumnRenamed("prediction", f"__p{i}")
        names.append(f"__p{i}")
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    var = sum(((F.col(n) - mean) * (F.col(n) - mean) for n in names[1:]), (F.col(names[0]) - mean) * (F.col(names[0]) - mean)) / len(names)
    return df.withColumns({"prediction": mean, "uncertainty": F.sqrt(var)}).drop(*names)


def timeout_fits(df: DataFrame, keys: list[str], columns: list[str], label: str, outcome: str = "outcome", least: int = 200, penalty: float = 1.0) -> DataFrame:
    """Fits of ``label`` on timeouts (head 'timeout'), or a mean where a group has fewer than ``least`` of them.

    The mean is that of its timeouts, and of all its rows where it has none.
    """
    rows = finite_rows(df, [*columns, label])
    timed = F.col(outcome) == "TIMEOUT"
    means = rows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(timed, F.col(label))), F.avg(label)).alias("__mean"), F.count_if(timed).alias("__n"))
    fits = linear_fits(rows.where(timed), keys, columns, [label], penalty).drop("n", "label_mean", "head")
    joined = means.join(fits, keys, "left") if keys else means.join(fits, F.lit(True), "left")  # without keys: one row each
    enough = F.col("__n") >= least
    flat = F.array_repeat(F.lit(0.0), len(columns))
    return joined.select(
        *keys,
        F.lit("timeout").alias("head"),
        F.col("__n").alias("n"),
        F.col("__mean").alias("label_mean"),
        F.when(enough, F.col("intercept")).otherwise(F.col("__mean")).alias("intercept"),
        F.when(enough, F.col("weights")).otherwise(flat).alias("weights"),
    )


def fold_benchmark(folds: DataFrame, columns: list[str], label: str, classifier: bool = False) -> DataFrame:
    """Fit on each fold's training rows, score its test rows: one row of metrics per fold.

    The linear fits of all folds are one job. A classifier is fitted iteratively, fold by fold.
    """
    if not classifier:
        fits = linear_fits(folds.where("split = 'train'"), ["fold"], columns, [label])
        scored = linear_scores(folds.where("split = 'test'"), fits, ["fold"], columns)
        if f"pred_{label}" not in scored.columns:
            raise ValueError("no fold has training rows")
        return regression_metrics(scored, label, f"pred_{label}", ["fold"])
    parts = []
    for (fold,) in folds.select("fold").distinct().orderBy("fold").collect():  # the fold table's names
        train, test = (finite_rows(folds.where((F.col("fold") == fold) & (F.col("split") == s)), [*columns, label]) for s in ("train", "test"))
        if not train.isEmpty():
            out = score(fit_logistic(train, columns, label), test, columns).withColumn("p", F.get("probabilities", 1))
            parts.append(binary_metrics(out, label, "p").withColumn("fold", F.lit(fold)))
    if not parts:
        raise ValueError("no fold has training rows")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
