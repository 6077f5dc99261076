"""One model over all series, of any kind, rolled forward day by day.

A model is anything with `predict(rows) -> values`, where rows are a (series x feature) matrix
in the order of `FEATURES`; if it also has `predict_interval(rows) -> (lower, upper)`, a
forecast gets its bounds from there, and else lower = upper = mean. Linear models, trees, forests and boosted trees
of `pyspark.ml` become arrays (`portable`), which are as large as the model's own parameters
say and not as the data, so they travel with the function. All series of an Arrow batch are
predicted together, one day after the other.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.calendar import calendar_features
from larder.operators.forecast import (
    LONGEST_WINDOW, SHORTEST_HISTORY, complete, flat_level, opening_quantities, past_demand, recent_history, wave_levels,
)
from larder.operators.grid import DOUBLES, LONGS, fold, lists, matrix, unnest
from larder.operators.ridge import assemble, fit_rows
from larder.session import settle, shared_folder
from larder.tables import CALENDAR_FEATURES, FEATURES, Policy

RANKS = 10_000  # a quantile is off by at most a share of 1 / RANKS of the rows
STEPS = 512  # a feature's values are looked up at so many even ranks, to choose its bins from
BINS = [f"bin_{name}" for name in FEATURES]
GROUPS_PER_TASK = 100_000


class Linear:
    def __init__(self, weights, intercept: float):
        self.weights, self.intercept = np.asarray(weights, float), float(intercept)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.weights + self.intercept


class Trees:
    """Nodes of all trees in one set of arrays; a leaf leads to itself."""

    def __init__(self, nodes: list, weights):
        starts, count = {}, 0
        for at, node in enumerate(nodes):  # by tree, then by number within the tree
            starts.setdefault(node["tree"], at)
            count = at + 1
        begin = np.array([starts[node["tree"]] for node in nodes], np.int64)
        left, right = (np.array([node[side] for node in nodes], np.int64) for side in ("left", "right"))
        self.leaf = left < 0
        self.left = np.where(self.leaf, np.arange(count), begin + left)
        self.right = np.where(self.leaf, np.arange(count), begin + right)
        self.feature = np.maximum([node["feature"] for node in nodes], 0)
        self.threshold = np.array([node["threshold"] or 0.0 for node in nodes], float)
        self.value = np.array([node["prediction"] for node in nodes], float)
        self.roots = np.array(list(starts.values()), np.int64)
        self.weights = np.asarray(weights, float)

    def on_values(self, cuts: list[np.ndarray]) -> Trees:
        """The trees for a feature's values, where they were fitted on the numbers of its bins."""
        self.threshold = np.array([cuts[f][int(t)] for f, t in zip(self.feature, self.threshold, strict=True)])
        return self

    def predict(self, rows: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        place = np.arange(len(rows))[:, None]
        while not self.leaf[at].all():
            at = np.where(rows[place, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at] @ self.weights


class WithOffsets:
    """A model whose interval is its prediction plus two fixed offsets."""

    def __init__(self, model, low: float, high: float):
        self.model, self.low, self.high = model, low, high

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return self.model.predict(rows)

    def predict_interval(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = self.model.predict(rows)
        return mean + self.low, mean + self.high


def portable(spark, fitted):
    """The arrays of a linear model, tree, forest or boosted trees fitted by `pyspark.ml`.

    Trees are read from the table that the model is saved as.
    """
    if hasattr(fitted, "coefficients"):
        return Linear(fitted.coefficients.toArray(), fitted.intercept)
    if not hasattr(fitted, "toDebugString"):
        raise ValueError(f"no arrays for {type(fitted).__name__}; give an object with predict(rows)")
    folder = shared_folder(spark, "trees")
    fitted.save(folder)
    saved = spark.read.parquet(f"{folder}/data")
    several = "nodeData" in saved.columns
    nodes = saved.select(F.col("treeID").alias("tree"), "nodeData.*") if several else saved.withColumn("tree", F.lit(0))
    rows = nodes.select(
        "tree", "id", "prediction", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    ).orderBy("tree", "id").collect()
    weights = np.asarray(fitted.treeWeights if several else [1.0], float)
    boosted = type(fitted).__name__.startswith("GBT")
    return Trees(rows, weights if boosted else weights / weights.sum())


def residual_offsets(residuals: DataFrame, alpha: float, ranks: int = RANKS) -> tuple[float, float]:
    """Quantiles of `resid` over all rows, from sketches that are merged: bounded at any number of rows."""
    return tuple(residuals.select(
        F.percentile_approx("resid", [alpha / 2, 1 - alpha / 2], ranks).alias("q")).first()["q"] or (0.0, 0.0))


def by_bins(estimator) -> bool:
    """Whether rows in the same bins may go into the fit as their number and mean: a tree's gains and
    leaves, and the residuals that boosting goes on with, are the same then, as long as errors are
    squared, every row takes part and no rule counts unweighted rows."""
    if not isinstance(estimator, (GBTRegressor, DecisionTreeRegressor)) or estimator.isSet("weightCol"):
        return False
    boosted = isinstance(estimator, GBTRegressor)
    plain = not boosted or (
        estimator.getLossType() == "squared" and estimator.getSubsamplingRate() == 1.0 and not estimator.isSet("validationIndicatorCol"))
    return plain and estimator.getMinInstancesPerNode() == 1


def cut_points(rows: DataFrame, most: int) -> list[np.ndarray]:
    """For every feature at most `most` thresholds, halfway between values at even ranks of all rows.

    A feature that has no more values than that keeps them all apart, if each is its smallest, its
    largest or that of one row in STEPS.
    """
    ranks = [i / STEPS for i in range(STEPS + 1)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), ranks, RANKS).alias(f) for f in FEATURES]).first()
    cuts = []
    for name in FEATURES:
        values = np.unique(found[name])
        values = values[np.isfinite(values)]
        kept = values[np.linspace(0, len(values) - 1, min(len(values), most + 1)).round().astype(int)]
        between = np.unique(kept[:-1] / 2 + kept[1:] / 2)
        cuts.append(between if len(between) else np.array([0.0]))  # all in one bin or two, whichever: nothing to tell apart
    return cuts


def binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Adds the number of each feature's bin; a value that equals a threshold belongs below it, as in a tree."""
    splits = [[-np.inf, *np.nextafter(c, np.inf).tolist(), np.inf] for c in cuts]
    found = Bucketizer(splitsArray=splits, inputCols=list(FEATURES), outputCols=BINS).transform(rows)
    return found.withColumns({name: F.col(name).cast("int") for name in BINS})  # plain numbers: trees would take its buckets for categories


def fit_by_bins(rows: DataFrame, estimator):
    """(fitted, cuts): trees fitted on one row per combination of bins that occurs, weighted by its number of rows.

    Every row counts. Combinations are bounded by the bins and grow far more slowly than the rows, so what
    `pyspark.ml` keeps in memory from pass to pass does too.
    """
    cuts = cut_points(rows, estimator.getMaxBins() - 1)
    groups = settle(binned(rows, cuts).groupBy(*BINS).agg(
        F.count("*").cast("double").alias("weight"), F.avg("qty_sold").alias("qty_sold")), "bins")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, ceil(groups.count() / GROUPS_PER_TASK))
    inputs = _bins_assembled(groups.repartition(tasks, *BINS)).select("features", "qty_sold", "weight")
    return fit_rows(inputs, estimator.copy({estimator.getParam("weightCol"): "weight"})), cuts


def _bins_assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=BINS, outputCol="features").transform(rows)


def fit_portable(training: DataFrame, estimator=None, alpha: float = 1.0, interval_alpha: float | None = None):
    """One model over all series, ready to be rolled forward; None without any training row.

    Any `pyspark.ml` regressor (ridge with this alpha by default). With `interval_alpha` it has an
    interval that leaves out that share of its residuals. Trees that allow it (`by_bins`) are fitted on
    the combinations of their features' bins.
    """
    if by_bins(estimator):
        rows = settle(training.select(*FEATURES, F.col("qty_sold").cast("double").alias("qty_sold")), "pooled")
        if rows.isEmpty():
            return None
        fitted, cuts = fit_by_bins(rows, estimator)
        model = portable(training.sparkSession, fitted).on_values(cuts)
        return _with_interval(model, lambda: fitted.transform(_bins_assembled(binned(rows, cuts))), interval_alpha)
    rows = settle(assemble(training).select("features", "qty_sold"), "pooled")
    if rows.isEmpty():
        return None
    fitted = fit_rows(rows, estimator, alpha)
    return _with_interval(portable(training.sparkSession, fitted), lambda: fitted.transform(rows), interval_alpha)


def _with_interval(model, predicted, interval_alpha: float | None):
    if interval_alpha is None:
        return model
    residuals = predicted().select((F.col("qty_sold") - F.col("pred")).alias("resid"))
    return WithOffsets(model, *residual_offsets(residuals, interval_alpha))


def _roll(model):
    def step(batch) -> dict:
        lengths = batch["recent"].value_lengths().to_numpy()
        level, by_model = matrix(batch["level"]), batch["by_model"].to_numpy(zero_copy_only=False)
        steps, (rows, horizon) = batch["level"].value_lengths().to_numpy(), level.shape
        calendar = matrix(batch["calendar"]).reshape(rows, horizon, len(CALENDAR_FEATURES))
        sold = opening_quantities(batch["recent"], horizon)
        mean, lower, upper = level.copy(), level.copy(), level.copy()
        for h in range(horizon):
            if by_model.any():
                inputs = np.column_stack([calendar[:, h], *past_demand(sold, lengths, h)])[by_model]
                mean[by_model, h] = found = np.asarray(model.predict(inputs), float)
                bounds = model.predict_interval(inputs) if hasattr(model, "predict_interval") else (found, found)
                lower[by_model, h], upper[by_model, h] = bounds
            sold[:, LONGEST_WINDOW + h] = np.maximum(0.0, np.rint(mean[:, h]))
        whole = sold[:, LONGEST_WINDOW:].astype(np.int64)
        return {"qty_sold": lists(whole, steps), "pred_mean": lists(mean, steps),
                "pred_lower": lists(lower, steps), "pred_upper": lists(upper, steps)}

    return step


def forecast_pooled(history: DataFrame, model, policy: Policy, min_rows: int = SHORTEST_HISTORY) -> DataFrame:
    """forecast(series, date, qty_sold, pred_mean, pred_lower, pred_upper, forecast_method).

    Every series with `min_rows` known quantities goes by `model`. Without a model (None), with fewer
    rows or a gap in the latest ones it is `flat`, and without any known quantity a `wave`, both
    without bounds, as in `forecast_with`.
    """
    by_model = (F.size("recent") >= min_rows) & complete() & F.lit(model is not None)
    method = F.when(by_model, "model").when(F.exists("recent", lambda q: q.isNotNull()), "flat").otherwise("wave")
    days = F.sequence("start", "end")
    flat = F.array_repeat(flat_level(), F.size(days))
    flags = F.transform(days, lambda day: F.array(*[c.cast("double") for c in calendar_features(day).values()]))
    level = F.when(F.col("forecast_method") == "wave", wave_levels()).otherwise(flat)
    # the level first: in one select its `recent` would be the new column of that name
    levelled = recent_history(history, policy).withColumn("forecast_method", method).withColumn("level", level)
    inputs = levelled.select(
        "series", "start", "forecast_method", "level", by_model.alias("by_model"),
        F.when(by_model, F.col("recent")).otherwise(F.array(F.lit(0.0))).alias("recent"),
        F.flatten(flags).alias("calendar"),
    )
    kept, bounds = ["start", "forecast_method"], ["pred_mean", "pred_lower", "pred_upper"]
    folded = fold(inputs, _roll(model), {"qty_sold": LONGS, **dict.fromkeys(bounds, DOUBLES)}, keep=["series", *kept])
    rows = unnest(folded, ["qty_sold", *bounds], keep=kept)
    modelled = F.col("forecast_method") == "model"
    return rows.select(
        "series", F.date_add("start", F.col("step")).alias("date"), "qty_sold",
        *[F.when(modelled, F.col(name)).alias(name) for name in bounds], "forecast_method")
