"""Standardised ridge regression: per series from moments, or pooled with pyspark.ml.

The per-series fit needs only sums of products, so the rows stay in the JVM: one
aggregation yields a row of moments per series, and a batched 11x11 solve turns those
rows into coefficients. Demand columns are shifted by the series' mean first, which
keeps the sums of squares free of cancellation.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.grid import DOUBLES, LONGS, fold, nest, unnest
from larder.operators.spine import by_day, whole_series
from larder.session import settle
from larder.tables import ALPHA_GRID, CV_FOLDS, DEMAND_FEATURES, FEATURES

P = len(FEATURES)
PAIRS = list(combinations_with_replacement(range(P), 2))
IS_DEMAND = np.array([name in DEMAND_FEATURES for name in FEATURES], dtype=float)

MODEL_COLUMNS = {
    "n_train": T.LongType(),
    "alpha": T.DoubleType(),
    "intercept": T.DoubleType(),
    "coef": T.ArrayType(T.DoubleType()),
}


def moments(training: DataFrame, *extra_keys: str) -> DataFrame:
    """(series, *extra_keys, n, level, sums): counts and sums of shifted products.

    `sums` holds the feature sums, the pairwise products, the target sum and the
    feature-target products. They add up across disjoint sets of one series' rows.
    """
    level = F.avg("qty_sold").over(whole_series())
    shifted = training.withColumn("level", level)

    def centred(name: str) -> Column:
        value = F.col(name).cast("double")
        return value - F.col("level") if name in (*DEMAND_FEATURES, "qty_sold") else value

    columns = shifted.select(
        "series", *extra_keys, "level",
        *[centred(name).alias(f"x{i}") for i, name in enumerate(FEATURES)],
        centred("qty_sold").alias("y"),
    )
    x = [F.col(f"x{i}") for i in range(P)]
    y = F.col("y")
    totals = [*x, *[x[i] * x[j] for i, j in PAIRS], y, *[xi * y for xi in x]]
    return (
        columns.groupBy("series", *extra_keys)
        .agg(
            F.count("*").alias("n"),
            F.first("level").alias("level"),
            *[F.sum(total).alias(f"s{i}") for i, total in enumerate(totals)],
        )
        .select(
            "series", *extra_keys, "n", "level",
            F.array(*[f"s{i}" for i in range(len(totals))]).alias("sums"),
        )
    )


def solve(n: np.ndarray, level: np.ndarray, sums: np.ndarray, alpha: float):
    """Ridge on standardised inputs for a stack of moment rows: (intercepts, coefficients)."""
    count = np.maximum(n, 1).astype(float)
    mean_x = sums[:, :P] / count[:, None]
    products = np.empty((len(n), P, P))
    for at, (i, j) in enumerate(PAIRS):
        products[:, i, j] = products[:, j, i] = sums[:, P + at]
    mean_y = sums[:, P + len(PAIRS)] / count
    with_y = sums[:, P + len(PAIRS) + 1:]

    cov = products - count[:, None, None] * mean_x[:, :, None] * mean_x[:, None, :]
    cov_y = with_y - (count * mean_y)[:, None] * mean_x
    raw_mean = mean_x + level[:, None] * IS_DEMAND
    variance = np.einsum("bii->bi", cov) / count[:, None]
    eps = np.finfo(float).eps
    noise = count[:, None] * eps * variance + (count[:, None] * raw_mean * eps) ** 2
    constant = variance <= noise
    scale = np.sqrt(np.where(constant, 1.0, variance))
    # a constant input carries no information: its row and column are exactly zero
    live = ~constant
    cov = cov * live[:, :, None] * live[:, None, :]
    cov_y = cov_y * live

    system = cov / (scale[:, :, None] * scale[:, None, :]) + alpha * np.eye(P)
    weights = np.linalg.solve(system, (cov_y / scale)[:, :, None])[:, :, 0]
    coef = weights / scale
    intercept = mean_y + level - np.sum(coef * raw_mean, axis=1)
    return intercept, coef


def _doubles(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _list_column(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    offsets = np.arange(len(values) + 1, dtype=np.int64) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def fit_by_series(training: DataFrame, alpha: float = 1.0) -> DataFrame:
    """model(series, n_train, alpha, intercept, coef): one ridge per series."""

    def run(batches):
        for batch in batches:
            n, level = batch["n"].to_numpy(), _doubles(batch["level"])
            if not len(n):
                continue
            intercept, coef = solve(n, level, _rows(batch["sums"]), alpha)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["series"], batch["n"], pa.array(np.full(len(n), alpha)),
                    pa.array(intercept), _list_column(coef),
                ],
                names=["series", *MODEL_COLUMNS],
            )

    sums = moments(training)
    return sums.mapInArrow(run, _schema(sums, MODEL_COLUMNS))


def _schema(rows: DataFrame, columns: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([rows.schema["series"], *[T.StructField(k, v) for k, v in columns.items()]])


def predicted(coef: str = "coef", intercept: str = "intercept") -> Column:
    """Point prediction from a row holding features and its series' coefficients."""
    total = F.col(intercept)
    for i, name in enumerate(FEATURES):
        total = total + F.col(coef)[i] * F.col(name)
    return total


def with_prediction(features: DataFrame, model: DataFrame, *keep: str) -> DataFrame:
    """Rows of modelled series with `pred`, and with the model columns named in `keep`.

    The join is left to the optimiser: the model has one short row per series, the
    features are already partitioned by series.
    """
    wanted = dict.fromkeys(["series", "intercept", "coef", *keep])
    joined = features.join(model.select(*wanted), "series")
    return joined.select(*features.columns, *keep, predicted().alias("pred"))


def with_residual(features: DataFrame, model: DataFrame, *keep: str) -> DataFrame:
    scored = with_prediction(features, model, *keep)
    return scored.withColumn("resid", F.col("qty_sold") - F.col("pred"))


def residual_quantiles(residuals: DataFrame, alpha: float = 0.05, *keep: str) -> DataFrame:
    """(series, q_lo, q_hi): offsets that turn a prediction into a central interval.

    Columns named in `keep` are constant within a series and carried along.
    """
    bounds = F.percentile("resid", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    quantiles = residuals.groupBy("series").agg(bounds.alias("q"), *[F.first(k).alias(k) for k in keep])
    return quantiles.select(
        "series", *keep, F.col("q")[0].alias("q_lo"), F.col("q")[1].alias("q_hi")
    )


def bootstrap_quantiles(
    residuals: DataFrame, alpha: float = 0.05, draws: int = 500, seed: int = 0
) -> DataFrame:
    """The same offsets from draws with replacement out of the ordered residuals.

    Draw b of a series takes the residual at md5('seed#series#b') modulo their number, so
    the draws depend on the series and the seed only.
    """
    gathered = residuals.groupBy("series").agg(
        F.sort_array(F.collect_list(F.struct("date", "resid"))).alias("_days")
    ).select("series", F.col("_days.resid").alias("resid"))

    def drawn(b):
        key = F.concat_ws("#", F.lit(str(seed)), F.col("series").cast("string"), b.cast("string"))
        number = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")
        return F.get("resid", (number % F.size("resid")).cast("int"))

    sampled = gathered.select(
        "series", F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), drawn)).alias("sample")
    )

    def quantile(share: float):
        at = share * (draws - 1)
        low, part = int(at), at - int(at)
        first, second = F.get("sample", F.lit(low)), F.get("sample", F.lit(min(low + 1, draws - 1)))
        return first + (second - first) * part

    return sampled.select("series", quantile(alpha / 2).alias("q_lo"), quantile(1 - alpha / 2).alias("q_hi"))


def fit_with_interval(
    training: DataFrame, alpha: float = 1.0, interval_alpha: float = 0.05, bootstrap: bool = False
) -> DataFrame:
    """Per-series model with the residual offsets q_lo and q_hi.

    The model's columns ride along with the residuals, so the fit is planned once.
    """
    model = fit_by_series(training, alpha)
    if bootstrap:
        return model.join(bootstrap_quantiles(with_residual(training, model), interval_alpha), "series")
    residuals = with_residual(training, model, *MODEL_COLUMNS)
    return residual_quantiles(residuals, interval_alpha, *MODEL_COLUMNS)


# --- choosing alpha by expanding-window validation -------------------------------------


def with_validation_block(training: DataFrame, folds: int = CV_FOLDS) -> DataFrame:
    """Add `block`: f for the rows fold f is tested on, 0 for the rows before them all.

    With n rows a test block has n div (folds+1) rows and the last one ends at row n.
    Fold f trains on every earlier block. `block` is null when a series is too short.
    """
    numbered = training.withColumns({
        "_at": F.row_number().over(by_day()) - 1,
        "_n": F.count("*").over(whole_series()),
    }).withColumn("_size", F.expr(f"_n div {folds + 1}"))
    past = F.col("_at") - (F.col("_n") - folds * F.col("_size"))
    block = F.when(F.col("_size") > 0, F.when(past < 0, 0).otherwise(F.floor(past / F.col("_size")) + 1))
    return numbered.withColumn("block", block.cast("int")).drop("_at", "_n", "_size")


class Stretch:
    """The training rows of a batch of series, one series after the other, with what fits need.

    `block` cuts every series' rows into consecutive blocks. Moments are summed per block, and a
    model's moments are the running total over the blocks it learns from, so no row is copied.
    """

    def __init__(self, batch: pa.RecordBatch):
        self.lengths = np.asarray(batch["n"], np.int64)
        self.series = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.at = np.arange(len(self.series)) - (np.cumsum(self.lengths) - self.lengths)[self.series]
        self.y = batch["qty_sold"].flatten().to_numpy(zero_copy_only=False)
        self.x = np.column_stack([batch[c].flatten().to_numpy(zero_copy_only=False) for c in FEATURES])

    def moments_up_to(self, block: np.ndarray, blocks: int):
        """(n, level, sums) by series and last block, as `solve` takes them."""
        count = len(self.lengths)
        level = np.bincount(self.series, self.y, count) / np.maximum(self.lengths, 1)
        x = self.x - level[self.series, None] * IS_DEMAND
        y = self.y - level[self.series]
        first, second = np.array(PAIRS).T
        totals = np.concatenate([x, x[:, first] * x[:, second], y[:, None], y[:, None] * x], axis=1)
        key = self.series * blocks + block
        n = np.bincount(key, minlength=count * blocks).reshape(count, blocks)
        sums = np.zeros((count * blocks, totals.shape[1]))
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        if len(begins):
            sums[key[begins]] = np.add.reduceat(totals, begins, axis=0)
        return n.cumsum(axis=1), level, sums.reshape(count, blocks, -1).cumsum(axis=1)

    def predicted(self, rows: np.ndarray, intercept: np.ndarray, coef: np.ndarray) -> np.ndarray:
        """Predictions for some rows, each by the model given for it."""
        return intercept + np.einsum("ij,ij->i", self.x[rows], coef)


def nested_rows(training: DataFrame) -> DataFrame:
    """A series' rows as one row of arrays, bounded by its calendar."""
    columns = [F.col(c).cast("double").alias(c) for c in ("qty_sold", *FEATURES)]
    return nest(training.select("series", "date", *columns), ["date", "qty_sold", *FEATURES])


def tuned(training: DataFrame, alphas=ALPHA_GRID, folds: int = CV_FOLDS) -> DataFrame:
    """model(series, n_train, alpha, intercept, coef) with the alpha of lowest mean error, and
    `errors`, the mean validation error of every alpha (null for a series too short to validate).

    The folds are those of `with_validation_block`. Ties go to the earlier alpha; a series too
    short keeps alpha 1. A series is gathered once and fitted, scored and chosen for in one step,
    for all series of a batch together.
    """
    default = list(alphas).index(1.0) if 1.0 in alphas else 0

    def step(batch) -> dict:
        rows = Stretch(batch)
        size = rows.lengths // (folds + 1)
        past = rows.at - (rows.lengths - folds * size)[rows.series]
        block = np.where(past < 0, 0, past // np.maximum(size, 1)[rows.series] + 1)
        block = np.where(size[rows.series] > 0, block, 0)
        n, level, sums = rows.moments_up_to(block, folds + 1)
        tested = np.flatnonzero(block)
        owner, fold_of = rows.series[tested], block[tested] - 1
        errors = np.zeros((len(size), len(alphas)))
        final = np.zeros((len(size), len(alphas), P + 1))
        for a, alpha in enumerate(alphas):
            fits = [solve(n[:, b], level, sums[:, b], alpha) for b in range(folds + 1)]
            intercept, coef = (np.stack(part, axis=1) for part in zip(*fits, strict=True))
            error = np.abs(rows.y[tested] - rows.predicted(tested, intercept[owner, fold_of], coef[owner, fold_of]))
            errors[:, a] = np.bincount(owner, error, len(size)) / np.maximum(folds * size, 1)
            final[:, a, 0], final[:, a, 1:] = intercept[:, folds], coef[:, folds]
        best = np.where(size > 0, errors.argmin(axis=1), default)
        chosen = final[np.arange(len(size)), best]
        return {
            "alpha": pa.array(np.asarray(alphas, float)[best]), "intercept": pa.array(chosen[:, 0]),
            "coef": _list_column(chosen[:, 1:]),
            "errors": pa.array([e if long else None for e, long in zip(errors.tolist(), size > 0, strict=True)], pa.list_(pa.float64())),
        }

    outputs = {"alpha": T.DoubleType(), "intercept": T.DoubleType(), "coef": DOUBLES, "errors": DOUBLES}
    fitted = fold(nested_rows(training), step, outputs, batch_rows=64, keep=["series", "n"])
    return fitted.select("series", F.col("n").cast("bigint").alias("n_train"), *outputs)


def validation_scores(training: DataFrame, alphas=ALPHA_GRID, folds: int = CV_FOLDS) -> DataFrame:
    """(series, at, alpha, mean_mae) of the series long enough to validate."""
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    scored = tuned(training, alphas, folds).select("series", F.posexplode("errors").alias("at", "mean_mae"))
    return scored.select("series", "at", F.get(grid, F.col("at")).alias("alpha"), "mean_mae")


def fit_best_alpha(training: DataFrame, alphas=ALPHA_GRID, folds: int = CV_FOLDS) -> DataFrame:
    """model(series, n_train, alpha, intercept, coef) as `tuned` chooses it."""
    return tuned(training, alphas, folds).drop("errors")


def scores_by_cut(training: DataFrame, cuts: list[str], days: int, alpha: float, smallest: float) -> DataFrame:
    """(series, cut, n_train, rows, mae, mape): a fit up to every cut date, scored on the `days` days
    after it. One pass over the rows serves all cuts. A cut with nothing to learn from or nothing
    to score gives no row; percentages are of the target, `smallest` at least."""
    named = sorted(set(cuts))
    at = np.array(named, "datetime64[D]").astype(np.int64)

    def step(batch) -> dict:
        rows = Stretch(batch)
        day = batch["date"].flatten().cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
        # a row after c cuts is in block c, so the fit at cut c takes the blocks up to c
        n, level, sums = rows.moments_up_to(np.searchsorted(at, day, side="left"), len(at) + 1)
        found = np.zeros((3, len(rows.lengths), len(at)))
        for c, cut in enumerate(at):
            intercept, coef = solve(n[:, c], level, sums[:, c], alpha)
            tested = np.flatnonzero((day > cut) & (day <= cut + days))
            owner = rows.series[tested]
            error = np.abs(rows.y[tested] - rows.predicted(tested, intercept[owner], coef[owner]))
            share = error / np.maximum(np.abs(rows.y[tested]), smallest)
            for place, weight in enumerate((None, error, share)):
                found[place, :, c] = np.bincount(owner, weight, len(rows.lengths))
        return {
            "n_train": _list_column(n[:, :-1].astype(np.int64)), "rows": _list_column(found[0].astype(np.int64)),
            "mae": _list_column(found[1] / np.maximum(found[0], 1)), "mape": _list_column(found[2] / np.maximum(found[0], 1)),
        }

    outputs = {"n_train": LONGS, "rows": LONGS, "mae": DOUBLES, "mape": DOUBLES}
    by_cut = unnest(fold(nested_rows(training), step, outputs, batch_rows=64, keep=["series"]), list(outputs))
    dates = F.array(*[F.lit(c).cast("date") for c in named])
    return by_cut.where("n_train > 0 AND rows > 0").select("series", F.get(dates, F.col("step")).alias("cut"), *outputs)


# --- one model over all series ---------------------------------------------------------


def assemble(training: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(training)


def fit_pooled(training: DataFrame, estimator=None, alpha: float = 1.0):
    """Fit one model over all series with any pyspark.ml regressor (ridge by default).

    Passes read the assembled rows, settled once.
    """
    return fit_rows(settle(assemble(training).select("features", "qty_sold"), "pooled"), estimator, alpha)


def fit_rows(rows: DataFrame, estimator=None, alpha: float = 1.0):
    """Fit on assembled rows. pyspark.ml scales the squared error by n and both sides by the target's
    deviation, so the matching penalty is alpha / n * std(y)."""
    if estimator is None:
        n, spread = rows.agg(F.count("*"), F.stddev_pop("qty_sold")).first()
        estimator = LinearRegression(
            solver="normal", elasticNetParam=0.0, standardization=True,
            regParam=alpha / max(n, 1) * (spread or 0.0),
        )
    estimator = estimator.copy({
        estimator.getParam("featuresCol"): "features",
        estimator.getParam("labelCol"): "qty_sold",
        estimator.getParam("predictionCol"): "pred",
    })
    return estimator.fit(rows)


def pooled_prediction(features: DataFrame, fitted) -> DataFrame:
    return fitted.transform(assemble(features)).drop("features")


def pooled_coefficients(training: DataFrame, fitted) -> DataFrame:
    """(feature, weight) of a pooled linear fit, the intercept included."""
    weights = [("intercept", float(fitted.intercept))]
    weights += list(zip(FEATURES, map(float, fitted.coefficients), strict=True))
    return training.sparkSession.createDataFrame(weights, "feature string, weight double")
