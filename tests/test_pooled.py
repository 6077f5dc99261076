"""Models of any kind rolled forward, against a plain loop over days and the model's own predictions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import functions as F

from larder.operators import features, pooled, ridge
from larder.tables import Policy

FIRST = dt.date(2024, 10, 3)
POLICY = Policy(horizon_days=90, forecast_year=2025)


@pytest.fixture(scope="module")
def past(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name, n, level in (("long", 300, 30), ("month", 60, 12), ("short", 12, 40), ("few", 5, 9), ("gap", 50, 20), ("none", 20, 3)):
        for i, q in enumerate(rng.poisson(level + 8 * np.sin(np.arange(n) * 2 * np.pi / 7) ** 2)):
            unknown = name == "none" or name == "gap" and i == 47
            rows.append((name, FIRST + dt.timedelta(days=i), None if unknown else float(q)))
    return spark.createDataFrame(rows, "series string, date date, qty_sold double").persist()


@pytest.fixture(scope="module")
def training(past):
    return features.training_rows(features.with_features(past)).persist()


def inputs_of(day, sold):
    """All features of a day from the quantities before it."""
    november = [dt.date(day.year, 11, d) for d in range(1, 31)]
    thanksgiving = [d for d in november if d.weekday() == 3][3]
    flags = [day.weekday(), day.month, day.weekday() >= 5, (day.month, day.day) == (12, 25), (day.month, day.day) == (7, 4),
             (day.month, day.day) == (3, 14), day == thanksgiving]
    return [*map(float, flags), sold[-1], sold[-7], sum(sold[-7:]) / 7, sum(sold[-28:]) / len(sold[-28:])]


def plain_loop(past, predict, days):
    found = {}
    for name in ("long", "month", "short"):
        rows = past.where(F.col("series") == name).orderBy("date").collect()
        sold, day = [r["qty_sold"] for r in rows], rows[-1]["date"]
        for _ in range(days):
            day += dt.timedelta(days=1)
            mean = predict(inputs_of(day, sold))
            sold.append(float(max(0, round(mean))))
            found[name, day] = (sold[-1], mean)
    return found


@pytest.mark.parametrize("estimator", [
    lambda: None, lambda: DecisionTreeRegressor(maxDepth=5, seed=1),
    lambda: RandomForestRegressor(numTrees=5, maxDepth=4, seed=1), lambda: GBTRegressor(maxIter=8, maxDepth=3, seed=1),
], ids=["ridge", "tree", "forest", "boosted"])
def test_rolls_as_a_plain_loop(spark, past, training, estimator):
    rows = ridge.assemble(training).select("features", "qty_sold")
    fitted = ridge.fit_rows(rows, estimator())
    found = pooled.forecast_pooled(past, pooled.portable(spark, fitted), POLICY).where("forecast_method = 'model'").collect()
    wanted = plain_loop(past, lambda x: fitted.predict(Vectors.dense(x)), 90)
    assert {(r["series"], r["date"]) for r in found} == set(wanted)
    for row in found:
        quantity, mean = wanted[row["series"], row["date"]]
        assert row["qty_sold"] == quantity and abs(row["pred_mean"] - mean) < 1e-9
        assert row["pred_lower"] == row["pred_mean"] == row["pred_upper"]


def test_interval_from_residuals(past, training):
    plain = pooled.fit_portable(training, GBTRegressor(maxIter=4, maxDepth=3, seed=1))
    model = pooled.fit_portable(training, GBTRegressor(maxIter=4, maxDepth=3, seed=1), interval_alpha=0.2)
    x = np.array([[float(v) for v in r] for r in training.select(*features.FEATURES).collect()])
    y = np.array([r["qty_sold"] for r in training.select("qty_sold").collect()])
    residuals = np.sort(y - plain.predict(x))
    for offset, share in ((model.low, 0.1), (model.high, 0.9)):
        below, upto = np.searchsorted(residuals, [offset - 1e-9, offset + 1e-9]) / len(residuals)
        assert below - 0.01 <= share <= upto + 0.01
    rows = pooled.forecast_pooled(past, model, POLICY).where("forecast_method = 'model'").collect()
    assert all(abs(r["pred_lower"] - r["pred_mean"] - model.low) < 1e-9 for r in rows)
    assert all(abs(r["pred_upper"] - r["pred_mean"] - model.high) < 1e-9 for r in rows)


@pytest.mark.parametrize("estimator", [
    lambda: DecisionTreeRegressor(maxDepth=5, seed=1), lambda: GBTRegressor(maxIter=6, maxDepth=4, seed=1),
], ids=["tree", "boosted"])
def test_a_fit_by_bins_is_the_fit_by_rows(spark, training, estimator):
    """With no more values than bins both see the same thresholds; eight rows of each input differ in the target only."""
    coarse = training.withColumns({name: F.floor(F.col(name) / 6) * 6.0 for name in features.FEATURES[-4:]})
    many = coarse.crossJoin(spark.range(8)).withColumn("qty_sold", F.col("qty_sold") + F.col("id") % 3).persist()
    seen = []

    class Watched(type(estimator())):
        def _fit(self, dataset):
            seen.append(dataset.count())
            return super()._fit(dataset)

    watched = Watched(**{p.name: v for p, v in estimator().extractParamMap().items() if p.name in ("maxDepth", "maxIter", "seed")})
    model = pooled.fit_portable(many, watched)
    assert seen[0] * 8 <= many.count()
    fitted = ridge.fit_rows(ridge.assemble(many).select("features", "qty_sold"), estimator())
    rows = ridge.assemble(many.dropDuplicates(list(features.FEATURES))).select("features").collect()
    x = np.array([r["features"].toArray() for r in rows])
    assert np.abs(model.predict(x) - [fitted.predict(r["features"]) for r in rows]).max() < 1e-9
    assert len(np.unique(model.predict(x))) > 8


def test_cuts_keep_rare_values_and_equal_values_below(spark, training):
    one = training.limit(1).drop("is_xmas", "roll28", "lag_1")
    rows = one.crossJoin(spark.range(3000).select(
        (F.col("id") == 7).cast("int").alias("is_xmas"), (F.col("id") % 1000).cast("double").alias("roll28"),
        F.when(F.col("id") % 5 == 0, F.col("id") % 50).otherwise(0).cast("double").alias("lag_1")))
    cuts = dict(zip(features.FEATURES, pooled.cut_points(rows, 31), strict=True))
    assert cuts["is_xmas"].tolist() == [0.5] and len(cuts["dow"]) == 1
    assert cuts["lag_1"].tolist() == [2.5 + 5 * i for i in range(9)]
    assert len(cuts["roll28"]) == 31 and np.abs(np.diff(cuts["roll28"]) - 1000 / 31).max() < 10
    at = rows.limit(1).withColumn("lag_1", F.explode(F.array(F.lit(2.5), F.lit(2.500001))))
    assert [r["bin_lag_1"] for r in pooled.binned(at, list(cuts.values())).orderBy("lag_1").collect()] == [0.0, 1.0]


def test_fits_that_need_every_row_get_them(training):
    plain = GBTRegressor(maxIter=2, maxDepth=2, seed=1)
    assert pooled.by_bins(plain)
    for other in (GBTRegressor(lossType="absolute"), GBTRegressor(subsamplingRate=0.5), GBTRegressor(minInstancesPerNode=5),
                  GBTRegressor(weightCol="w"), RandomForestRegressor(), None):
        assert not pooled.by_bins(other)
    assert pooled.fit_portable(training.limit(0), plain) is None


def test_rank_error_of_the_sketch(spark):
    rows, ranks = 200_000, 100
    table = spark.range(rows).select((F.pmod(F.xxhash64("id"), F.lit(10 ** 9))).cast("double").alias("resid"))
    values = np.sort([r[0] for r in table.collect()])
    for share, offset in zip((0.05, 0.95), pooled.residual_offsets(table, 0.1, ranks), strict=True):
        assert abs(np.searchsorted(values, offset) / rows - share) <= 1 / ranks


def test_a_model_of_ones_own(past):
    class Yesterday:
        def predict(self, rows):
            return rows[:, 7] + 0.25

        def predict_interval(self, rows):
            return rows[:, 7] - 1, rows[:, 7] + 2

    rows = pooled.forecast_pooled(past, Yesterday(), POLICY).where("series = 'long'").orderBy("date").collect()
    last = past.where("series = 'long'").orderBy(F.desc("date")).first()["qty_sold"]
    assert {r["qty_sold"] for r in rows} == {last}
    assert {(r["pred_lower"], r["pred_upper"]) for r in rows} == {(last - 1, last + 2)}


def test_series_that_no_model_can_roll(past):
    rows = pooled.forecast_pooled(past, pooled.Linear([0.0] * 11, 7.0), POLICY).collect()
    methods = {r["series"]: r["forecast_method"] for r in rows}
    assert methods == {"long": "model", "month": "model", "short": "model", "few": "flat", "gap": "flat", "none": "wave"}
    assert all((r["pred_mean"] is None) == (r["forecast_method"] != "model") == (r["pred_upper"] is None) for r in rows)
    known = [r["qty_sold"] for r in past.where("series = 'few'").collect()]
    assert {r["qty_sold"] for r in rows if r["series"] == "few"} == {int(sum(known) / 5)}


def test_without_rows_to_learn_from(past, training):
    model = pooled.fit_portable(training.limit(0))
    assert model is None
    methods = {r["forecast_method"] for r in pooled.forecast_pooled(past, model, POLICY).collect()}
    assert methods == {"flat", "wave"}
    assert pooled.forecast_pooled(past.limit(0), model, POLICY).collect() == []


def test_other_models_are_refused(spark, training):
    rows = ridge.assemble(training).select("features", "qty_sold")
    with pytest.raises(ValueError, match="predict"):
        pooled.portable(spark, ridge.fit_rows(rows, IsotonicRegression()))
