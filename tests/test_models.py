"""Models against closed forms worked out in numpy on small fixtures."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import accuracy, features, ridge
from larder.operators.forecast import (
    default_wave, flat_forecast, forecast_demand, recursive_forecast, wave_forecast,
)
from larder.operators.scheduler import scheduled_plan
from larder.operators.spine import densify
from larder.operators.weekly import balance_plan
from larder.plans import season
from larder.tables import ALPHA_GRID, FEATURES, Policy
from tests.conftest import rows_of

FIRST = dt.date(2023, 10, 2)


def demand(n, seed=0, level=20):
    rng = np.random.default_rng(seed)
    return np.maximum(0, np.round(level + 6 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(0, 4, n))).astype(int)


def closed_form(x, y, alpha):
    scale = x.std(axis=0)
    scale[scale < 1e-12] = 1.0
    z = (x - x.mean(axis=0)) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return y.mean() - w @ x.mean(axis=0), w


def matrix_of(training):
    rows = training.orderBy("series", "date").collect()
    names = sorted({r["series"] for r in rows})
    return {
        s: (
            np.array([[float(r[f]) for f in FEATURES] for r in rows if r["series"] == s]),
            np.array([r["qty_sold"] for r in rows if r["series"] == s]),
        )
        for s in names
    }


@pytest.fixture(scope="module")
def three(spark):
    rows = [
        (s, FIRST + dt.timedelta(days=i), float(q))
        for s, (n, seed) in {"a": (150, 1), "b": (90, 2), "c": (9, 3)}.items()
        for i, q in enumerate(demand(n, seed))
    ]
    rows += [("flat", FIRST + dt.timedelta(days=i), 5.0) for i in range(40)]
    frame = spark.createDataFrame(rows, "series string, date date, qty_sold double")
    return frame.persist()


def test_ridge_per_series(three):
    training = features.training_rows(features.with_features(three)).persist()
    expected = matrix_of(training)
    for row in ridge.fit_by_series(training, 1.0).collect():
        x, y = expected[row["series"]]
        intercept, coef = closed_form(x, y, 1.0)
        assert row["n_train"] == len(y)
        assert np.allclose(row["coef"], coef, atol=1e-9) and abs(row["intercept"] - intercept) < 1e-8


def test_pooled_equals_per_series_on_one_series(three):
    one = features.training_rows(features.with_features(three.where("series = 'a'"))).persist()
    fitted = ridge.fit_pooled(one)
    row = ridge.fit_by_series(one).first()
    assert np.allclose(fitted.coefficients.toArray(), row["coef"], atol=1e-8)
    assert abs(fitted.intercept - row["intercept"]) < 1e-7
    scored = ridge.pooled_prediction(one, fitted).join(
        ridge.with_prediction(one, ridge.fit_by_series(one)).select("date", F.col("pred").alias("other")), "date"
    )
    assert scored.agg(F.max(F.abs(F.col("pred") - F.col("other")))).first()[0] < 1e-7


def test_any_regressor_can_be_pooled(three):
    from pyspark.ml.regression import DecisionTreeRegressor

    training = features.training_rows(features.with_features(three))
    fitted = ridge.fit_pooled(training, DecisionTreeRegressor(maxDepth=2))
    assert "pred" in ridge.pooled_prediction(training, fitted).columns


def brute_alpha(x, y):
    n, t = len(y), len(y) // 6
    if t == 0:
        return 1.0, None
    scores = []
    for alpha in ALPHA_GRID:
        errors = []
        for f in range(5):
            lo, hi = n - (5 - f) * t, n - (4 - f) * t
            intercept, coef = closed_form(x[:lo], y[:lo], alpha)
            errors.append(np.mean(np.abs(y[lo:hi] - intercept - x[lo:hi] @ coef)))
        scores.append(np.mean(errors))
    return ALPHA_GRID[int(np.argmin(scores))], scores


def test_alpha_search(three):
    training = features.training_rows(features.with_features(three)).persist()
    expected = matrix_of(training)
    scores = ridge.validation_scores(training).collect()
    for name, (x, y) in expected.items():
        alpha, wanted = brute_alpha(x, y)
        found = [r["mean_mae"] for r in sorted(scores, key=lambda r: r["alpha"]) if r["series"] == name]
        assert (not found) if wanted is None else np.allclose(found, wanted, atol=1e-8)
    for row in ridge.fit_best_alpha(training).collect():
        x, y = expected[row["series"]]
        alpha, wanted = brute_alpha(x, y)
        if wanted is None or np.ptp(wanted) > 1e-9:
            assert row["alpha"] == alpha
        intercept, coef = closed_form(x, y, row["alpha"])
        assert np.allclose(row["coef"], coef, atol=1e-8) and abs(row["intercept"] - intercept) < 1e-7


def test_rolling_backtest_equals_a_fit_of_its_own_at_every_cut(three):
    cuts = ["2023-12-01", "2023-11-05", "2024-01-10", "2023-11-20", "2025-01-01", "2023-01-01"]
    rows = features.training_rows(features.after_warm_up(features.with_features(three, full_only=True))).orderBy("series", "date").collect()
    wanted = {}
    for name in {r["series"] for r in rows}:
        own = [r for r in rows if r["series"] == name]
        x, y = np.array([[float(r[f]) for f in FEATURES] for r in own]), np.array([r["qty_sold"] for r in own])
        day = np.array([r["date"] for r in own])
        for cut in map(dt.date.fromisoformat, cuts):
            early, late = day <= cut, (day > cut) & (day <= cut + dt.timedelta(days=14))
            if early.any() and late.any():
                intercept, coef = closed_form(x[early], y[early], 2.0)
                error = np.abs(y[late] - intercept - x[late] @ coef)
                share = error / np.maximum(np.abs(y[late]), 2.220446049250313e-16)
                wanted[name, cut] = (early.sum(), late.sum(), error.mean(), share.mean())
    found = {(r["series"], r["cut"]): tuple(r)[2:] for r in accuracy.rolling_backtest(three, cuts, days=14, alpha=2.0).collect()}
    assert found.keys() == wanted.keys() and len(wanted) > 5
    for key, values in wanted.items():
        assert found[key][:2] == values[:2] and np.allclose(found[key][2:], values[2:], rtol=1e-7, atol=1e-7)
    assert accuracy.rolling_backtest(three.limit(0), cuts).count() == 0


def test_intervals(three):
    training = features.training_rows(features.with_features(three)).persist()
    residuals = ridge.with_residual(training, ridge.fit_by_series(training)).persist()
    ordered = {}
    for r in residuals.orderBy("date").collect():
        ordered.setdefault(r["series"], []).append(r["resid"])
    for r in ridge.residual_quantiles(residuals, 0.05).collect():
        assert np.allclose([r["q_lo"], r["q_hi"]], np.quantile(ordered[r["series"]], [0.025, 0.975]), atol=1e-9)
    for r in ridge.bootstrap_quantiles(residuals, 0.05).collect():
        values = ordered[r["series"]]
        marks = [hashlib.md5(f"0#{r['series']}#{b}".encode()).hexdigest() for b in range(500)]
        drawn = [values[int(mark[:15], 16) % len(values)] for mark in marks]
        assert np.allclose([r["q_lo"], r["q_hi"]], np.quantile(drawn, [0.025, 0.975]), atol=1e-9)


def brute_forecast(first, quantities, intercept, coef, days):
    known, out = list(map(float, quantities)), []
    for step in range(days):
        day = first + dt.timedelta(days=len(quantities) + step)
        fourth = day.month == 11 and day.weekday() == 3 and 22 <= day.day <= 28
        x = [
            day.weekday(), day.month, day.weekday() >= 5, (day.month, day.day) == (12, 25),
            (day.month, day.day) == (7, 4), (day.month, day.day) == (3, 14), fourth,
            known[-1], known[-7], np.mean(known[-7:]), np.mean(known[-28:]),
        ]
        mean = intercept + float(np.dot(coef, np.array(x, dtype=float)))
        known.append(max(0, round(mean)))
        out.append((day, known[-1], mean))
    return out


def test_recursive_forecast(three, spark):
    coef = [0.31, -0.07, 0.83, 2.0, 1.5, -0.5, 3.0, 0.11, 0.17, 0.23, 0.29]
    model = three.select("series").distinct().select(
        "series", F.lit(1.25).alias("intercept"), F.array(*map(F.lit, coef)).alias("coef"),
        F.lit(-2.0).alias("q_lo"), F.lit(3.0).alias("q_hi"),
    )
    found = recursive_forecast(three, model, Policy(horizon_days=80)).orderBy("series", "date").collect()
    for name, n, seed in (("a", 150, 1), ("c", 9, 3)):
        wanted = brute_forecast(FIRST, demand(n, seed), 1.25, coef, 80)
        mine = [r for r in found if r["series"] == name]
        assert [(r["date"], r["qty_sold"]) for r in mine] == [w[:2] for w in wanted]
        assert np.allclose([r["pred_mean"] for r in mine], [w[2] for w in wanted], atol=1e-9)
        assert np.allclose([r["pred_upper"] - r["pred_lower"] for r in mine], 5.0)


def test_the_intercept_is_added_last(history):
    """A Thursday in May: 3 * 0.31 - 5 * 0.07 + 1.25 + 1.67 is 3.5, and half to even is 4; with the intercept first it is below."""
    past = history({"a": (dt.date(2024, 4, 22), [1] * 10)})
    coef = [0.31, -0.07, 0.83, 2.0, 1.5, -0.5, 3.0, 1.67, 0.0, 0.0, 0.0]
    model = past.select("series").distinct().withColumns({"intercept": F.lit(1.25), "coef": F.array(*map(F.lit, coef))})
    found = recursive_forecast(past, model, Policy(horizon_days=1))
    assert rows_of(found.select("date", "qty_sold", "pred_mean"), "date") == [(dt.date(2024, 5, 2), 4, 3.5)]


def test_forecast_year_cuts_the_horizon(three):
    policy = Policy(horizon_days=400, forecast_year=2023)
    flat = flat_forecast(three, policy)
    assert flat.agg(F.max("date")).first()[0] == dt.date(2023, 12, 31)
    assert "a" not in {r[0] for r in flat.select("series").distinct().collect()}  # its history ends in 2024


def test_short_series_get_a_flat_forecast(history):
    table = history({"short": (FIRST, [4, 5, 6]), "long": (FIRST, demand(60))})
    found = forecast_demand(table, Policy(horizon_days=5))
    methods = dict(found.groupBy("series").agg(F.max("forecast_method")).collect())
    assert methods == {"short": "flat", "long": "ridge"}
    assert found.where("series = 'short'").agg(F.min("qty_sold"), F.max("qty_sold")).first()[:] == (5, 5)
    boot = forecast_demand(table, Policy(horizon_days=5), bootstrap=True).where("series = 'long'")
    assert boot.where("pred_lower < pred_mean AND pred_mean < pred_upper").count() == 5


def test_every_series_is_in_both_runs(history, spark):
    table = history({"long": (FIRST, demand(150)), "three": (FIRST, [4, 5, 6]), "late": (FIRST + dt.timedelta(days=140), demand(10))})
    unknown = spark.createDataFrame([("none", FIRST, None)], "series string, date date, qty_sold double")
    table = table.unionByName(unknown)
    policy = Policy(horizon_days=400, forecast_year=2024)
    seasons = scheduled_plan(season.season_days(table, policy))
    weeks = balance_plan(season.weekly_days(table, policy, str(FIRST + dt.timedelta(days=130))))
    for days, late in ((seasons, "ridge"), (weeks, "flat")):
        methods = dict(days.groupBy("series").agg(F.max("forecast_method")).collect())
        assert methods == {"long": "ridge", "three": "flat", "late": late, "none": "wave"}
    waves = [r["qty_sold"] for r in seasons.where("series = 'none'").orderBy("date").limit(8).collect()]
    assert waves == [int(8.5 + (i % 7 - 3) * 0.5) for i in range(8)]


def test_one_bad_quantity_stays_in_its_windows(history):
    table = history({"s": (FIRST, demand(60))})
    spoiled = table.withColumn("qty_sold", F.when(F.col("date") == FIRST + dt.timedelta(days=20), float("nan")).otherwise(F.col("qty_sold")))
    good, bad = (features.with_past_demand(t).orderBy("date").collect() for t in (table, spoiled))
    differing = [i for i, (x, y) in enumerate(zip(good, bad, strict=True)) if x["roll7"] != y["roll7"]]
    assert differing == list(range(21, 28))


def test_unknown_recent_quantities_get_a_flat_forecast(history):
    table = history({"gap": (FIRST, demand(60)), "full": (FIRST, demand(60))})
    last = table.agg(F.max("date")).first()[0]
    holed = table.withColumn("qty_sold", F.when(
        (F.col("series") == "gap") & (F.col("date") >= last - dt.timedelta(days=1)), F.lit(None)
    ).otherwise(F.col("qty_sold")))
    found = forecast_demand(holed, Policy(horizon_days=3)).where("series = 'gap'").collect()
    wanted = int(np.mean(demand(60)[-7:-2]))
    assert [(r["qty_sold"], r["pred_mean"], r["forecast_method"]) for r in found] == [(wanted, None, "flat")] * 3


def test_one_series_does_not_change_another(history):
    alone = history({"a": (FIRST, demand(60, 1))})
    both = history({"a": (FIRST, demand(60, 1)), "b": (FIRST, demand(90, 9, 200))})
    policy = Policy(horizon_days=20)
    wanted = rows_of(forecast_demand(alone, policy), "date")
    assert rows_of(forecast_demand(both, policy).where("series = 'a'"), "date") == wanted


def test_stand_in_forecasts(history, spark):
    table = history({"s": (FIRST, [10] * 13 + [11])})
    flat = flat_forecast(table, Policy(horizon_days=2)).orderBy("date").first()
    assert (flat["qty_sold"], flat["apples_need"], flat["dough_need"]) == (10, 30, 10)  # 10.142857 a day
    wave = [r["qty_sold"] for r in wave_forecast(table, Policy(horizon_days=7)).orderBy("date").collect()]
    assert wave == [8, 9, 9, 10, 10, 11, 11]
    default = default_wave(spark, Policy(horizon_days=7), start="2024-01-01").orderBy("date").collect()
    assert [r["qty_sold"] for r in default] == [7, 7, 8, 8, 9, 9, 10] and default[0]["date"] == dt.date(2024, 1, 2)


def test_densify_fills_gaps(spark):
    rows = spark.createDataFrame(
        [("s", dt.date(2024, 2, 27), 1.0), ("s", dt.date(2024, 3, 1), 2.0)], "series string, date date, qty_sold double"
    )
    assert [(str(r[1]), r[2]) for r in rows_of(densify(rows), "date")] == [
        ("2024-02-27", 1.0), ("2024-02-28", 0.0), ("2024-02-29", 0.0), ("2024-03-01", 2.0),
    ]


def test_accuracy_edges(spark):
    day = dt.date(2024, 1, 1)
    rows = [("z", day + dt.timedelta(days=i), 0.0, 0.0) for i in range(4)]
    scored = spark.createDataFrame(rows, "series string, date date, qty_sold double, pred double")
    found = accuracy.accuracy(scored, scored, 1).first()
    assert (found["mae"], found["smape"], found["mase"]) == (0.0, 0.0, 0.0)
    off = scored.withColumn("pred", F.lit(2.0))
    found = accuracy.accuracy(off, scored, 1).first()
    assert (found["mae"], found["smape"], found["mase"]) == (2.0, 2.0, 2.0)  # scale 0: the plain error
