"""Backtests and forecast accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.features import after_warm_up, split_features, training_rows, with_features
from larder.operators.ridge import fit_best_alpha, scores_by_cut, with_prediction
from larder.operators.spine import by_day

SMALLEST_TARGET = 2.220446049250313e-16


def backtest(history: DataFrame, predictions: DataFrame) -> DataFrame:
    """History with the prediction of the same day, null where there is none."""
    return history.join(predictions.select("series", "date", "pred"), ["series", "date"], "left")


def abs_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(abs_error(actual, predicted))


def mape(actual: Column, predicted: Column) -> Column:
    return F.avg(abs_error(actual, predicted) / F.greatest(F.abs(actual), F.lit(SMALLEST_TARGET)))


def smape(actual: Column, predicted: Column) -> Column:
    middle = (F.abs(actual) + F.abs(predicted)) / 2
    return F.avg(abs_error(actual, predicted) / F.when(middle == 0, 1.0).otherwise(middle))


def seasonal_scale(train: DataFrame, season: int = 1) -> DataFrame:
    """(series, scale): mean absolute change over one season in the training rows."""
    change = F.abs(F.col("qty_sold") - F.lag("qty_sold", season).over(by_day()))
    return train.select("series", change.alias("_c")).groupBy("series").agg(F.avg("_c").alias("scale"))


def accuracy(scored: DataFrame, train: DataFrame, season: int = 1) -> DataFrame:
    """(series, rows, mae, mape, smape, mase) of rows with qty_sold and pred."""
    y, p = F.col("qty_sold"), F.col("pred")
    known = scored.where(y.isNotNull() & p.isNotNull())
    errors = known.groupBy("series").agg(
        F.count("*").alias("rows"), mae(y, p).alias("mae"), mape(y, p).alias("mape"), smape(y, p).alias("smape")
    )
    scaled = errors.join(seasonal_scale(train, season), "series", "left")
    mase = F.when(F.col("scale") == 0, F.col("mae")).otherwise(F.col("mae") / F.col("scale"))
    return scaled.select("series", "rows", "mae", "mape", "smape", mase.alias("mase"))


def holdout_metrics(history: DataFrame, last_train_day: str) -> DataFrame:
    """(series, alpha, rows, mae, mape): tune and fit on train, score on the later rows."""
    train, test = split_features(history, last_train_day)
    model = fit_best_alpha(training_rows(train))
    scored = with_prediction(test, model, "alpha")
    y, p = F.col("qty_sold"), F.col("pred")
    return scored.groupBy("series").agg(
        F.first("alpha").alias("alpha"), F.count("*").alias("rows"), mae(y, p).alias("mae"), mape(y, p).alias("mape")
    )


def rolling_backtest(history: DataFrame, cuts: list[str], days: int = 28, alpha: float = 1.0) -> DataFrame:
    """(series, cut, n_train, rows, mae, mape): one ridge per series and cut date, scored one day ahead
    on the `days` days after the cut. Inputs are the full windows of the days before each row."""
    rows = training_rows(after_warm_up(with_features(history, full_only=True)))
    return scores_by_cut(rows, cuts, days, alpha, SMALLEST_TARGET)
