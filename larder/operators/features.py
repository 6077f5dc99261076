"""Model inputs: calendar flags, lags and rolling means of past demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.calendar import calendar_features
from larder.operators.spine import by_day, whole_series
from larder.tables import FEATURES


def with_calendar(rows: DataFrame) -> DataFrame:
    return rows.withColumns(calendar_features(F.col("date")))


def with_past_means(history: DataFrame, days: dict[str, int], full_only: bool = False) -> DataFrame:
    """Add means of the rows before this one, named by `days`; null until full if `full_only`.

    A mean is the difference of two running totals, so a row costs the same whatever the
    window's length. Totals are of whole deviations from the series' level, which keeps them
    short; whole quantities give the same value as summing the window. Not-a-number and
    infinite quantities count as unknown, so they reach no further than their windows.
    """
    past = by_day().rowsBetween(Window.unboundedPreceding, -1)
    finite = F.when(~F.isnan("qty_sold") & (F.abs("qty_sold") != float("inf")), F.col("qty_sold"))
    level = F.coalesce(F.rint(F.avg("_finite").over(whole_series())), F.lit(0.0))
    centred = history.withColumn("_finite", finite).withColumn("_level", level)
    totals = centred.withColumns({
        "_sum": F.coalesce(F.sum(F.col("_finite") - F.col("_level")).over(past), F.lit(0.0)),
        "_count": F.count("_finite").over(past),
    })

    def mean(n: int) -> Column:
        total = F.col("_sum") - F.lag("_sum", n, 0.0).over(by_day())
        count = F.col("_count") - F.lag("_count", n, 0).over(by_day())
        known = (total + count * F.col("_level")) / count
        return F.when(count == n if full_only else count > 0, known)

    return totals.withColumns({name: mean(n) for name, n in days.items()}).drop("_sum", "_count", "_finite", "_level")


def with_past_demand(history: DataFrame, full_only: bool = False) -> DataFrame:
    lagged = history.withColumns({
        "lag_1": F.lag("qty_sold", 1).over(by_day()),
        "lag_7": F.lag("qty_sold", 7).over(by_day()),
    })
    return with_past_means(lagged, {"roll7": 7, "roll28": 28}, full_only)


def with_features(history: DataFrame, full_only: bool = False) -> DataFrame:
    return with_calendar(with_past_demand(history, full_only))


def training_rows(features: DataFrame) -> DataFrame:
    """Rows whose inputs and target are all known."""
    return features.dropna("any", subset=[*FEATURES, "qty_sold"])


def split_by_date(history: DataFrame, last_train_day: str) -> tuple[DataFrame, DataFrame]:
    """Train rows up to the cut date and test rows after it."""
    cut = F.lit(last_train_day).cast("date")
    return history.where(F.col("date") <= cut), history.where(F.col("date") > cut)


def after_warm_up(history: DataFrame, days: int = 28) -> DataFrame:
    """Drop each series' first `days` days."""
    first = F.min("date").over(whole_series())
    kept = history.withColumn("_first", first).where(F.col("date") >= F.date_add("_first", days))
    return kept.drop("_first")


def split_features(history: DataFrame, last_train_day: str) -> tuple[DataFrame, DataFrame]:
    """Train and test inputs built on each side of the cut alone, full windows only."""
    train, test = split_by_date(history, last_train_day)
    return (
        after_warm_up(with_features(train, full_only=True)),
        with_features(test, full_only=True).dropna("any", subset=["lag_1", "lag_7", "roll7", "roll28"]),
    )
