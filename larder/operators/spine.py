"""Daily totals, gap filling and forecast calendars."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larder.tables import Policy

DAYS_PER_TASK = 250_000


def by_day() -> WindowSpec:
    return Window.partitionBy("series").orderBy("date")


def whole_series() -> WindowSpec:
    return Window.partitionBy("series")


def daily_totals(sales: DataFrame, series: str, day: str, qty: str) -> DataFrame:
    """sales rows -> (series, date, qty_sold), one row per series and day.

    The sum is partially aggregated before the exchange and the exchange is on
    (series, date), so a series holding a large share of the raw rows is spread over
    its days and shrinks to its calendar before anything is grouped by series alone.
    Rows without a series belong to no history. Leaving them out here also gives every
    later branch the same scan, so that one exchange serves them all.
    """
    keyed = sales.where(F.col(series).isNotNull()).select(
        F.col(series).alias("series"),
        F.col(day).cast("date").alias("date"),
        F.col(qty).cast("double").alias("qty_sold"),
    )
    return keyed.groupBy("series", "date").agg(F.sum("qty_sold").alias("qty_sold"))


def calendar_days(sales: DataFrame, series: str, day: str) -> int:
    """The rows that gap filling will make: all days from each series' first to its last sale."""
    date = F.col(day).cast("date")
    spans = sales.where(F.col(series).isNotNull()).groupBy(series).agg((F.datediff(F.max(date), F.min(date)) + 1).alias("days"))
    return spans.agg(F.sum("days")).first()[0] or 0


def spread(daily: DataFrame, days: int) -> DataFrame:
    """Deal rows by series over as many tasks as `days` calendar days take, DAYS_PER_TASK each.

    Spark joins shuffled partitions up to a size in compressed bytes. Gap filling and the columns
    added after it make some hundred times that of them, so the sorts and arrays of one task would grow
    with the table until they spill. Where every core has fewer, Spark's choice stays.
    """
    tasks = ceil(days / DAYS_PER_TASK)
    return daily.repartition(tasks, "series") if tasks > daily.sparkSession.sparkContext.defaultParallelism else daily


def densify(daily: DataFrame) -> DataFrame:
    """Fill each series' missing days, first to last, with zero demand.

    Every row stretches to the day before its successor, which needs no calendar
    table and no join: one window, then one `explode` in the same partitions.
    """
    until = F.coalesce(F.date_sub(F.lead("date").over(by_day()), 1), F.col("date"))
    stretched = daily.select("series", "date", "qty_sold", until.alias("until"))
    days = stretched.select(
        "series",
        F.explode(F.sequence("date", "until")).alias("day"),
        F.col("date").alias("sold_on"),
        "qty_sold",
    )
    sold = F.when(F.col("day") == F.col("sold_on"), F.col("qty_sold")).otherwise(F.lit(0.0))
    return days.select("series", F.col("day").alias("date"), sold.alias("qty_sold"))


def horizon_end(last_day: Column, policy: Policy) -> Column:
    """Last forecast day; a forecast year cuts the horizon at its 31 December."""
    end = F.date_add(last_day, policy.horizon_days)
    if policy.forecast_year is None:
        return end
    return F.least(end, F.make_date(F.lit(policy.forecast_year), F.lit(12), F.lit(31)))


def forecast_window(last_day: Column, policy: Policy) -> dict[str, Column]:
    return {"start": F.date_add(last_day, 1), "end": horizon_end(last_day, policy)}


def forecast_days(history: DataFrame, policy: Policy) -> DataFrame:
    """(series, step, date) for every day to forecast; step counts from 0."""
    last = history.groupBy("series").agg(F.max("date").alias("last_day"))
    return explode_window(last.withColumns(forecast_window(F.col("last_day"), policy)))


def explode_window(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per day from `start` to `end`. A history past the cut has none."""
    return rows.where(F.col("start") <= F.col("end")).select(
        "series", *keep, F.posexplode(F.sequence("start", "end")).alias("step", "date")
    )


def append_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History followed by forecast rows; columns one side lacks are null there."""
    return history.unionByName(forecast, allowMissingColumns=True)


def last_rows(history: DataFrame, k: int) -> DataFrame:
    """Each series' k latest rows, with `age` 1 for the newest."""
    newest = Window.partitionBy("series").orderBy(F.desc("date"))
    return history.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= k)


def recent_mean(history: DataFrame, k: int) -> DataFrame:
    """(series, recent_mean, last_day): mean quantity of the k latest rows."""
    return last_rows(history, k).groupBy("series").agg(
        F.avg("qty_sold").alias("recent_mean"), F.max("date").alias("last_day")
    )
