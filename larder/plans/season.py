"""The two end-to-end runs, built from the operators.

`season_*` is the current run: features, ridge per series, recursive forecast, vendor-day
scheduler. `weekly_*` is the older one: tuned alpha, weekly balance, daily signals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.advisories import unpivot_signals, weekly_advisories
from larder.operators.exports import advisory_export, plan_export, with_window
from larder.operators.features import split_features, training_rows
from larder.operators.forecast import LONGEST_WINDOW, as_plan, forecast_demand, forecast_with, with_need_columns
from larder.operators.ledger import daily_signals
from larder.operators.ridge import fit_best_alpha
from larder.operators.scheduler import schedule, schedule_advisories, scheduled_plan
from larder.operators.stock import last_stock
from larder.operators.weekly import balance_advisories, balance_plan, weekly_balance
from larder.session import settle
from larder.sources.published import publish
from larder.sources.sales import read_csv
from larder.tables import Policy

FILES_PER_WINDOW = 32


def in_order(advisories: DataFrame, *first: str, files: int | None = None) -> DataFrame:
    """Advisories by series, day and type over all files, read by name; as many files as they need, or `files`.

    Rows go to the files by ranges of (series, date, type), so a long series spreads over several. Columns
    that the table is partitioned by come `first`.
    """
    keys = [*first, "series", "date", "type"]
    if files is None:
        return advisories.orderBy(*keys)
    return advisories.repartitionByRange(files, *keys).sortWithinPartitions(*keys)


def season_days(history: DataFrame, policy: Policy, bootstrap: bool = False) -> DataFrame:
    """Forecast every series and schedule the forecast days."""
    forecast = forecast_demand(history, policy, bootstrap)
    return schedule(as_plan(forecast), policy)


def run_season(history: DataFrame, policy: Policy, out: str, run_id: str) -> None:
    """Publish `<out>/plan` and `<out>/advisories`.

    The scheduled days feed both tables, so they are settled in the shared folder first.
    """
    days = settle(season_days(history, policy), "season")
    plan = with_need_columns(scheduled_plan(days), policy)
    publish(plan_export(plan), f"{out}/plan", run_id)
    publish(in_order(advisory_export(schedule_advisories(days, policy))), f"{out}/advisories", run_id)


def weekly_days(
    history: DataFrame, policy: Policy, last_train_day: str, stock: DataFrame | None = None
) -> DataFrame:
    """Tune and fit on the train part, forecast after the history, balance week by week."""
    train, _ = split_features(history, last_train_day)
    model = fit_best_alpha(training_rows(train))
    forecast = forecast_with(history, model, policy, LONGEST_WINDOW)
    opening = None if stock is None else last_stock(stock)
    return weekly_balance(as_plan(forecast.select("series", "date", "qty_sold", "forecast_method")), policy, opening)


def weekly_tables(
    days: DataFrame, policy: Policy, stock: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan with needs, signals, advisories) of balanced days."""
    opening = None if stock is None else last_stock(stock)
    plan = balance_plan(days)
    return with_need_columns(plan, policy), daily_signals(plan, policy, opening), balance_advisories(days, policy)


def with_signal_columns(plan: DataFrame, signals: DataFrame, policy: Policy) -> DataFrame:
    """The wide plan of the older run: one `signal_<ingredient>` column per recipe line."""
    wide = signals.groupBy("series", "date").agg(*[
        F.max(F.when(F.col("ingredient") == i, F.col("signal"))).alias(f"signal_{i}") for i in policy.ingredients
    ])
    return plan.join(wide, ["series", "date"])


def run_weekly(
    history: DataFrame, policy: Policy, last_train_day: str, out: str, run_id: str, stock: DataFrame | None = None
) -> None:
    """Publish plan and advisories of the older run, in folders named by the window."""
    days = settle(weekly_days(history, policy, last_train_day, stock), "weekly")
    plan, signals, advisories = weekly_tables(days, policy, stock)
    wide = with_signal_columns(plan, signals, policy)
    windows = ("window_start", "window_end")
    placed = with_window(plan_export(wide)).repartition(*windows, F.pmod(F.xxhash64("series"), F.lit(FILES_PER_WINDOW)))
    publish(placed, f"{out}/plan", run_id, *windows)
    publish(in_order(advisory_export(advisories)), f"{out}/advisories", run_id)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A wide plan written as CSV or Parquet, its date and signal columns typed by name."""
    is_csv = path.rstrip("/").lower().endswith(".csv")
    plan = read_csv(spark, path) if is_csv else spark.read.parquet(path)
    signals = {c: F.col(c).try_cast("int") for c in plan.columns if c.startswith("signal_")}
    return plan.withColumns({"date": F.col("date").try_cast("date"), **signals})


def run_advisories_from_plan(spark: SparkSession, plan_path: str, out: str, run_id: str, policy: Policy) -> None:
    """Weekly advisories derived from a stored plan, published with the plan's name as `source`."""
    signals = unpivot_signals(read_plan(spark, plan_path))
    source = plan_path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv")
    advisories = weekly_advisories(signals, policy).withColumn("source", F.lit(source))
    publish(in_order(advisory_export(advisories), "source"), out, run_id, "source")
