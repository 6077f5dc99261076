"""What the physical plans have to look like to hold on a cluster."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from larder.operators import spine
from larder.operators.spine import calendar_days, daily_totals, densify, spread
from larder.plans import season
from larder.registry import inputs
from larder.registry.queries import QUERIES
from larder.sources.published import publish
from tests.conftest import SF, rows_of


def executed(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_raw_rows_are_summed_before_the_exchange(spark):
    plan = executed(inputs.daily_sales(spark, SF))
    assert re.search(r"Exchange hashpartitioning\(series#\d+L, date#\d+", plan)
    assert "partial_sum" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan or (
        re.search(r"FileScan parquet \[l_suppkey#\d+L,l_quantity#\d+,l_shipdate#\d+\]", plan)
    )


@pytest.mark.parametrize("name", [
    "training_frame", "ridge_by_series", "alpha_search", "forecast_end_to_end", "schedule_plan", "surplus_rank",
    "weekly_balance_plan", "holdout_metrics", "season_run",
])
def test_the_raw_table_is_scanned_once(name, spark):
    plan = executed(QUERIES[name](spark, SF))
    assert plan.count("FileScan parquet [l_suppkey") == 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["holdout_metrics", "best_alpha_model", "season_run", "weekly_run", "schedule_advisories"])
def test_no_job_runs_while_a_plan_is_built(name, spark):
    context = spark.sparkContext
    context.setJobGroup(f"planning {name}", "")
    QUERIES[name](spark, SF)
    tracker = context.statusTracker()
    # reading a file's schema is a job of one task; nothing else may run
    for job in tracker.getJobIdsForGroup(f"planning {name}"):
        stages = [tracker.getStageInfo(s) for s in tracker.getJobInfo(job).stageIds]
        assert [s.numTasks for s in stages] == [1] and stages[0].name.startswith("parquet at")
    context.setLocalProperty("spark.jobGroup.id", None)


def test_windows_share_the_exchange_by_series(spark):
    plan = executed(QUERIES["surplus_rank"](spark, SF))
    assert len(re.findall(r" Exchange hashpartitioning", plan)) == 2


def test_a_hot_series_changes_nothing(spark):
    """Most raw rows in one series: the same daily totals as counting in plain Python."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("store"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 31).cast("int")).alias("day"),
        (F.col("id") % 7).alias("units"),
    )
    found = {(r[0], r[1]): r[2] for r in densify(daily_totals(rows, "store", "day", "units")).collect()}
    wanted = {}
    for i in range(200_000):
        key = (0 if i % 3 < 2 else i % 50, dt.date(2024, 1, 1) + dt.timedelta(days=i % 31))
        wanted[key] = wanted.get(key, 0) + i % 7
    assert found == wanted


def test_advisories_are_in_one_order_over_all_files(spark, tmp_path):
    days = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("series"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7919 % 900).cast("int")).alias("date"),
        F.concat(F.lit("BUY_"), F.col("id") % 5).alias("type"), "id")
    publish(season.in_order(days.repartition(5), files=9), str(tmp_path / "few"), "r")
    publish(season.in_order(days.repartition(5)), str(tmp_path / "any"), "r")
    for folder, least in (("few", 9), ("any", 1)):
        files = sorted((tmp_path / folder / "snapshot=r").glob("part-*.parquet"))
        assert len(files) >= least
        rows = [(r["series"], r["date"], r["type"]) for f in files for r in spark.read.parquet(str(f)).collect()]
        assert len(rows) == 4000 and rows == sorted(rows)
        if folder == "few":
            hot = [f for f in files if spark.read.parquet(str(f)).where("series = 'hot'").count()]
            assert len(hot) > 1


def test_plan_columns_with_unknown_values_are_rounded(spark):
    from larder.operators.exports import plan_export

    rows = [("a", 1, 2.5, 7.9), ("a", 2, 3.5, None), ("a", 3, 1.6, 2.5), ("b", 1, 2.5, 7.9), ("b", 2, -1.5, float("nan")),
            ("c", 1, 9.99, 4.5)]
    plan = spark.createDataFrame(rows, "series string, date int, apples_need double, dough_need double")
    found = [tuple(r) for r in plan_export(plan).orderBy("series", "date").collect()]
    assert found == [("a", 1, 2, 8), ("a", 2, 3, 0), ("a", 3, 1, 2), ("b", 1, 2, 8), ("b", 2, -1, 0), ("c", 1, 9, 4)]


def test_tasks_grow_with_the_calendar(spark, monkeypatch):
    """However many series there are, a task holds about as many calendar days."""
    monkeypatch.setattr(spine, "DAYS_PER_TASK", 1500)
    history = inputs.history(spark, SF)
    per_task = [r["count"] for r in history.groupBy(F.spark_partition_id()).count().collect()]
    days = sum(per_task)
    assert days == calendar_days(inputs.table(spark, SF, "lineitem"), "l_suppkey", "l_shipdate")
    assert history.rdd.getNumPartitions() == -(-days // 1500) > 4
    plain = densify(inputs.daily_sales(spark, SF))
    assert rows_of(history, "series", "date") == rows_of(plain, "series", "date")


def test_calendar_days_of_nothing(spark):
    daily = spark.createDataFrame([], "series string, date date, qty_sold double")
    assert calendar_days(daily, "series", "date") == 0
    assert spread(daily, 0).isEmpty()
