"""Report layouts of the plan and advisory tables, and their JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.calendar import date_text
from larder.operators.spine import whole_series

PLAN_INTEGERS = ("qty_total", "special_added")


def plan_export(plan: DataFrame) -> DataFrame:
    """Whole-number plan: totals, specials and `_need` columns as integers.

    A column is cut, unless it has an unknown value somewhere in the series: then it is rounded, half to
    even, and the unknown values are 0. Integer columns need no look at the rest of the series.
    """
    whole = [c for c in plan.columns if c in PLAN_INTEGERS or c.endswith("_need")]
    fractions = {f.name for f in plan.schema.fields if isinstance(f.dataType, T.FractionalType)}
    columns = {}
    for name in whole:
        number = F.col(name)
        if name in fractions:
            known = F.when(~F.isnan(number), number.cast("double"))
            gaps = F.max(known.isNull()).over(whole_series())
            number = F.when(gaps, F.rint(known)).otherwise(known)
        columns[name] = F.coalesce(number.cast("bigint"), F.lit(0).cast("bigint"))
    return plan.withColumns(columns)


def advisory_export(advisories: DataFrame) -> DataFrame:
    """Whole quantities (unreadable ones null, a missing special 0), predictions to 1 place."""
    columns = {}
    if "qty" in advisories.columns:
        columns["qty"] = F.col("qty").try_cast("double").cast("bigint")
    if "special_qty" in advisories.columns:
        special = F.col("special_qty").try_cast("double").cast("bigint")
        columns["special_qty"] = F.coalesce(special, F.lit(0).cast("bigint"))
    for name in ("pred_mean", "pred_lower", "pred_upper"):
        if name in advisories.columns:
            columns[name] = F.bround(name, 1)
    if "date" in advisories.columns:
        columns["date"] = date_text(F.col("date"))
    return advisories.withColumns(columns)


def with_window(table: DataFrame) -> DataFrame:
    """Add each series' first and last planned day, the columns exports are named by."""
    return table.withColumns({
        "window_start": F.min("date").over(whole_series()), "window_end": F.max("date").over(whole_series()),
    })


def write_export(table: DataFrame, path: str, *partitions: str) -> None:
    """CSV with a header, one folder per partition value; existing files are replaced."""
    table.write.mode("overwrite").option("header", True).partitionBy(*partitions).csv(path)


def to_json_rows(table: DataFrame, *keep: str) -> DataFrame:
    """Each row as a JSON record: not-a-number becomes null, nulls are spelled out."""
    clean = {
        f.name: F.when(F.isnan(f.name), None).otherwise(F.col(f.name))
        for f in table.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    cleaned = table.withColumns(clean) if clean else table
    return cleaned.select(*keep, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
