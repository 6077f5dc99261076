"""The star-schema tables seen as sales, stock, plans, signups and contacts.

Suppliers play the series. All inputs cover the whole tables.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.quantities import with_recipe
from larder.operators.features import with_past_means
from larder.operators.spine import calendar_days, daily_totals, densify, spread
from larder.tables import Policy

POLICY = Policy(shelf_life={"dough": 6})
LAST_TRAIN_DAY = "1999-12-31"
CUT_DAYS = [str(date(1999, month + 1, 1) - timedelta(days=1)) for month in range(1, 12)] + [LAST_TRAIN_DAY]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with sales only."""
    return daily_totals(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from a series' first to its last sale."""
    days = calendar_days(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate")
    return densify(spread(daily_sales(spark, sf_dir), days))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as a baseline plan; the last full week's mean plays the prediction."""
    week, qty = F.col("week"), F.col("qty_sold").cast("bigint")
    return with_past_means(history(spark, sf_dir), {"week": 7}, full_only=True).select(
        "series", "date", qty.alias("qty_sold"), qty.alias("qty_total"),
        F.lit(0).cast("bigint").alias("special_added"),
        week.alias("pred_mean"), (week * 0.8).alias("pred_lower"), (week * 1.2).alias("pred_upper"),
    )


def bare_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).drop("pred_mean", "pred_lower", "pred_upper")


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock that is refilled by a lot whenever the running need crosses one."""
    rows = with_recipe(history(spark, sf_dir), POLICY, "ingredient", "per_item", "lot_size")
    so_far = Window.partitionBy("series", "ingredient").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    need = F.col("qty_sold") * F.col("per_item")
    used = rows.withColumn("need", need).withColumn("used", F.sum("need").over(so_far))
    end = F.col("lot_size") - F.pmod(F.col("used"), F.col("lot_size").cast("double"))
    return used.withColumn("end", end).select(
        "series", "date", "ingredient", (F.col("end") + F.col("need")).alias("start"), "end"
    )


def signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signups: the same person with differing case, some malformed."""
    user = F.when(F.col("event_id") % 2 == 0, "User").otherwise("user")
    address = F.concat(user, F.col("user_id").cast("string"), F.lit("@example.com"))
    broken = F.when(F.col("event_id") % 11 == 0, F.concat(user, F.lit("@nowhere")))
    broken = broken.when(F.col("event_id") % 13 == 0, F.lit("   "))
    return table(spark, sf_dir, "events").select(
        F.coalesce(broken, F.concat(F.lit(" "), address)).alias("email"), "ts", "event_id"
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as contact messages, some of them incomplete."""
    conv, turn = F.col("conv_id"), F.col("turn")
    email = F.when(conv % 7 == 0, "").when(conv % 5 == 0, "nobody").otherwise(
        F.concat(F.lit("c"), conv.cast("string"), F.lit("@example.com"))
    )
    seconds = (conv * 60 + turn).cast("int")
    ts = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )
    return table(spark, sf_dir, "conversations").select(
        F.when(turn % 9 == 4, F.lit("  ")).otherwise(F.col("role")).alias("name"),
        email.alias("email"),
        F.col("text").alias("message"),
        ts.alias("ts"),
        "conv_id", "turn",
    )


PANTRY = ("apples", "dough", "cinnamon", "butter", "sugar")


def recipe_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two to five recipe lines per series, and rules of its own for every series but each fifth."""
    s, k = F.col("series"), F.col("pos")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("series"))
    lines = suppliers.select("series", F.posexplode(F.array(*map(F.lit, PANTRY))).alias("pos", "ingredient")).where(k < 2 + s % 4)
    lines = lines.withColumns({
        "per_item": 1 + (s + k) % 3,
        "lot_size": F.when(k != 2, 10 * (1 + s % 5)),
        "shelf_days": 3 + (s + 2 * k) % 6,
        "reorder_point": 20 * (k + 1),
        "restock_amount": 100 + 50 * ((s + k) % 3),
        "stock0": 40 * (k + 1),
    })
    rules = suppliers.where(s % 5 != 4).withColumns({
        "vendor_day_of_week": s % 7,
        "specials_on": F.array(s % 7, (s + 3) % 7),
        "special_cap": 3 + s % 3,
        "lead_days": 1 + s % 3,
        "restock_day_of_week": s % 2,
    })
    return lines, rules
