"""Stock history: restock flags, closing stock and running stock without restocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larder.tables import Policy


def by_item_day() -> WindowSpec:
    return Window.partitionBy("series", "ingredient").orderBy("date")


def to_long(wide: DataFrame, ingredients: list[str]) -> DataFrame:
    """Wide stock columns (`x_start`, `x_end`, `restocked_x`) -> one row per ingredient.

    A missing `restocked_x` is null, to be inferred by `restock_flags`.
    """
    def part(name: str, kind: str):
        return F.col(name).cast(kind) if name in wide.columns else F.lit(None).cast(kind)

    lines = F.array(*[
        F.struct(
            F.lit(i).alias("ingredient"),
            part(f"{i}_start", "double").alias("start"),
            part(f"{i}_end", "double").alias("end"),
            part(f"restocked_{i}", "int").alias("restocked"),
        )
        for i in ingredients
    ])
    return wide.select("series", "date", F.inline(lines))


def restock_flags(stock: DataFrame) -> DataFrame:
    """Fill `restocked`: 1 where a day opens above the previous close, 0 on the first day.

    Flags that came with the data stay as they are.
    """
    jumped = (F.col("start") > F.lag("end").over(by_item_day())).cast("int")
    inferred = F.coalesce(jumped, F.lit(0))
    given = F.col("restocked") if "restocked" in stock.columns else F.lit(None).cast("int")
    return stock.withColumn("restocked", F.coalesce(given, inferred))


def last_stock(stock: DataFrame) -> DataFrame:
    """start_stock(series, ingredient, qty): each ingredient's latest closing stock."""
    closing = F.max_by("end", "date").cast("bigint")
    return stock.groupBy("series", "ingredient").agg(closing.alias("qty"))


def start_stock_columns(plan: DataFrame, policy: Policy, start_stock: DataFrame | None) -> DataFrame:
    """Add `stock0`: each series' opening stock as an array in recipe order.

    `start_stock` has one row per series and ingredient; what it lacks comes from the policy.
    """
    defaults = F.array(*[F.lit(int(policy.start_stock.get(i, 0))).cast("bigint") for i in policy.ingredients])
    if start_stock is None:
        return plan.withColumn("stock0", defaults)
    given = start_stock.groupBy("series").agg(F.array(*[
        F.max(F.when(F.col("ingredient") == i, F.col("qty").cast("bigint"))) for i in policy.ingredients
    ]).alias("_given"))
    merged = F.zip_with(
        F.coalesce("_given", F.transform(defaults, lambda x: F.lit(None).cast("bigint"))),
        defaults,
        lambda a, b: F.coalesce(a, b),
    )
    return plan.join(given, "series", "left").withColumn("stock0", merged).drop("_given")


def clamped_running_stock(need: DataFrame, opening: str) -> DataFrame:
    """Stock after each day's need, never below zero, with no restock: pure windows.

    With c the unclamped running stock, the clamped one is c - min(0, lowest c so far).
    """
    so_far = by_item_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = need.withColumn("_c", F.col(opening) - F.sum("need").over(so_far))
    floor = F.least(F.lit(0.0), F.min("_c").over(so_far))
    return running.withColumn("stock", F.col("_c") - floor).drop("_c")
