"""Recipe, lot and shelf-life tables, by series and ingredient.

They are joined, whatever their size; which side is sent where is the optimiser's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.quantities import round_up_lot
from larder.tables import DEFAULT_SHELF_LIFE_DAYS


def recipe_lines(recipe: DataFrame, lots: DataFrame | None = None, shelf_life: DataFrame | None = None,
                 lead_time_days: int = 2) -> DataFrame:
    """lines(series, ingredient, per_item, lot_size, expiry_days).

    recipe(series, ingredient, per_item), lots(series, ingredient, lot_size),
    shelf_life(ingredient, days). A missing lot size is 0, a missing shelf life the default.
    """
    lines = recipe.select("series", "ingredient", F.col("per_item").cast("double").alias("per_item"))
    if lots is None:
        lines = lines.withColumn("lot_size", F.lit(0).cast("bigint"))
    else:
        lines = lines.join(lots.select("series", "ingredient", "lot_size"), ["series", "ingredient"], "left")
    if shelf_life is None:
        lines = lines.withColumn("days", F.lit(None).cast("int"))
    else:
        lines = lines.join(shelf_life.select("ingredient", "days"), "ingredient", "left")
    shelf = F.coalesce("days", F.lit(DEFAULT_SHELF_LIFE_DAYS))
    return lines.select(
        "series", "ingredient", "per_item", F.coalesce("lot_size", F.lit(0)).cast("bigint").alias("lot_size"),
        (F.lit(lead_time_days) + F.floor(shelf / 2)).cast("int").alias("expiry_days"),
    )


def need_by_table(plan: DataFrame, lines: DataFrame, qty: str = "qty_total") -> DataFrame:
    """need(series, date, ingredient, need, lots_needed): each series by its own recipe."""
    need = F.col(qty) * F.col("per_item")
    return plan.select("series", "date", qty).join(lines, "series").select(
        "series", "date", "ingredient", need.alias("need"), round_up_lot(need, F.col("lot_size")).alias("lots_needed"))


def ideas_by_table(asked: DataFrame, menu: DataFrame, count: int = 5, default: str = "_default") -> DataFrame:
    """ideas(ingredient, seed, ideas) out of menu(ingredient, item), the default pool for unknown ones.

    Items of a pool are ranked by a hash with the seed, as `hashed_ideas` ranks them.
    """
    pools = menu.select("ingredient").distinct().select(F.col("ingredient").alias("pool"))
    pooled = asked.join(pools, F.col("ingredient") == F.col("pool"), "left").withColumn(
        "pool", F.coalesce("pool", F.lit(default)))
    offered = pooled.join(menu.select(F.col("ingredient").alias("pool"), "item"), "pool")
    rank = F.struct(F.md5(F.concat_ws("#", F.col("seed").cast("string"), "pool", "item").cast("binary")).alias("rank"), "item")
    picked = offered.groupBy("ingredient", "seed").agg(F.slice(F.sort_array(F.collect_list(rank)), 1, count).alias("_p"))
    return picked.select("ingredient", "seed", F.array_join(F.col("_p.item"), ", ").alias("ideas"))
