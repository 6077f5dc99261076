"""Recipe lines and rules of every series, as the folds read them.

A series has one row of settings: its recipe lines as arrays (any number of lines, of any
ingredients) and its rules as single values. They come from tables of any size, one row per line or
per series; whatever a table leaves out is the policy's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.stock import start_stock_columns
from larder.tables import DEFAULT_SHELF_LIFE_DAYS, Policy

#: by line: type, and what a missing value stands for
LINES = {"ingredients": ("string", ""), "per_item": ("double", 0.0), "lot_size": ("bigint", 0), "shelf_days": ("int", DEFAULT_SHELF_LIFE_DAYS),
         "reorder_point": ("bigint", 0), "restock_amount": ("bigint", 0), "stock0": ("bigint", 0)}
RULES = {"vendor_day_of_week": "int", "specials_on": "array<int>", "special_cap": "int", "z": "double", "lead_days": "int",
         "restock_day_of_week": "int", "wanted_year": "int", "safety_days": "int", "surplus_factor": "double"}


def policy_rules(policy: Policy) -> dict[str, Column]:
    values = {
        "vendor_day_of_week": -1 if policy.vendor_weekday is None else policy.vendor_weekday,
        "special_cap": policy.special_boost_max_per_day, "z": policy.z, "lead_days": policy.lead_time_days,
        "restock_day_of_week": policy.restock_weekday, "wanted_year": policy.forecast_year,
        "safety_days": policy.safety_days, "surplus_factor": float(policy.surplus_factor),
    }
    days = F.array(*[F.lit(int(d)) for d in policy.special_days]) if policy.special_days else F.array()
    return {name: (days if name == "specials_on" else F.lit(values[name])).cast(kind) for name, kind in RULES.items()}


def policy_lines(policy: Policy) -> dict[str, Column]:
    values = {
        "ingredients": policy.ingredients, "per_item": [float(p) for p in policy.recipe.values()],
        "lot_size": [int(policy.lots.get(i, 0)) for i in policy.ingredients],
        "shelf_days": [int(policy.shelf_life.get(i, DEFAULT_SHELF_LIFE_DAYS)) for i in policy.ingredients],
        "reorder_point": [int(policy.reorder_points.get(i, 0)) for i in policy.ingredients],
        "restock_amount": [int(policy.restock_amounts.get(i, 0)) for i in policy.ingredients],
    }
    return {name: F.array(*[F.lit(v).cast(LINES[name][0]) for v in listed]) for name, listed in values.items()}


def series_settings(lines: DataFrame, rules: DataFrame | None = None, start_stock: DataFrame | None = None) -> DataFrame:
    """One row per series from tables by line and by series.

    lines(series, ingredient, per_item) with any of pos, lot_size, shelf_days, reorder_point,
    restock_amount and stock0; lines are ordered by pos, then ingredient. rules(series) with any of
    RULES. start_stock(series, ingredient, qty) is the opening stock where it has the line.
    A series' lines are gathered: a recipe is short.
    """
    if start_stock is not None:
        opening = start_stock.groupBy("series", "ingredient").agg(F.max("qty").cast("bigint").alias("_opening"))
        lines = lines.join(opening, ["series", "ingredient"], "left")
        given = F.col("stock0") if "stock0" in lines.columns else F.lit(None)
        lines = lines.withColumn("stock0", F.coalesce("_opening", given))

    def part(name: str) -> Column:
        kind, missing = LINES[name]
        source = "ingredient" if name == "ingredients" else name
        return F.coalesce(F.col(source).cast(kind) if source in lines.columns else F.lit(None).cast(kind), F.lit(missing).cast(kind)).alias(name)

    order = F.col("pos").cast("int") if "pos" in lines.columns else F.lit(0)
    gathered = lines.groupBy("series").agg(F.sort_array(F.collect_list(F.struct(order.alias("pos"), *[part(n) for n in LINES]))).alias("_l"))
    settings = gathered.select("series", *[F.col(f"_l.{n}").alias(n) for n in LINES])
    if rules is not None:
        given = [F.col(n).cast(kind).alias(n) for n, kind in RULES.items() if n in rules.columns]
        settings = settings.join(rules.select("series", *given), "series", "full")
    return settings


def with_rules(rows: DataFrame, policy: Policy, settings: DataFrame | None, *names: str) -> DataFrame:
    """Add rules to rows by series; by the policy where there is no value."""
    literal = policy_rules(policy)
    if settings is None:
        return rows.withColumns({name: literal[name] for name in names})
    known = [n for n in names if n in settings.columns]
    joined = rows.join(settings.select("series", *known), "series", "left")
    return joined.withColumns({n: F.coalesce(n, literal[n]) if n in known else literal[n] for n in names})


def with_settings(nested: DataFrame, policy: Policy, start_stock: DataFrame | None, settings: DataFrame | None) -> DataFrame:
    """Add all LINES and RULES to rows of one series each.

    With `settings`, their `stock0` is the opening stock; series without lines have the policy's.
    """
    if settings is None:
        return start_stock_columns(nested, policy, start_stock).withColumns({**policy_lines(policy), **policy_rules(policy)})
    lines = policy_lines(policy)
    own = start_stock_columns(nested, policy, start_stock).withColumnRenamed("stock0", "_stock0")
    joined = own.join(settings, "series", "left").withColumn("_own", F.col("ingredients").isNotNull())
    lines["stock0"] = F.col("_stock0")
    rules = policy_rules(policy)
    return joined.withColumns({
        **{n: F.when(F.col("_own"), F.col(n)).otherwise(column) for n, column in lines.items()},
        **{n: F.coalesce(n, column) if n in settings.columns else column for n, column in rules.items()},
    }).drop("_own", "_stock0")
