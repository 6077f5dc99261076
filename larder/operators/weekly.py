"""Weekly balance: Monday purchases, end-of-week specials and extra production."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.calendar import iso_week, iso_year, weekday
from larder.operators.advisories import advisory_table, weekly_texts
from larder.operators.grid import LONGS, Segments, days_of, fold, lists, matrix, nest, unnest
from larder.operators.settings import with_rules, with_settings
from larder.tables import Policy


def monday() -> Column:
    """The week's Monday, which stands for its ISO year and week."""
    return F.date_sub("date", weekday(F.col("date")))


def week_totals(plan: DataFrame) -> DataFrame:
    """(series, iso_year, iso_week, mean_qty, total_qty, first_day, last_day)."""
    return plan.groupBy(
        "series", iso_year(F.col("date")).alias("iso_year"), iso_week(F.col("date")).alias("iso_week")
    ).agg(
        F.avg("qty_total").alias("mean_qty"),
        F.sum("qty_total").alias("total_qty"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )


def special_fill(extra: Column, cap: int | Column, nth_special: Column) -> Column:
    """The part of `extra` made on a week's n-th special day, `cap` at most per day."""
    cap = F.lit(cap)
    return F.greatest(F.lit(0), F.least(cap, extra - cap * (nth_special - 1)))


def with_week(plan: DataFrame, policy: Policy, settings: DataFrame | None = None) -> DataFrame:
    """Each day with its week's figures; one more in-partition sort, no more exchange."""
    week = Window.partitionBy("series", "_monday")
    in_order = week.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rules = ("specials_on", "restock_day_of_week", "wanted_year")
    wanted_year = F.col("wanted_year").isNull() | (F.year("date") == F.col("wanted_year"))
    special = F.array_contains("specials_on", weekday(F.col("date"))).cast("int")
    ruled = with_rules(plan, policy, settings, *rules)
    return ruled.withColumn("_monday", monday()).withColumn("special_day", special).withColumns({
        "week_mean": F.avg("qty_total").over(week),
        "week_qty": F.sum("qty_total").over(week),
        "specials": F.sum("special_day").over(week).cast("int"),
        "nth_special": F.sum("special_day").over(in_order).cast("int"),
        "counted": F.bool_or(wanted_year).over(week).cast("int"),
        "week_start": F.min("date").over(week),
        "week_end": F.max("date").over(week),
    }).withColumns({
        "is_start": (F.col("date") == F.col("week_start")).cast("int"),
        "delivery": (weekday(F.col("week_start")) == F.col("restock_day_of_week")).cast("int"),
    }).drop("_monday", *rules)


def _balance(batch) -> dict:
    lines = Segments(batch["per_item"])
    per, reorder, restock, stock = (lines.flat(batch[c]) for c in ("per_item", "reorder_point", "restock_amount", "stock0"))
    safety_days, factor, cap = (batch[c].to_numpy() for c in ("safety_days", "surplus_factor", "special_cap"))
    used = np.where(per > 0, per, np.inf)
    start, counted, delivery, mean, qty, specials = (
        matrix(batch[c]) for c in ("is_start", "counted", "delivery", "week_mean", "week_qty", "specials")
    )
    rows, days = start.shape
    buy = np.zeros((days, len(per)), dtype=np.int64)
    extra = np.zeros((rows, days), dtype=np.int64)
    pick = np.zeros((rows, days), dtype=np.int64)
    for day in range(days):
        opens = start[:, day] == 1
        live = opens & (counted[:, day] == 1)
        safety = lines.of(safety_days * np.maximum(1, np.trunc(mean[:, day]))) * per
        threshold = np.maximum(reorder, safety)
        need = lines.of(qty[:, day]) * per
        buys = (stock - need < threshold) & lines.of(live & (delivery[:, day] == 1))
        stock = stock + buys * restock - need * lines.of(live)
        surplus = live & lines.most(stock > safety * lines.of(factor))
        spare = np.where(per > 0, np.floor_divide(stock - threshold, used), np.inf)
        possible = np.where(surplus, lines.least(np.maximum(0, spare)), 0)
        possible = np.minimum(possible, float(2**53))
        made = np.minimum(possible, cap * specials[:, day])
        stock = stock - lines.of(made) * per

        buy[day] = buys
        before = max(day - 1, 0)
        extra[:, day] = np.where(opens, possible, extra[:, before])
        named = lines.largest(stock + lines.of(made) * per - safety) + 1
        pick[:, day] = np.where(opens, np.where(surplus, named, 0), pick[:, before])
    n = batch["n"].to_numpy()
    return {"buy": lines.lists(buy, n), "extra": lists(extra, n), "pick": lists(pick, n)}


def weekly_balance(plan: DataFrame, policy: Policy, start_stock: DataFrame | None = None, settings: DataFrame | None = None) -> DataFrame:
    """Days with `special_added`, `qty_total` and what each week decided.

    `buy` (per recipe line, on the week's first day), `extra` and `pick` (the 1-based
    recipe line of the week's special, 0 for none) feed `balance_advisories`. The only
    sequential state is the stock per recipe line. `settings` (see `series_settings`) gives series
    their own recipe lines and rules.
    """
    kept = ["date", "qty_total", "special_day", "nth_special", "week_start", "week_end"]
    kept += [c for c in ("forecast_method",) if c in plan.columns]
    columns = [*kept, "is_start", "counted", "delivery", "week_mean", "week_qty", "specials"]
    nested = with_settings(nest(with_week(plan, policy, settings), columns), policy, start_stock, settings)
    decided = {"buy": LONGS, "extra": LONGS, "pick": LONGS}
    own = ["ingredients", "special_cap"]
    folded = fold(nested, _balance, decided, keep=["series", "n", *own, *kept])
    days = unnest(folded.withColumn("buy", days_of("buy", F.size("ingredients"))), [*kept, *decided], keep=own)
    fill = special_fill(F.col("extra"), F.col("special_cap"), F.col("nth_special"))
    added = F.when(F.col("special_day") == 1, fill).otherwise(0)
    return days.withColumnRenamed("qty_total", "qty_sold").withColumn("special_added", added).withColumn(
        "qty_total", F.col("qty_sold") + F.col("special_added")
    ).drop("special_cap")


def balance_plan(days: DataFrame) -> DataFrame:
    given = [c for c in ("forecast_method",) if c in days.columns]
    return days.select("series", "date", "qty_sold", "special_added", "qty_total", *given)


def balance_advisories(days: DataFrame, policy: Policy) -> DataFrame:
    """BUY rows on a week's first day, one SPECIAL row on the last day of a surplus week."""
    date = F.col("date")
    starts, ends = date == F.col("week_start"), date == F.col("week_end")
    places = F.sequence(F.lit(0), F.size("ingredients") - 1)
    advice = F.flatten(F.transform(places, lambda k: F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.get("ingredients", k).alias("ingredient"), due.alias("due"))
        for kind, due in (("BUY", starts & (F.get("buy", k) == 1)), ("SPECIAL", ends & (F.col("pick") == k + 1)))
    ])))
    found = days.where(starts | ends).select(
        "series", "date", iso_week(date).alias("week"),
        F.col("week_start").alias("window_start"), F.col("week_end").alias("window_end"),
        F.inline(advice),
    ).where("due")
    return advisory_table(weekly_texts(found, policy))
