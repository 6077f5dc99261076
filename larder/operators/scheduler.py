"""Inventory-aware scheduling: vendor-day purchases and specials that burn surplus.

Means, deviations, lead-time demand and future need all follow from the baseline plan,
so they are windows over it. Only the stock on hand runs from day to day; it is stepped
through once per batch of series (see `grid`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import messages
from larder.functions.calendar import weekday
from larder.functions.quantities import reorder_point, safety_stock, whole
from larder.operators.advisories import advisory_table
from larder.operators.grid import LONGS, Segments, days_of, fold, lists, matrix, nest, unnest
from larder.operators.menu import idea_text
from larder.operators.spine import by_day, whole_series
from larder.operators.settings import with_settings
from larder.tables import REASONS, Policy

PREDICTIONS = ("pred_mean", "pred_lower", "pred_upper")


def std_proxy(qty: Column, window: int = 7) -> Column:
    """Rolling deviation; a quarter of the rolling mean where there is none."""
    frame = by_day().rowsBetween(-(window - 1), 0)
    std = F.coalesce(F.stddev_samp(qty).over(frame), F.lit(0.0))
    stand_in = F.coalesce(F.lit(0.25) * F.avg(qty).over(frame), F.lit(1.0))
    return F.when(std < 1e-6, stand_in).otherwise(std)


def summed(qty: Column, first: int, last: int) -> Column:
    """Sum over the rows `first`..`last` from here, cut at the end of the plan."""
    if last < first:
        return F.lit(0).cast("bigint")
    return F.coalesce(F.sum(qty).over(by_day().rowsBetween(first, last)), F.lit(0)).cast("bigint")


def demand_statistics(plan: DataFrame, policy: Policy) -> DataFrame:
    """Add the window statistics of a policy, in items per day: those of `demand_moments` and

    lead_demand          today and the rest of the lead time
    future_<days>        the `days` rows after today, for each distinct expiry window
    """
    futures = sorted({policy.expiry_days(i) for i in policy.ingredients})
    ahead = {"lead_demand": summed(F.col("qty_total"), 0, policy.lead_time_days - 1)}
    ahead |= {f"future_{days}": summed(F.col("qty_total"), 1, days) for days in futures}
    return demand_moments(plan.withColumns(ahead))


def demand_moments(plan: DataFrame) -> DataFrame:
    """Add means and deviations of past demand, in items per day.

    buy_mean, buy_std    the 28 rows before today; the whole plan's mean and the first
                         row's proxy where those are too few
    special_std          the same deviation with today included

    Means and deviations come from running totals and their value 29 rows back, so a row
    costs the same whatever the window's length. The totals are of whole numbers around
    the series' rounded mean: exact sums, and no cancellation of large squares.
    """
    qty, today = F.col("qty_total").cast("double"), by_day()
    shifted = plan.withColumn("_mean", F.avg(qty).over(whole_series())).withColumn("_c", qty - F.rint("_mean"))
    so_far = today.rowsBetween(Window.unboundedPreceding, 0)
    totals = shifted.withColumns({
        "_n": F.row_number().over(today),
        "_s": F.sum("_c").over(so_far),
        "_q": F.sum(F.col("_c") * F.col("_c")).over(so_far),
    })

    def back(column: str, rows: int) -> Column:
        return F.lag(column, rows, 0.0).over(today) if rows else F.col(column)

    columns = {
        "_s1": back("_s", 1) - back("_s", 29), "_q1": back("_q", 1) - back("_q", 29),
        "_s0": F.col("_s") - back("_s", 29), "_q0": F.col("_q") - back("_q", 29),
        # a deviation is undefined on the first row and, without today, on the second
        "_first": F.coalesce(F.lag(qty, 1).over(today), qty),
    }
    before, with_today = F.least(F.col("_n") - 1, F.lit(28)), F.least(F.col("_n"), F.lit(29))
    first_proxy = F.col("_first") * 0.25

    def deviation(n: Column, s: str, q: str) -> Column:
        spread = (n * F.col(q) - F.col(s) * F.col(s)) / (n * (n - 1))
        return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(first_proxy)

    mean = (F.rint("_mean") * before + F.col("_s1")) / before
    return totals.withColumns(columns).withColumns({
        "buy_mean": F.when(before > 0, mean).otherwise(F.col("_mean")),
        "buy_std": deviation(before, "_s1", "_q1"),
        "special_std": deviation(with_today, "_s0", "_q0"),
    }).select(*plan.columns, "buy_mean", "buy_std", "special_std")


def reorder_levels(lead_days: int | Column, z: float | Column, per_item: Column) -> tuple[Column, Column, Column]:
    """(safety, reorder point, target cover) in ingredient units from the statistics."""
    safety = safety_stock(F.col("buy_std") * per_item, lead_days, z)
    rop = reorder_point(F.col("buy_mean") * per_item, lead_days, safety)
    return safety, rop, F.col("lead_demand") * per_item + safety + per_item


def _keep_stock(batch) -> dict:
    lines = Segments(batch["per_item"])
    per, stock = lines.flat(batch["per_item"]), lines.flat(batch["stock0"])
    lots = np.maximum(lines.flat(batch["lot_size"]), 0)
    lot_or_one = np.where(lots > 0, lots, 1.0)
    usable = np.where(per > 0, per, np.inf)
    lead, z, cap, n = (batch[c].to_numpy() for c in ("lead_days", "z", "special_cap", "n"))
    lead_of, z_of, root_of = lines.of(lead), lines.of(z), lines.of(lead.astype(float) ** 0.5)
    expiry = lead_of + lines.flat(batch["shelf_days"], np.int64) // 2
    qty, vendor, special, buy_mean, buy_std, special_std = (
        matrix(batch[c]) for c in ("qty_total", "vendor_day", "special_day", "buy_mean", "buy_std", "special_std")
    )
    rows, days = qty.shape
    so_far = np.zeros((rows, days + 1))
    np.cumsum(qty, axis=1, out=so_far[:, 1:])
    every, last = np.arange(rows), lines.of(n)
    lead_demand = np.zeros((rows, days), dtype=np.int64)
    orders, held, extras = (np.zeros((days, len(per)), dtype=np.int64) for _ in range(3))

    def safety_of(std: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, z_of * (lines.of(std) * per) * root_of)

    for day in range(days):
        lead_demand[:, day] = so_far[every, np.minimum(day + lead, days)] - so_far[:, day]
        opens = vendor[:, day] == 1
        if opens.any():
            safety = safety_of(buy_std[:, day])
            rop = lines.of(buy_mean[:, day]) * per * lead_of + safety
            target = lines.of(lead_demand[:, day]) * per + safety + per
            order = np.ceil(np.maximum(0.0, target - stock) / lot_or_one) * lot_or_one
            order = np.where(lines.of(opens) & (stock < rop), order, 0.0)
            orders[day], held[day] = order, stock
            stock = stock + order

        stock = np.maximum(0.0, stock - np.rint(lines.of(qty[:, day]) * per))

        tonight = special[:, day] == 1
        if tonight.any():
            future = so_far[lines.row, np.minimum(day + 1 + expiry, last)] - so_far[lines.row, np.minimum(day + 1, last)]
            surplus = stock - np.rint(future * per) - safety_of(special_std[:, day])
            turn = lines.ranked(surplus)
            for rank in range(int(lines.width.max())):
                those = lines.width > rank
                line = turn[lines.begin[those] + rank]
                spare = surplus[line]
                add = np.minimum(cap[those], np.floor_divide(spare, usable[line]))
                fits = stock[line] - add * per[line] >= 0
                add = np.where(tonight[those] & (spare > 0) & (add > 0) & fits, add, 0.0)
                extras[day, line] = add
                made = np.zeros(rows)
                made[those] = add
                stock = np.maximum(0.0, stock - np.rint(lines.of(made) * per))
    return {**{name: lines.lists(grid, n) for name, grid in (("orders", orders), ("held", held), ("extras", extras))},
            "lead_demand": lists(lead_demand, n)}


def schedule(plan: DataFrame, policy: Policy, start_stock: DataFrame | None = None, settings: DataFrame | None = None) -> DataFrame:
    """One row per planned day with the scheduler's decisions.

    `orders`, `held` (stock at ordering time) and `extras` are arrays in recipe order, as are
    `ingredients` and `per_item`; `special_added` and `qty_total` include the extras. `settings` (see
    `series_settings`) gives series their own recipe lines and rules; lead-time demand
    and future need are differences of running totals, so each line looks as far ahead as
    its own shelf life. Write or cache the result when both `scheduled_plan` and
    `schedule_advisories` are wanted.
    """
    given = [p for p in (*PREDICTIONS, "forecast_method") if p in plan.columns]
    numbers = demand_moments(plan)
    columns = ["date", "qty_sold", "qty_total", "special_added", "buy_mean", "buy_std", "special_std", *given]
    ruled = with_settings(nest(numbers, columns), policy, start_stock, settings)
    nested = ruled.withColumns({
        "vendor_day": F.transform("date", lambda d: (weekday(d) == F.col("vendor_day_of_week")).cast("int")),
        "special_day": F.transform("date", lambda d: F.array_contains("specials_on", weekday(d)).cast("int")),
    })
    decided = ["orders", "held", "extras"]
    kept = ["date", "qty_sold", "qty_total", "special_added", "buy_mean", "buy_std", *given]
    own = ["ingredients", "per_item", "lead_days", "z"]
    folded = fold(nested, _keep_stock, dict.fromkeys([*decided, "lead_demand"], LONGS), keep=["series", "n", *own, *kept])
    sliced = folded.withColumns({name: days_of(name, F.size("per_item")) for name in decided})
    days = unnest(sliced, [*kept, "lead_demand", *decided], keep=own)
    extra = F.aggregate("extras", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return days.withColumns({
        "special_added": F.col("special_added") + extra,
        "qty_total": F.col("qty_total") + extra,
    })


def scheduled_plan(days: DataFrame) -> DataFrame:
    given = [p for p in (*PREDICTIONS, "forecast_method") if p in days.columns]
    return days.select("series", "date", "qty_sold", "qty_total", "special_added", *given)


def schedule_advisories(days: DataFrame, policy: Policy) -> DataFrame:
    """BUY and SPECIAL rows in the advisory layout."""
    nothing = F.lit(None).cast("bigint")
    decisions = F.flatten(F.transform(F.sequence(F.lit(0), F.size("per_item") - 1), lambda k: F.array(*[
        F.struct(
            F.get("ingredients", k).alias("ingredient"),
            F.get("per_item", k).alias("per_item"),
            F.get("held", k).alias("held"),
            (F.get("orders", k) if kind == "BUY" else nothing).alias("qty"),
            (nothing if kind == "BUY" else F.get("extras", k)).alias("special_qty"),
        )
        for kind in ("BUY", "SPECIAL")
    ])))
    given = [p for p in PREDICTIONS if p in days.columns]
    decided = F.exists("orders", lambda q: q > 0) | F.exists("extras", lambda q: q > 0)
    rows = days.where(decided).select(
        "series", "date", "buy_mean", "buy_std", "lead_demand", "lead_days", "z", *given,
        F.explode(decisions).alias("_d")
    ).select("*", "_d.*").drop("_d"
    ).where((F.col("qty") > 0) | (F.col("special_qty") > 0))

    date, ingredient, buys = F.col("date"), F.col("ingredient"), F.col("qty") > 0
    _, rop, target = reorder_levels(F.col("lead_days"), F.col("z"), F.col("per_item"))
    buy = messages.buy_message(date, F.col("qty"), ingredient, F.col("held"), whole(rop), whole(target))
    special = messages.special_message(date, F.col("special_qty"), ingredient)
    summary = F.lit(None).cast("string")
    if len(given) == len(PREDICTIONS):
        summary = messages.prediction_summary(*[F.col(p) for p in PREDICTIONS])
    worded = rows.withColumns({
        "pred_summary": summary,
        "type": messages.advisory_type(F.when(buys, "BUY").otherwise("SPECIAL"), ingredient),
        "text": F.when(buys, buy).otherwise(special),
        "suggestions": F.when(~F.coalesce(buys, F.lit(False)), idea_text(ingredient, policy)),
        "reason": F.when(buys, REASONS["buy"]).otherwise(REASONS["special"]),
    })
    return advisory_table(worded.withColumn(
        "message", messages.with_summary(F.col("text"), F.col("pred_summary"))
    ))


def surplus_lines(plan: DataFrame, policy: Policy) -> DataFrame:
    """Each planned day's ingredients with their need, future need and safety stock."""
    numbers = demand_statistics(plan, policy)
    lines = F.array(*[
        F.struct(
            F.lit(pos).alias("pos"),
            F.lit(i).alias("ingredient"),
            (F.col("qty_total") * F.lit(float(per))).alias("need"),
            whole(F.col(f"future_{policy.expiry_days(i)}") * F.lit(float(per))).alias("future_need"),
            safety_stock(F.col("special_std") * F.lit(float(per)), policy.lead_time_days, policy.z).alias("safety"),
        )
        for pos, (i, per) in enumerate(policy.recipe.items())
    ])
    return numbers.select("series", "date", F.inline(lines))


def rank_surplus(lines: DataFrame) -> DataFrame:
    """Add `surplus` over future need and safety, and its `rank` within the day.

    Largest first, ties in recipe order. `lines` has a `stock` column; rows that are
    already partitioned by series stay where they are.
    """
    surplus = F.col("stock") - F.col("future_need") - F.col("safety")
    order = Window.partitionBy("series", "date").orderBy(F.desc("surplus"), "pos")
    return lines.withColumn("surplus", surplus).withColumn("rank", F.row_number().over(order))
