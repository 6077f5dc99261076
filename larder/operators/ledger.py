"""Daily shortage/surplus signals per ingredient."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.grid import LONGS, Segments, days_of, fold, matrix, nest, unnest
from larder.operators.settings import with_settings
from larder.tables import Policy


def _walk(batch) -> dict:
    lines = Segments(batch["per_item"])
    per, reorder, restock, stock = (lines.flat(batch[c]) for c in ("per_item", "reorder_point", "restock_amount", "stock0"))
    qty = matrix(batch["qty_total"])
    average = np.maximum(1, batch["mean_qty"].to_numpy().astype(np.int64))
    safety = lines.of(batch["safety_days"].to_numpy() * average) * per
    threshold = np.maximum(reorder, safety)
    surplus = safety * lines.of(batch["surplus_factor"].to_numpy())
    signal = np.zeros((qty.shape[1], len(per)), dtype=np.int64)
    for day in range(qty.shape[1]):
        after = stock - np.trunc(lines.of(qty[:, day]) * per)
        short = after < threshold
        signal[day] = np.where(short, 1, np.where(after > surplus, -1, 0))
        stock = after + short * restock
    return {"signals": lines.lists(signal, batch["n"].to_numpy())}


def daily_signals(plan: DataFrame, policy: Policy, start_stock: DataFrame | None = None, settings: DataFrame | None = None) -> DataFrame:
    """signals(series, date, ingredient, signal): 1 short (and restocked), -1 surplus, else 0.

    `settings` (see `series_settings`) gives series their own recipe lines and rules.
    """
    nested = nest(plan, ["date", "qty_total"])
    total = F.aggregate("qty_total", F.lit(0).cast("long"), lambda acc, x: acc + x)
    sized = with_settings(nested.withColumn("mean_qty", total / F.col("n")), policy, start_stock, settings)
    folded = fold(sized, _walk, {"signals": LONGS}, keep=["series", "n", "date", "ingredients"])
    rows = unnest(folded.withColumn("signal", days_of("signals", F.size("ingredients"))), ["date", "signal"], keep=["ingredients"])
    lines = F.arrays_zip(F.col("ingredients").alias("ingredient"), "signal")
    return rows.select("series", "date", F.inline(lines))
