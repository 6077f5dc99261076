"""Advisory wording.

Texts are concatenated from their parts rather than run through a formatter, so they
stay cheap, generated code even over many rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The advisory text formats and the markers that readers look for.
BUY_TEXT = "{day}: BUY {qty} {ingredient} (stock {stock} < ROP {rop}). Target cover={target}."
SPECIAL_TEXT = "{day}: Scheduled {qty} extra items to burn surplus of {ingredient}."
WEEK_BUY_TEXT = "{day}: BUY EXTRA {ingredient} this week — projected shortage ahead."
WEEK_SPECIAL_TEXT = "{day}: SURPLUS projected — run a {ingredient} special. Suggested items: {ideas}."
PREDICTION_TEXT = "Pred {mean} ({lower}–{upper})"
AVERAGE_TEXT = "Based on recent average: {mean} items per day"
DEMAND_BUY_TEXT = "{day}: BUY {qty} {ingredient} - based on recent demand of {mean} items/day"
WEEKEND_TEXT = "{day}: Weekend special recommended - surplus expected"
PROCESSED_TEXT = "Processed {rows} rows successfully"
PLACEHOLDER_MARKERS = ("Default output", "Based on recent average")
PLACEHOLDER_PREFIX = "Default output"


def fill(text: str, **columns: Column) -> Column:
    """A text with `{name}` places, filled from columns; null when one of them is."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[
        columns[part].cast("string") if i % 2 else F.lit(part) for i, part in enumerate(parts) if part
    ])


def one_place(number: Column) -> Column:
    """One decimal as plain digits, halves to even."""
    return F.bround(number.cast("double"), 1).cast("decimal(38,1)")


def advisory_type(kind: str | Column, ingredient: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("_"), F.upper(ingredient))


def prediction_summary(mean: Column, lower: Column, upper: Column) -> Column:
    return fill(PREDICTION_TEXT, mean=one_place(mean), lower=one_place(lower), upper=one_place(upper))


def with_summary(message: Column, summary: Column) -> Column:
    return F.concat_ws(" — ", message, summary)


def buy_message(day, qty, ingredient, stock, rop, target) -> Column:
    return fill(BUY_TEXT, day=day, qty=qty, ingredient=ingredient, stock=stock, rop=rop, target=target)


def special_message(day, qty, ingredient) -> Column:
    return fill(SPECIAL_TEXT, day=day, qty=qty, ingredient=ingredient)


def week_buy_message(day, ingredient) -> Column:
    return fill(WEEK_BUY_TEXT, day=day, ingredient=ingredient)


def week_special_message(day, ingredient, ideas) -> Column:
    return fill(WEEK_SPECIAL_TEXT, day=day, ingredient=ingredient, ideas=ideas)
