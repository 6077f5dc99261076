import datetime as dt
import math
import time
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from larder.functions import messages
from larder.functions.calendar import calendar_features, iso_week, iso_year
from larder.functions.quantities import round_up_lot, safety_stock, weekday_list, whole, z_scores
from larder.operators.menu import hashed_ideas, random_ideas, seeded_ideas
from larder.session import CLEANUP, settle
from larder.sources.policy import ideas_by_table, need_by_table, recipe_lines
from larder.tables import Policy, weekday_numbers
from tests.conftest import rows_of


def test_weekday_numbers():
    assert weekday_numbers(["Mon", "thursday", 6, 7, "xyz", " sun ", 6]) == [0, 3, 6]
    assert weekday_numbers(None) == []


def test_policy_defaults_and_config():
    assert Policy().with_(vendor_weekday="Tuesday").vendor_weekday == 1
    policy = Policy.from_config({
        "store": {"vendor_weekday": 2, "restock_lot_size": {"flour": 10}, "lead_time_days": 3},
        "production": {"recipe": {"flour": 2}},
        "forecast": {"forecast_horizon_days": 30, "forecast_year": 2026},
    })
    assert (policy.vendor_weekday, policy.lead_time_days, policy.horizon_days) == (2, 3, 30)
    assert policy.special_days == (3, 4, 5, 6) and policy.ingredients == ["flour"]
    assert Policy.from_config(None) == Policy()
    assert math.isclose(Policy().z, 1.6448536269514722, rel_tol=1e-14)
    with pytest.raises(ValueError):
        Policy(vendor_weekday="someday")
    with pytest.raises(ValueError):
        Policy(service_level=1.0)


def test_expiry_uses_default_shelf_life():
    policy = Policy(shelf_life={"dough": 7})
    assert policy.expiry_days("apples") == 3 and policy.expiry_days("dough") == 5


@pytest.mark.parametrize("day, flag", [
    ("2024-11-28", "is_thanksgiving"), ("2025-11-27", "is_thanksgiving"), ("2026-11-26", "is_thanksgiving"),
    ("2025-12-25", "is_xmas"), ("2025-07-04", "is_july4"), ("2025-03-14", "is_piday"), ("2025-11-20", None),
])
def test_calendar_flags(spark, day, flag):
    row = spark.range(1).select(*[
        c.alias(n) for n, c in calendar_features(F.lit(day).cast("date")).items()
    ]).first().asDict()
    assert row["dow"] == dt.date.fromisoformat(day).weekday()
    flags = {k for k, v in row.items() if k not in ("dow", "month", "is_weekend") and v}
    assert flags == ({flag} if flag else set())


def test_iso_year_boundary(spark):
    days = spark.createDataFrame([(dt.date(2025, 12, 29),), (dt.date(2026, 12, 31),)], "d date")
    assert rows_of(days.select(iso_year(F.col("d")), iso_week(F.col("d"))), 1) == [(2026, 1), (2026, 53)]


def test_rounding_is_half_to_even(spark):
    found = spark.createDataFrame([(2.5,), (3.5,), (-0.4,), (-3.0,)], "x double").select(whole(F.col("x")))
    assert [r[0] for r in found.collect()] == [2, 4, 0, -3]
    texts = spark.createDataFrame([(2.25,), (0.25,), (0.75,), (12345678.9,), (-0.05,)], "x double").select(messages.one_place(F.col("x")).cast("string"))
    assert [r[0] for r in texts.collect()] == ["2.2", "0.2", "0.8", "12345678.9", "0.0"]


def test_lots_and_safety(spark):
    rows = spark.createDataFrame(
        [(1, 601.0, 300), (2, 600.0, 300), (3, 4.2, 0), (4, 4.2, None)], "id int, q double, lot int"
    )
    assert [r[1] for r in rows_of(rows.select("id", round_up_lot(F.col("q"), F.col("lot"))), "id")] == [900, 600, 5, 5]
    low = spark.range(1).select(safety_stock(F.lit(4.0), 4, -1.0), safety_stock(F.lit(4.0), 4, 1.5)).first()
    assert tuple(low) == (0.0, 12.0)


def test_weekday_list_column(spark):
    row = spark.range(1).select(weekday_list(F.array(*map(F.lit, ["Sun", "x", "monday", "9", "3"]))))
    assert row.first()[0] == [0, 3, 6]


def test_service_level_column(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.95), (3, None)], "id int, sl double")
    found = rows_of(z_scores(rows, "sl").select("id", "z"), "id")
    assert found[0] == (1, 0.0) and abs(found[1][1] - 1.6448536269514722) < 1e-12 and found[2][1] is None
    levels = [k / 4000 for k in range(1, 4000)] + [1e-12, 1e-30, 1 - 1e-12]
    many = spark.createDataFrame([(v,) for v in levels], "sl double")
    assert all(math.isclose(z, NormalDist().inv_cdf(v), rel_tol=1e-13, abs_tol=1e-15) for v, z in z_scores(many, "sl").collect())


def test_summary_needs_all_three(spark):
    rows = spark.createDataFrame([(1, 7.12, 4.9, 9.8), (2, 7.0, None, 9.8)], "id int, m double, l double, u double")
    text = messages.prediction_summary(F.col("m"), F.col("l"), F.col("u"))
    joined = messages.with_summary(F.lit("note"), text)
    assert rows_of(rows.select("id", text, joined), "id") == [
        (1, "Pred 7.1 (4.9–9.8)", "note — Pred 7.1 (4.9–9.8)"), (2, None, "note"),
    ]


def test_seeded_ideas():
    policy = Policy()
    first = seeded_ideas("apples", policy)
    assert first == seeded_ideas("apples", policy) and len(set(first)) == 5
    assert set(first) <= set(policy.menu["apples"])
    assert set(seeded_ideas("cinnamon", policy)) <= set(policy.menu["_default"])
    assert seeded_ideas("apples", policy.with_(suggestion_count=9)) == list(policy.menu["apples"])


def test_hashed_ideas(spark):
    policy = Policy(menu={"a": ["two", "one"], "_default": [f"d{i}" for i in range(8)]}, suggestion_count=3)
    asked = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "ingredient string, seed int")
    found = {(i, s): t.split(", ") for i, s, t in hashed_ideas(asked, policy).collect()}
    assert found["a", 1] == ["two", "one"]
    assert len(set(found["b", 1])) == 3 and set(found["b", 1]) <= set(policy.menu["_default"])
    assert found == {(i, s): t.split(", ") for i, s, t in hashed_ideas(asked, policy).collect()}


def test_random_ideas_differ_within_a_row(spark):
    asked = spark.createDataFrame([("apples",), ("salt",)], "ingredient string")
    for row in random_ideas(asked, Policy()).collect():
        pool = Policy().menu.get(row["ingredient"], Policy().menu["_default"])
        assert len(set(row["items"])) == 5 and set(row["items"]) <= set(pool)


def test_policy_tables(spark):
    recipe = spark.createDataFrame([(1, "dough", 1), (1, "apples", 3), (2, "dough", 2)], "series int, ingredient string, per_item int")
    lots = spark.createDataFrame([(1, "dough", 60)], "series int, ingredient string, lot_size int")
    shelf = spark.createDataFrame([("dough", 9)], "ingredient string, days int")
    lines = recipe_lines(recipe, lots, shelf)
    assert rows_of(lines, "series", "ingredient") == [(1, "apples", 3.0, 0, 3), (1, "dough", 1.0, 60, 6), (2, "dough", 2.0, 0, 6)]
    plan = spark.createDataFrame([(1, dt.date(2024, 1, 1), 7), (2, dt.date(2024, 1, 1), 5), (3, dt.date(2024, 1, 1), 1)], "series int, date date, qty_total bigint")
    need = need_by_table(plan, lines).select("series", "ingredient", "need", "lots_needed")
    assert rows_of(need, "series", "ingredient") == [(1, "apples", 21.0, 21), (1, "dough", 7.0, 60), (2, "dough", 10.0, 10)]


def test_settings_tables_have_no_limit(spark):
    menu = spark.range(20000).selectExpr("if(id % 2 = 0, 'x', '_default') ingredient", "concat('i', id) item")
    asked = spark.createDataFrame([("x", 1), ("y", 1)], "ingredient string, seed int")
    found = dict((r[0], r[2].split(", ")) for r in ideas_by_table(asked, menu).collect())
    assert len(found["x"]) == len(found["y"]) == 5
    assert all(int(i[1:]) % 2 == 0 for i in found["x"]) and all(int(i[1:]) % 2 == 1 for i in found["y"])


def test_settled_tables_leave_no_exchange(spark):
    def exchanged():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "/shuffle_" in f}

    before, setting = exchanged(), spark.conf.get(CLEANUP, None)
    table = settle(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "exchanges")
    for _ in range(50):  # removed in the background
        if exchanged() <= before:
            break
        time.sleep(0.1)
    assert exchanged() <= before and spark.conf.get(CLEANUP, None) == setting
    assert rows_of(table, "k") == [(k, 15 if k < 2 else 14) for k in range(7)]
