"""Order-dependent planning against plain loops on small random plans."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import advisories, exports, ledger, scheduler, serving, settings, stock, weekly
from larder.operators.forecast import as_plan, recipe_need, with_need_columns
from larder.plans.season import with_signal_columns
from larder.tables import Policy
from tests.conftest import rows_of

FIRST = dt.date(2025, 12, 17)
THREE = Policy(
    recipe={"flour": 2.5, "egg": 1, "salt": 0.4},
    lots={"flour": 40, "egg": 0},
    shelf_life={"flour": 8, "salt": 1},
    start_stock={"salt": 30},
    vendor_weekday="Tue",
    special_days=("Fri", "Sat", 2),
    lead_time_days=3,
    reorder_points={"flour": 60, "egg": 10},
    restock_amounts={"flour": 150, "egg": 55, "salt": 9},
)


def make_plan(spark, lengths, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(lengths):
        for i in range(n):
            q = int(rng.poisson(12)) if k % 3 else (7 if k % 2 else 0 if i % 9 else 30)
            rows.append((f"s{k}", FIRST + dt.timedelta(days=i), q))
    frame = spark.createDataFrame(rows, "series string, date date, qty_sold bigint")
    return as_plan(frame).persist()


@pytest.fixture(scope="module")
def plan(spark):
    return make_plan(spark, [60, 45, 33, 1, 2, 3, 80, 14])


def by_series(frame, value="qty_total"):
    found = {}
    for row in frame.orderBy("series", "date").collect():
        found.setdefault(row["series"], []).append((row["date"], row[value]))
    return found


def loop_schedule(days, policy):
    """The scheduling rules, one day after the other."""
    q = [v for _, v in days]
    z = statistics.NormalDist().inv_cdf(policy.service_level)
    lead = policy.lead_time_days
    have = {i: policy.start_stock.get(i, 0) for i in policy.recipe}
    totals, notes = list(q), []

    def cover(std, per):
        return max(0.0, z * std * per * lead ** 0.5)

    for i, (day, qty) in enumerate(days):
        past = q[max(0, i - 28):i]
        if day.weekday() == policy.vendor_weekday:
            mean = statistics.fmean(past) if past else statistics.fmean(q)
            std = statistics.stdev(past) if len(past) > 1 else q[0] / 4
            for name, per in policy.recipe.items():
                safety = cover(std, per)
                if have[name] < mean * per * lead + safety:
                    short = max(0, sum(q[i:i + lead]) * per + safety + per - have[name])
                    lot = policy.lots.get(name, 0)
                    order = math.ceil(short / lot) * lot if lot else math.ceil(short)
                    if order:
                        notes.append((day, f"BUY_{name.upper()}", order))
                        have[name] += order
        for name, per in policy.recipe.items():
            have[name] = max(0, have[name] - round(qty * per))
        if day.weekday() in policy.special_days:
            recent = q[max(0, i - 28):i + 1]
            std = statistics.stdev(recent) if len(recent) > 1 else q[0] / 4
            spare = {
                name: have[name] - round(sum(q[i + 1:i + 1 + policy.expiry_days(name)]) * per) - cover(std, per)
                for name, per in policy.recipe.items()
            }
            for name in sorted(spare, key=spare.get, reverse=True):
                per = policy.recipe[name]
                extra = min(policy.special_boost_max_per_day, spare[name] // per)
                if spare[name] > 0 and extra > 0 and have[name] - extra * per >= 0:
                    totals[i] += int(extra)
                    notes.append((day, f"SPECIAL_{name.upper()}", int(extra)))
                    for other, units in policy.recipe.items():
                        have[other] = max(0, have[other] - round(extra * units))
    return totals, sorted(notes)


@pytest.mark.parametrize("policy", [THREE, Policy(start_stock={"apples": 900, "dough": 700}), Policy(vendor_weekday=None)])
def test_schedule(plan, policy):
    days = scheduler.schedule(plan, policy).persist()
    totals = by_series(scheduler.scheduled_plan(days))
    notes = {}
    for r in scheduler.schedule_advisories(days, policy).collect():
        amount = r["qty"] if r["qty"] is not None else r["special_qty"]
        notes.setdefault(r["series"], []).append((r["date"], r["type"], amount))
    for name, rows in by_series(plan).items():
        wanted_totals, wanted_notes = loop_schedule(rows, policy)
        assert [v for _, v in totals[name]] == wanted_totals
        assert sorted(notes.get(name, [])) == wanted_notes


def test_schedule_texts_and_layout(spark, history):
    plan = make_plan(spark, [0, 20]).withColumns({p: F.lit(7.0) for p in scheduler.PREDICTIONS})
    rows = scheduler.schedule_advisories(scheduler.schedule(plan, Policy()), Policy())
    buy = rows.where("type = 'BUY_APPLES'").orderBy("date").first()
    assert buy["message"].startswith(f"{buy['date']}: BUY {buy['qty']} apples (stock 0 < ROP ")
    assert buy["message"].endswith("— Pred 7.0 (7.0–7.0)") and buy["reason"] == "below_ROP"
    assert rows.columns[:5] == ["series", "date", "type", "ingredient", "qty"]
    empty = scheduler.schedule_advisories(scheduler.schedule(plan.limit(0), Policy()), Policy())
    assert empty.count() == 0 and empty.columns == rows.columns


def loop_signals(rows, policy, opening):
    q = [v for _, v in rows]
    average = max(1, int(sum(q) / len(q)))
    found = {}
    for name, per in policy.recipe.items():
        have, safety, signals = opening.get(name, policy.start_stock.get(name, 0)), 2 * average * per, []
        for qty in q:
            have -= int(qty * per)
            if have < max(policy.reorder_points.get(name, 0), safety):
                signals.append(1)
                have += policy.restock_amounts.get(name, 0)
            else:
                signals.append(-1 if have > 1.5 * safety else 0)
        found[name] = signals
    return found


def loop_weeks(rows, policy, opening):
    have = {i: opening.get(i, policy.start_stock.get(i, 0)) for i in policy.recipe}
    added, notes, weeks = [0] * len(rows), [], {}
    for i, (day, _) in enumerate(rows):
        weeks.setdefault(day.isocalendar()[:2], []).append(i)
    for key in sorted(weeks):
        days = weeks[key]
        if policy.forecast_year and all(rows[i][0].year != policy.forecast_year for i in days):
            continue
        q = [rows[i][1] for i in days]
        average = max(1, int(sum(q) / len(q)))
        safety = {n: 2 * average * per for n, per in policy.recipe.items()}
        limit = {n: max(policy.reorder_points.get(n, 0), safety[n]) for n in policy.recipe}
        first, last = rows[days[0]][0], rows[days[-1]][0]
        for n, per in policy.recipe.items():
            if first.weekday() == policy.restock_weekday and have[n] - sum(q) * per < limit[n]:
                notes.append((first, f"BUY_{n.upper()}"))
                have[n] += policy.restock_amounts.get(n, 0)
        for n, per in policy.recipe.items():
            have[n] -= sum(q) * per
        if any(have[n] > 1.5 * safety[n] for n in policy.recipe):
            named = max(policy.recipe, key=lambda n: have[n] - safety[n])
            notes.append((last, f"SPECIAL_{named.upper()}"))
            extra = min(max(0, int((have[n] - limit[n]) // per)) for n, per in policy.recipe.items())
            for i in days:
                if rows[i][0].weekday() in policy.special_days:
                    now = min(policy.special_boost_max_per_day, extra)
                    added[i], extra = now, extra - now
                    for n, per in policy.recipe.items():
                        have[n] -= now * per
    return added, sorted(notes)


OPENING = {"s0": {"flour": 4000, "egg": 900, "salt": 300}, "s2": {"egg": 120}, "s6": {"flour": 900, "egg": 2000, "salt": 500}}


@pytest.fixture(scope="module")
def opening(spark):
    rows = [(s, i, q) for s, stocks in OPENING.items() for i, q in stocks.items()]
    return spark.createDataFrame(rows, "series string, ingredient string, qty bigint")


def test_daily_signals(plan, opening):
    signals = ledger.daily_signals(plan, THREE, opening).persist()
    found = {}
    for r in signals.orderBy("date").collect():
        found.setdefault((r["series"], r["ingredient"]), []).append(r["signal"])
    for name, rows in by_series(plan).items():
        for ingredient, wanted in loop_signals(rows, THREE, OPENING.get(name, {})).items():
            assert found[name, ingredient] == wanted
    wide = with_signal_columns(plan, signals, THREE)
    back = advisories.unpivot_signals(wide)
    assert rows_of(back, "series", "date", "ingredient") == rows_of(signals, "series", "date", "ingredient")


@pytest.mark.parametrize("year", [None, 2026])
def test_weekly_balance(plan, opening, year):
    policy = THREE.with_(forecast_year=year)
    days = weekly.weekly_balance(plan, policy, opening).persist()
    added = by_series(weekly.balance_plan(days), "special_added")
    notes = {}
    for r in weekly.balance_advisories(days, policy).collect():
        notes.setdefault(r["series"], []).append((r["date"], r["type"]))
    for name, rows in by_series(plan).items():
        wanted_added, wanted_notes = loop_weeks(rows, policy, OPENING.get(name, {}))
        assert [v for _, v in added[name]] == wanted_added
        assert sorted(notes.get(name, [])) == wanted_notes


def test_weekly_advisories_rules(spark):
    monday = dt.date(2026, 1, 5)
    weeks = {
        "short": [0, 0, 1, 0, 0, 0, 0], "tail": [0] * 6 + [-1], "twice": [-1, -1, 0, 0, 0, 0, 0], "calm": [-1] + [0] * 6,
    }
    rows = [(s, monday + dt.timedelta(days=i), "apples", v) for s, values in weeks.items() for i, v in enumerate(values)]
    signals = spark.createDataFrame(rows, "series string, date date, ingredient string, signal int")
    found = advisories.weekly_advisories(signals, Policy())
    sunday = monday + dt.timedelta(days=6)
    assert rows_of(found.select("series", "date", "type", "week"), "series") == [
        ("short", monday, "BUY_APPLES", 2), ("tail", sunday, "SPECIAL_APPLES", 2), ("twice", sunday, "SPECIAL_APPLES", 2),
    ]
    with pytest.raises(ValueError):
        advisories.unpivot_signals(signals)


def test_std_proxy(history):
    table = history({"s": (FIRST, [8, 8, 12]), "zero": (FIRST, [0, 0])})
    found = table.select("series", "date", scheduler.std_proxy(F.col("qty_sold")).alias("p"))
    values = [r[2] for r in rows_of(found, "series", "date")]
    assert values == pytest.approx([2.0, 2.0, statistics.stdev([8, 8, 12]), 0.0, 0.0])


def test_restock_flags(spark):
    wide = spark.createDataFrame(
        [("s", dt.date(2023, 1, 1), 9, 300.0, 273.0, 120.0, 111.0), ("s", dt.date(2023, 1, 2), 7, 300.0, 279.0, 111.0, 104.0)],
        "series string, date date, qty_sold int, apples_start double, apples_end double, dough_start double, dough_end double",
    )
    long = stock.to_long(wide, ["apples", "dough"])
    found = stock.restock_flags(long).select("ingredient", "date", "restocked")
    assert [r[2] for r in rows_of(found, "ingredient", "date")] == [0, 1, 0, 0]
    given = stock.to_long(wide.withColumn("restocked_apples", F.lit(1)), ["apples", "dough"])
    found = stock.restock_flags(given).select("ingredient", "date", "restocked")
    assert [r[2] for r in rows_of(found, "ingredient", "date")] == [1, 1, 0, 0]
    assert rows_of(stock.last_stock(long), "ingredient") == [("s", "apples", 279), ("s", "dough", 104)]


def test_needs_and_exports(plan):
    wide = with_need_columns(plan, THREE).where("series = 's1'")
    out = exports.plan_export(wide).orderBy("date").first()
    assert (out["flour_need"], out["egg_need"], out["salt_need"]) == tuple(
        int(out["qty_total"] * per) for per in THREE.recipe.values()
    )
    assert recipe_need(plan, THREE).count() == 3 * plan.count()
    raw = plan.limit(1).select("series", "date", F.lit("x").alias("qty"), F.lit(None).cast("string").alias("special_qty"))
    assert tuple(exports.advisory_export(raw).first())[2:] == (None, 0)
    record = exports.to_json_rows(plan.limit(1).select("date", F.lit(float("nan")).alias("x"))).first()[0]
    assert record == '{"date":"2025-12-17","x":null}'


def test_serving_views(plan, spark):
    summary = serving.forecast_summary(plan.drop("special_added")).where("series = 's1'").first()
    total = sum(v for _, v in by_series(plan)["s1"])
    assert summary["total_forecast"] == total and summary["waste_saved_lbs"] == pytest.approx(round(total * 0.1, 1))
    nothing = serving.location_summary(plan.limit(0), "x").first()
    assert tuple(nothing) == ("x", 0, 0.0, 0.0, 0.0)
    assert len(serving.next_points(plan).where("series = 's0'").first()["points"]) == 14

    rows = [("a", FIRST, "forecast", None), ("b", FIRST, "BUY_X", "Default output shown"), ("c", FIRST, "BUY_X", "m"), ("c", FIRST, "SPECIAL_X", "n")]
    table = advisories.advisory_table(spark.createDataFrame(rows, "series string, date date, type string, message string"))
    feed = {(r["series"], r["type"]): r["message"] for r in serving.advisory_feed(table).collect()}
    assert feed == {
        ("a", "forecast"): "Default output", ("b", "BUY_X"): "Default output: Default output shown",
        ("c", "BUY_X"): "m", ("c", "SPECIAL_X"): "n",
    }
    demo = {r["series"]: r["is_demo"] for r in serving.demo_check(table).collect()}
    assert demo == {"a": False, "b": True, "c": False}
    assert serving.demo_check(table.limit(0)).count() == 0


# --- settings kept as tables ---------------------------------------------------------------------

OWN_POLICIES = {
    "s0": THREE,
    "s1": Policy(recipe={"a": 1, "b": 2.5, "c": 0.5, "d": 3, "e": 2}, lots={"a": 7, "d": 12}, vendor_weekday=3, special_days=(0, 6),
                 special_boost_max_per_day=2, lead_time_days=1, restock_weekday=2, reorder_points={"b": 30}, restock_amounts={"a": 90, "c": 40, "d": 200}),
    "s2": Policy(recipe={"x": 4}, vendor_weekday=None, lead_time_days=0, surplus_factor=1.1, safety_days=1, restock_amounts={"x": 300}),
    "s6": Policy(recipe={"x": 0, "y": 1}, special_days=(), service_level=0.8, forecast_year=2026),
}


def own_settings(spark):
    lines, rules = [], []
    for name, p in OWN_POLICIES.items():
        for pos, (i, per) in enumerate(p.recipe.items()):
            lines.append((name, pos, i, float(per), p.lots.get(i), p.shelf_life.get(i), p.reorder_points.get(i, 0), p.restock_amounts.get(i, 0), p.start_stock.get(i, 0)))
        rules.append((name, -1 if p.vendor_weekday is None else p.vendor_weekday, list(p.special_days), p.special_boost_max_per_day, p.z,
                      p.lead_time_days, p.restock_weekday, p.forecast_year, p.safety_days, p.surplus_factor))
    return settings.series_settings(
        spark.createDataFrame(lines, "series string, pos int, ingredient string, per_item double, lot_size bigint, shelf_days int, "
                              "reorder_point bigint, restock_amount bigint, stock0 bigint"),
        spark.createDataFrame(rules, "series string, vendor_day_of_week int, specials_on array<int>, special_cap int, z double, lead_days int, "
                              "restock_day_of_week int, wanted_year int, safety_days int, surplus_factor double"))


RUNS = {
    "schedule": lambda plan, p, s: scheduler.schedule_advisories(scheduler.schedule(plan, p, settings=s), p).select("series", "date", "type", "qty", "special_qty", "message"),
    "scheduled": lambda plan, p, s: scheduler.scheduled_plan(scheduler.schedule(plan, p, settings=s)),
    "balance": lambda plan, p, s: weekly.balance_plan(weekly.weekly_balance(plan, p, settings=s)),
    "advice": lambda plan, p, s: weekly.balance_advisories(weekly.weekly_balance(plan, p, settings=s), p).select("series", "date", "type", "week"),
    "signals": lambda plan, p, s: ledger.daily_signals(plan, p, settings=s),
}


@pytest.mark.parametrize("run", RUNS)
def test_every_series_by_its_own_settings(spark, plan, run):
    found = sorted(map(tuple, RUNS[run](plan, Policy(), own_settings(spark)).collect()), key=str)
    wanted = []
    for name in [r.series for r in plan.select("series").distinct().collect()]:
        mine = OWN_POLICIES.get(name, Policy())
        wanted += RUNS[run](plan.where(F.col("series") == name), mine, None).collect()
    assert found == sorted(map(tuple, wanted), key=str)
    assert found


def test_settings_fill_in_what_tables_leave_out(spark, plan):
    lines = spark.createDataFrame([("s0", "egg", 2), ("s0", "flour", 1), ("zz", "egg", 1)], "series string, ingredient string, per_item int")
    opening = spark.createDataFrame([("s0", "egg", 9), ("s0", "egg", 11)], "series string, ingredient string, qty int")
    row = settings.series_settings(lines, start_stock=opening).where("series = 's0'").first()
    assert (row.ingredients, row.per_item, row.stock0, row.lot_size, row.shelf_days) == (["egg", "flour"], [2.0, 1.0], [11, 0], [0, 0], [3, 3])
    empty = settings.series_settings(lines.limit(0))
    same = scheduler.scheduled_plan(scheduler.schedule(plan, THREE, settings=empty))
    assert rows_of(same, "series", "date") == rows_of(scheduler.scheduled_plan(scheduler.schedule(plan, THREE)), "series", "date")
