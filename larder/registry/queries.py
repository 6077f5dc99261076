"""One query per operator. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import calendar, quantities
from larder.operators import (
    accuracy,
    advisories,
    exports,
    features,
    forecast,
    ledger,
    menu,
    people,
    pooled,
    ridge,
    scheduler,
    serving,
    settings,
    spine,
    stock,
    weekly,
)
from larder.plans import season
from larder.registry import inputs
from larder.registry.inputs import CUT_DAYS, LAST_TRAIN_DAY, POLICY
from larder.session import shared_folder
from larder.sources import policy, published, sales
from larder.streaming import sales as sales_stream
from larder.streaming import signups as signup_stream
from larder.tables import FEATURES, Policy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def r6(column: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name or column)


POOLED_DAYS = 14
ROWS_PER_DATED_FILE = 500_000
DATE_STYLES = ("yyyy-MM-dd", "dd/MM/yyyy", "M/d/yyyy", "d MMM yyyy", "dd.MM.yyyy")

# Coefficients with short decimals, for forecasts that must not depend on a fit.
PINNED_INTERCEPT = 1.25
PINNED_COEF = (0.31, -0.07, 0.83, 2.0, 1.5, -0.5, 3.0, 0.11, 0.17, 0.23, 0.29)


def pinned_model(history: DataFrame) -> DataFrame:
    return history.select("series").distinct().select(
        "series",
        F.lit(PINNED_INTERCEPT).alias("intercept"),
        F.array(*[F.lit(c) for c in PINNED_COEF]).alias("coef"),
        F.lit(-3.5).alias("q_lo"),
        F.lit(4.5).alias("q_hi"),
    )


# --- sales input -------------------------------------------------------------------------


@query
def daily_sales(spark, sf):
    return inputs.history(spark, sf)


@query
def ingest_validate(spark, sf):
    """Typed against quarantined rows and the quantity that is kept, per series."""
    li = inputs.table(spark, sf, "lineitem")
    day = F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM-dd")
    raw = li.select(
        F.col("l_suppkey").alias("series"),
        F.when(F.col("l_orderkey") % 97 == 0, "not a day").otherwise(day).alias("date"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("qty_sold"),
    )
    checked = sales.validate(raw)
    return checked.groupBy("series").agg(
        F.count_if(F.col("error").isNull()).alias("good"),
        F.count_if(F.col("error") == "bad date").alias("bad_date"),
        F.count_if(F.col("error") == "bad qty_sold").alias("bad_qty"),
        F.sum(F.when(F.col("error").isNull(), F.col("qty_sold"))).alias("kept_qty"),
    )


@query
def csv_payload(spark, sf):
    """Each series' sales written as CSV text, in either column order, and read back."""
    daily = inputs.daily_sales(spark, sf)
    day, qty = F.date_format("date", "yyyy-MM-dd"), F.col("qty_sold").cast("string")
    swapped = F.col("series") % 2 == 1
    line = F.when(swapped, F.concat_ws(",", qty, day)).otherwise(F.concat_ws(",", day, qty))
    texts = daily.groupBy("series").agg(F.collect_list(line).alias("_lines"))
    header = F.when(swapped, "qty_sold,date").otherwise("date,qty_sold")
    payloads = texts.select(
        "series", F.concat(header, F.lit("\n"), F.array_join("_lines", "\n")).alias("csv_content")
    )
    rows = sales.good_rows(sales.validate(sales.payload_rows(payloads)))
    return rows.select("series", "date", "qty_sold")


@query
def mixed_csv(spark, sf):
    """The sales as CSV files of two layouts in one folder, read back by each file's own header."""
    daily = inputs.daily_sales(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    folder = shared_folder(spark, "layouts")
    odd = F.col("series") % 2 == 1
    note = F.concat(F.lit('no. "'), F.col("series").cast("string"), F.lit('", sold'))
    daily.where(odd).select("qty_sold", note.alias("note"), "date", "series").write.option(
        "header", True).option("escape", '"').csv(f"{folder}/odd")
    daily.where(~odd).select("series", "date", "qty_sold").write.option("header", True).csv(f"{folder}/even")
    rows = sales.read_csv(spark, f"{folder}/odd", f"{folder}/even")
    return sales.good_rows(sales.validate(rows)).select(F.col("series").cast("bigint").alias("series"), "date", "qty_sold", "note")


@query
def quoted_csv(spark, sf):
    """Sales in files that open with blank lines and have line breaks in quotes."""
    daily = inputs.daily_sales(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    folder = shared_folder(spark, "quoted")
    note = F.concat(F.lit('"first '), F.col("series").cast("string"), F.lit('\nsecond ""line"",\n\nlast"'))
    line = F.concat_ws(",", F.col("date"), F.when(F.dayofmonth("date") % 3 == 0, note).otherwise("plain"), "qty_sold", "series")
    texts = daily.groupBy("series").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its task, which writes one file
    opening = F.when(first, "\n\n  \ndate,note,qty_sold,series\n").otherwise("")
    texts.select(F.concat(opening, "body").alias("value")).write.text(folder)
    rows = sales.good_rows(sales.validate(sales.read_csv(spark, folder, glob="*.txt")))
    return rows.select(F.col("series").cast("bigint").alias("series"), "date", "qty_sold", "note")


@query
def dated_csv(spark, sf):
    """The sales in files of different date styles, each read by what its rows say.

    A file holds about half a million rows, so that there are as many as the table needs and each still tells its style.
    """
    folder = shared_folder(spark, "dated")
    files = ceil(inputs.table(spark, sf, "lineitem").count() / len(DATE_STYLES) / ROWS_PER_DATED_FILE)
    style = F.col("series") % len(DATE_STYLES)
    daily = inputs.daily_sales(spark, sf).withColumn("style", style)
    told = daily.where((F.col("style") < 4) | (F.dayofmonth("date") <= 12))  # in the last style nothing tells day from month
    written = F.coalesce(*[F.when(F.col("style") == i, F.date_format("date", pattern)) for i, pattern in enumerate(DATE_STYLES)])
    dealt = told.withColumn("date", written).repartition(
        len(DATE_STYLES) * files, "style", F.pmod(F.xxhash64("series"), F.lit(files)))
    dealt.write.partitionBy("style").option("header", True).csv(folder)
    rows = sales.validate(sales.read_csv(spark, folder, file="path"), by="path")
    return rows.select(F.col("series").cast("bigint").alias("series"), "date", "qty_sold", "error")


@query
def table_profile(spark, sf):
    return sales.profile(inputs.daily_sales(spark, sf), "series")


@query
def sample_rows(spark, sf):
    return sales.first_rows(inputs.daily_sales(spark, sf), 5, "date", "series")


@query
def sales_upsert(spark, sf):
    """Publish the whole history, then replace the even series by twice theirs."""
    daily = inputs.daily_sales(spark, sf)
    path = shared_folder(spark, "sales")
    published.upsert_series(daily, path, published.BASE_ID, buckets=16)
    twice = daily.where(F.col("series") % 2 == 0).withColumn("qty_sold", F.col("qty_sold") * 2)
    published.upsert_series(twice, path, "1")
    return published.read_series(spark, path).groupBy("series").agg(
        F.count("*").alias("days"), F.sum("qty_sold").alias("qty_sold"), F.max("date").alias("last_day")
    )


@query
def latest_snapshot(spark, sf):
    """Two published plans; readers see the newer one."""
    plan = inputs.bare_plan(spark, sf)
    path = shared_folder(spark, "plan")
    published.publish(plan.withColumn("qty_total", F.lit(0).cast("bigint")), path, "2024-01-01")
    published.publish(plan, path, "2024-01-02")
    return published.read_latest(spark, path).groupBy("series").agg(
        F.count("*").alias("days"), F.sum("qty_total").alias("qty_total")
    )


# --- calendar and features -----------------------------------------------------------------


@query
def calendar_features(spark, sf):
    return features.with_calendar(inputs.history(spark, sf).select("series", "date"))


@query
def iso_weeks(spark, sf):
    date = F.col("date")
    return inputs.history(spark, sf).select(
        "series", "date",
        calendar.iso_year(date).cast("int").alias("iso_year"), calendar.iso_week(date).alias("iso_week"),
    )


def _rounded_features(rows: DataFrame) -> DataFrame:
    return rows.select("series", "date", "qty_sold", "lag_1", "lag_7", r6("roll7"), r6("roll28"))


@query
def lag_roll(spark, sf):
    return _rounded_features(features.with_past_demand(inputs.history(spark, sf)))


@query
def lag_roll_strict(spark, sf):
    return _rounded_features(features.with_past_demand(inputs.history(spark, sf), full_only=True))


@query
def training_frame(spark, sf):
    rows = features.training_rows(features.with_features(inputs.history(spark, sf)))
    return rows.select("series", "date", "qty_sold", *[r6(F.col(f).cast("double"), f) for f in FEATURES])


@query
def train_test_split(spark, sf):
    train, test = features.split_features(inputs.history(spark, sf), LAST_TRAIN_DAY)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("series", "date", "part", "qty_sold", "lag_1", "lag_7", r6("roll7"), r6("roll28"))


@query
def history_union(spark, sf):
    """History with the flat forecast appended; forecast rows have no lag."""
    past = inputs.history(spark, sf)
    ahead = forecast.flat_forecast(past, POLICY).select("series", "date", F.col("qty_sold").cast("double"))
    lagged = past.withColumn("lag_1", F.lag("qty_sold").over(spine.by_day()))
    return spine.append_forecast(lagged, ahead)


# --- models --------------------------------------------------------------------------------


def _training(spark, sf) -> DataFrame:
    return features.training_rows(features.with_features(inputs.history(spark, sf)))


def _strict_training(spark, sf) -> DataFrame:
    train, _ = features.split_features(inputs.history(spark, sf), LAST_TRAIN_DAY)
    return features.training_rows(train)


def _flat_model(model: DataFrame, *keep: str) -> DataFrame:
    coefs = [r6(F.col("coef")[i], f"c_{name}") for i, name in enumerate(FEATURES)]
    return model.select("series", *keep, r6("intercept"), *coefs)


@query
def feature_moments(spark, sf):
    """Plain first and second moments, as the fit sees them before the shift."""
    rows = ridge.moments(_training(spark, sf))
    at = {name: i for i, name in enumerate(FEATURES)}
    pair = {p: len(FEATURES) + i for i, p in enumerate(ridge.PAIRS)}
    n, sums = F.col("n"), F.col("sums")

    def cov(a, b):
        i, j = sorted((at[a], at[b]))
        return sums[pair[i, j]] / n - (sums[at[a]] / n) * (sums[at[b]] / n)

    return rows.select(
        "series", "n", r6("level"),
        r6(sums[at["dow"]] / n, "mean_dow"), r6(sums[at["roll7"]] / n + F.col("level"), "mean_roll7"),
        r6(cov("lag_1", "lag_1"), "var_lag_1"), r6(cov("lag_1", "roll28"), "cov_lag_1_roll28"),
        r6(cov("dow", "is_weekend"), "cov_dow_weekend"),
    )


@query
def ridge_by_series(spark, sf):
    return _flat_model(ridge.fit_by_series(_training(spark, sf)), "n_train")


@query
def ridge_pooled(spark, sf):
    training = _training(spark, sf)
    weights = ridge.pooled_coefficients(training, ridge.fit_pooled(training))
    return weights.select("feature", r6("weight"))


@query
def cv_folds(spark, sf):
    blocks = ridge.with_validation_block(_strict_training(spark, sf))
    return blocks.groupBy("series", "block").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


@query
def alpha_search(spark, sf):
    scores = ridge.validation_scores(_strict_training(spark, sf))
    return scores.select("series", "alpha", r6("mean_mae"))


@query
def best_alpha_model(spark, sf):
    return _flat_model(ridge.fit_best_alpha(_strict_training(spark, sf)), "alpha")


@query
def holdout_metrics(spark, sf):
    scored = accuracy.holdout_metrics(inputs.history(spark, sf), LAST_TRAIN_DAY)
    # a zero actual weighs its error by the inverse of the smallest target: keep ten digits
    return scored.select("series", "alpha", "rows", r6("mae"), F.format_string("%.8e", "mape").alias("mape"))


@query
def rolling_backtest(spark, sf):
    """A fit up to the end of every month of a year, each scored on the 28 days that follow."""
    scored = accuracy.rolling_backtest(inputs.history(spark, sf), CUT_DAYS)
    return scored.select("series", "cut", "n_train", "rows", r6("mae"), F.format_string("%.8e", "mape").alias("mape"))


@query
def residual_interval(spark, sf):
    """Residual offsets of a seasonal-naive forecast."""
    rows = inputs.history(spark, sf)
    resid = F.col("qty_sold") - F.lag("qty_sold", 7).over(spine.by_day())
    known = rows.withColumn("resid", resid).where(F.col("resid").isNotNull())
    return ridge.residual_quantiles(known).select("series", r6("q_lo"), r6("q_hi"))


@query
def residual_bootstrap(spark, sf):
    rows = inputs.history(spark, sf)
    resid = F.col("qty_sold") - F.lag("qty_sold", 7).over(spine.by_day())
    known = rows.withColumn("resid", resid).where(F.col("resid").isNotNull())
    return ridge.bootstrap_quantiles(known).select("series", r6("q_lo"), r6("q_hi"))


# --- forecasts -----------------------------------------------------------------------------


@query
def forecast_spine(spark, sf):
    return spine.forecast_days(inputs.history(spark, sf), POLICY.with_(horizon_days=90, forecast_year=2001))


def _rounded_forecast(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "series", "date", "qty_sold", r6("pred_mean"), r6("pred_lower"), r6("pred_upper"), *more
    )


@query
def recursive_forecast(spark, sf):
    past = inputs.history(spark, sf)
    return _rounded_forecast(forecast.recursive_forecast(past, pinned_model(past), POLICY))


@query
def forecast_end_to_end(spark, sf):
    return _rounded_forecast(forecast.forecast_demand(inputs.history(spark, sf), POLICY), "forecast_method")


@query
def pooled_forecast(spark, sf):
    """One ridge over all series, without an interval, over a horizon given by a configuration."""
    past = inputs.history(spark, sf)
    config = {"forecast": {"forecast_horizon_days": POOLED_DAYS}}
    model = pooled.fit_portable(features.training_rows(features.with_features(past)))
    return _rounded_forecast(pooled.forecast_pooled(past, model, Policy.from_config(config)), "forecast_method")


@query
def boosted_forecast(spark, sf):
    """Boosted trees over all series, with the quantiles of their residuals."""
    past = inputs.history(spark, sf)
    boosting = GBTRegressor(maxIter=10, maxDepth=4, seed=7)
    model = pooled.fit_portable(
        features.training_rows(features.with_features(past)), boosting, interval_alpha=POLICY.interval_alpha)
    return _rounded_forecast(pooled.forecast_pooled(past, model, POLICY), "forecast_method")


@query
def flat_forecast(spark, sf):
    return forecast.flat_forecast(inputs.history(spark, sf), POLICY)


@query
def wave_forecast(spark, sf):
    return forecast.wave_forecast(inputs.history(spark, sf), POLICY)


@query
def recipe_need(spark, sf):
    return forecast.recipe_need(inputs.plan(spark, sf), POLICY)


@query
def recipe_table_need(spark, sf):
    """Needs by recipe and lot tables that differ from series to series."""
    s = F.col("s_suppkey")
    suppliers = inputs.table(spark, sf, "supplier").select(s.alias("series"), F.posexplode(
        F.array(F.lit("apples"), F.lit("dough"), F.lit("cinnamon"))).alias("k", "ingredient"))
    recipe = suppliers.where((F.col("series") + F.col("k")) % 4 != 3).withColumn("per_item", 1 + (F.col("series") + F.col("k")) % 3)
    lots = suppliers.where(F.col("k") != 2).withColumn("lot_size", 10 * (1 + F.col("series") % 5))
    lines = policy.recipe_lines(recipe, lots)
    return policy.need_by_table(inputs.plan(spark, sf), lines)


@query
def menu_table(spark, sf):
    """The same ideas as `menu_seeded`, from a menu kept as a table."""
    items = [(i, item) for i, pool in POLICY.menu.items() for item in pool]
    return policy.ideas_by_table(_asked(spark, sf), spark.createDataFrame(items, "ingredient string, item string"))


# --- stock and policy ------------------------------------------------------------------------


@query
def restock_flags(spark, sf):
    return stock.restock_flags(inputs.stock(spark, sf)).select(
        "series", "date", "ingredient", "start", "end", "restocked"
    )


@query
def last_stock(spark, sf):
    return stock.last_stock(inputs.stock(spark, sf))


@query
def rolling_std_proxy(spark, sf):
    proxy = scheduler.std_proxy(F.col("qty_total").cast("double"))
    return inputs.plan(spark, sf).select("series", "date", r6(proxy, "std_proxy"))


@query
def safety_rop(spark, sf):
    """Safety stock and reorder point per ingredient, every day of the plan."""
    rows = scheduler.demand_statistics(inputs.bare_plan(spark, sf), POLICY)
    lines = quantities.with_recipe(rows, POLICY, "ingredient", "per_item", "lot_size", "start_stock")
    safety, rop, target = scheduler.reorder_levels(POLICY.lead_time_days, POLICY.z, F.col("per_item"))
    return lines.select(
        "series", "date", "ingredient", "lot_size", "start_stock",
        r6(safety, "safety"), r6(rop, "reorder_point"), r6(target, "target_cover"),
    )


@query
def service_levels(spark, sf):
    """Normal deviates for a service level held in a column."""
    rows = inputs.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("series"), (F.lit(0.5) + (F.col("s_suppkey") % 50) / 100).alias("service_level")
    )
    return quantities.z_scores(rows, "service_level").select("series", r6("service_level"), r6("z"))


@query
def round_up_lot(spark, sf):
    rows = quantities.with_recipe(inputs.plan(spark, sf), POLICY, "ingredient", "per_item", "lot_size")
    qty = F.col("qty_total") * F.col("per_item") * 1.5
    lot = F.when(F.weekday("date") == 6, F.lit(None)).when(F.weekday("date") == 5, 0).otherwise(F.col("lot_size"))
    return rows.select("series", "date", "ingredient", quantities.round_up_lot(qty, lot).alias("order_qty"))


@query
def lead_demand(spark, sf):
    lead = scheduler.summed(F.col("qty_total"), 0, POLICY.lead_time_days - 1)
    return inputs.plan(spark, sf).select("series", "date", lead.alias("lead_demand"))


@query
def future_need(spark, sf):
    rows = scheduler.demand_statistics(inputs.bare_plan(spark, sf), POLICY)
    return rows.select("series", "date", F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("ingredient"),
            quantities.whole(F.col(f"future_{POLICY.expiry_days(i)}") * F.lit(float(per))).alias("future_need"),
        )
        for i, per in POLICY.recipe.items()
    ])))


OPENING = 5000.0


@query
def clamped_running_stock(spark, sf):
    need = forecast.recipe_need(inputs.plan(spark, sf), POLICY).withColumn("opening", F.lit(OPENING))
    rows = stock.clamped_running_stock(need, "opening")
    return rows.select("series", "date", "ingredient", "need", "stock")


@query
def surplus_rank(spark, sf):
    lines = scheduler.surplus_lines(inputs.bare_plan(spark, sf), POLICY).withColumn("opening", F.lit(OPENING))
    ranked = scheduler.rank_surplus(stock.clamped_running_stock(lines, "opening"))
    return ranked.select(
        "series", "date", "ingredient", "stock", "future_need", r6("safety"), r6("surplus"), "rank"
    )


@query
def weekday_normalise(spark, sf):
    """Weekday lists in mixed spelling, one per order."""
    o = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("Mon", "thursday", " 6", "7", "xyz", "SUN", "2")])
    days = F.array(names[(o % 7).cast("int")], names[((o + 3) % 7).cast("int")], names[((o * 5) % 7).cast("int")])
    normal = quantities.weekday_list(days)
    return inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.array_join(normal.cast("array<string>"), ",").alias("days")
    )


# --- order-dependent planning ------------------------------------------------------------------


def _opening_stock(spark, sf) -> DataFrame:
    return stock.last_stock(inputs.stock(spark, sf))


@query
def daily_signals(spark, sf):
    return ledger.daily_signals(inputs.bare_plan(spark, sf), POLICY, _opening_stock(spark, sf))


@query
def week_totals(spark, sf):
    rows = weekly.week_totals(inputs.plan(spark, sf))
    return rows.select(
        "series", F.col("iso_year").cast("int").alias("iso_year"), "iso_week", r6("mean_qty"), "total_qty",
        "first_day", "last_day",
    )


@query
def special_fill(spark, sf):
    """Extra items spread over a week's special days: the week's Sunday total is the extra."""
    rows = weekly.with_week(inputs.bare_plan(spark, sf), POLICY)
    extra = F.col("week_qty") % 23
    fill = weekly.special_fill(extra, POLICY.special_boost_max_per_day, F.col("nth_special"))
    return rows.where(F.col("special_day") == 1).select(
        "series", "date", extra.alias("extra"), F.col("nth_special").cast("int").alias("nth_special"),
        fill.alias("added"),
    )


def _balanced(spark, sf) -> DataFrame:
    return weekly.weekly_balance(inputs.bare_plan(spark, sf), POLICY, _opening_stock(spark, sf))


@query
def weekly_balance_plan(spark, sf):
    return weekly.balance_plan(_balanced(spark, sf))


@query
def weekly_balance_advisories(spark, sf):
    rows = weekly.balance_advisories(_balanced(spark, sf), POLICY)
    return rows.select("series", "date", "type", "ingredient", "message", "week", "window_start", "window_end")


@query
def schedule_plan(spark, sf):
    days = scheduler.schedule(inputs.bare_plan(spark, sf), POLICY)
    return scheduler.scheduled_plan(days)


@query
def schedule_advisories(spark, sf):
    rows = scheduler.schedule_advisories(scheduler.schedule(inputs.plan(spark, sf), POLICY), POLICY)
    return rows.select(
        "series", "date", "type", "ingredient", "qty", "special_qty", "message", "suggestions", "reason",
        r6("pred_mean"), r6("pred_lower"), r6("pred_upper"), "pred_summary",
    )


def _own_settings(spark, sf) -> DataFrame:
    return settings.series_settings(*inputs.recipe_tables(spark, sf))


@query
def signals_by_table(spark, sf):
    """Daily signals where every series has its own recipe lines."""
    return ledger.daily_signals(inputs.bare_plan(spark, sf), POLICY, settings=_own_settings(spark, sf))


@query
def balance_by_table(spark, sf):
    """The weekly balance with own recipe lines, special days, caps and delivery days."""
    days = weekly.weekly_balance(inputs.bare_plan(spark, sf), POLICY, settings=_own_settings(spark, sf))
    bought = F.aggregate("buy", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return days.select("series", "date", "qty_sold", "special_added", "qty_total", bought.alias("lines_bought"), "pick")


@query
def schedule_by_table(spark, sf):
    """The scheduler with own recipe lines, lots, shelf lives, lead times, vendor and special days."""
    days = scheduler.schedule(inputs.bare_plan(spark, sf), POLICY, settings=_own_settings(spark, sf))
    listed = {name: F.array_join(F.col(name).cast("array<string>"), ",").alias(name) for name in ("orders", "extras")}
    return days.select("series", "date", "qty_sold", "special_added", "qty_total", "lead_demand", *listed.values())


# --- advisories ----------------------------------------------------------------------------------


def _signal_columns(spark, sf) -> DataFrame:
    """A wide plan whose signals follow from the quantity alone."""
    qty = F.col("qty_total")
    return inputs.bare_plan(spark, sf).select(
        "series", "date",
        F.when(qty > 35, 1).when(qty == 0, -1).otherwise(0).alias("signal_apples"),
        F.when(qty % 7 == 1, 1).when(qty % 5 == 2, -1).otherwise(0).alias("signal_dough"),
    )


@query
def unpivot_signals(spark, sf):
    return advisories.unpivot_signals(_signal_columns(spark, sf))


@query
def weekly_advisories(spark, sf):
    rows = advisories.weekly_advisories(advisories.unpivot_signals(_signal_columns(spark, sf)), POLICY)
    return rows.select("series", "date", "type", "ingredient", "message", "week", "window_start", "window_end")


@query
def advisory_predictions(spark, sf):
    """A note per series and day with that day's prediction attached."""
    plan = inputs.plan(spark, sf)
    notes = plan.select(
        "series", "date", F.concat(F.lit("order "), F.col("qty_total").cast("string")).alias("message")
    )
    rows = advisories.attach_predictions(notes, plan)
    return rows.select(
        "series", "date", "message", r6("pred_mean"), r6("pred_lower"), r6("pred_upper"), "pred_summary"
    )


@query
def fallback_advisories(spark, sf):
    past = inputs.history(spark, sf)
    rows = advisories.average_notice(past).unionByName(advisories.stand_in_advice(past, POLICY))
    rows = rows.unionByName(advisories.processed_notice(past, "2024-01-01"))
    return rows.select(
        "series", "date", "type", "ingredient", "qty", "special_qty", "message", "suggestions", "reason"
    )


def _asked(spark, sf) -> DataFrame:
    """Each supplier asks for ideas about one of three ingredients with its own seed."""
    s = F.col("s_suppkey")
    return inputs.table(spark, sf, "supplier").select(
        s.alias("seed"),
        F.when(s % 3 == 0, "apples").when(s % 3 == 1, "dough").otherwise("cinnamon").alias("ingredient"),
    )


@query
def menu_seeded(spark, sf):
    return menu.hashed_ideas(_asked(spark, sf), POLICY)


@query
def menu_random(spark, sf):
    picked = menu.random_ideas(_asked(spark, sf), POLICY)
    return picked.select("ingredient", "seed", F.size(F.array_distinct("items")).cast("bigint").alias("items"))


def _stored_plan(spark, sf) -> str:
    """The wide plan with its signals as CSV files."""
    path = f"{shared_folder(spark, 'stored')}/plan_2024.csv"
    _signal_columns(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd")).write.option("header", True).csv(path)
    return path


@query
def stored_plan(spark, sf):
    signals = advisories.unpivot_signals(season.read_plan(spark, _stored_plan(spark, sf)))
    return signals.withColumn("series", F.col("series").cast("bigint"))


@query
def stored_advisories(spark, sf):
    """Advisories derived from a stored plan, published and read back."""
    out = shared_folder(spark, "advice")
    season.run_advisories_from_plan(spark, _stored_plan(spark, sf), out, "r1", POLICY)
    return published.read_latest(spark, out).select(
        F.col("series").cast("bigint").alias("series"), "date", "type", "ingredient", "special_qty", "message", "week", "source")


@query
def ordered_advisories(spark, sf):
    """The weekly advice in the order its files have: the place of each row among its series' rows."""
    rows = season.in_order(advisories.weekly_advisories(advisories.unpivot_signals(_signal_columns(spark, sf)), POLICY).repartition("series"))
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("series").orderBy("at"))
    return placed.select("series", "date", "type", place.alias("place"))


@query
def sorted_advisories(spark, sf):
    """The weekly advice published in twelve files: the place of each row among its series' rows, file after file."""
    out = shared_folder(spark, "advice")
    advice = advisories.weekly_advisories(advisories.unpivot_signals(_signal_columns(spark, sf)), POLICY)
    published.publish(season.in_order(advice, files=12), out, "r1")
    rows = published.read_latest(spark, out).select(
        "series", "date", "type", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    place = F.row_number().over(Window.partitionBy("series").orderBy("file", "at"))
    return rows.select("series", "date", "type", place.alias("place"))


@query
def policy_config(spark, sf):
    """Needs by a policy read from a nested mapping."""
    config = {"production": {"recipe": {"flour": 2, "sugar": 5}}, "store": {"lead_time_days": 4}, "forecast": None}
    return forecast.recipe_need(inputs.plan(spark, sf), Policy.from_config(config))


# --- serving and exports -----------------------------------------------------------------------


def _boosted_plan(spark, sf) -> DataFrame:
    """A plan with some specials, without running the scheduler."""
    extra = F.when(F.weekday("date") >= 3, F.col("qty_total") % 6).otherwise(0)
    return inputs.plan(spark, sf).withColumn("special_added", extra).withColumn(
        "qty_total", F.col("qty_total") + F.col("special_added")
    )


@query
def forecast_summary(spark, sf):
    return serving.forecast_summary(_boosted_plan(spark, sf))


@query
def location_summary(spark, sf):
    """A known location and one without a plan."""
    plan = _boosted_plan(spark, sf)
    return serving.location_summary(plan, 3).unionByName(serving.location_summary(plan, -1))


@query
def next_points(spark, sf):
    points = serving.next_points(_boosted_plan(spark, sf))
    return points.select("series", F.array_join(F.col("points").cast("array<string>"), ",").alias("points"))


def _mixed_advisories(spark, sf) -> DataFrame:
    """Each series' weekly advice, and its average notice as a table of its own (a negative series)."""
    past = inputs.history(spark, sf)
    weekly_rows = advisories.weekly_advisories(advisories.unpivot_signals(_signal_columns(spark, sf)), POLICY)
    notices = advisories.average_notice(past).withColumn("series", -F.col("series"))
    return notices.unionByName(weekly_rows)


@query
def advisory_feed(spark, sf):
    return serving.advisory_feed(_mixed_advisories(spark, sf))


@query
def demo_test(spark, sf):
    return serving.demo_check(serving.advisory_feed(_mixed_advisories(spark, sf)))


@query
def plan_export(spark, sf):
    wide = forecast.with_need_columns(_boosted_plan(spark, sf), POLICY).withColumn(
        "dough_need", F.col("dough_need") / 2
    )
    out = exports.plan_export(wide.select("series", "date", "qty_total", "special_added", "apples_need", "dough_need"))
    return out.select("series", "date", "qty_total", "special_added", "apples_need", "dough_need")


@query
def plan_export_gaps(spark, sf):
    """Halves of the demand, in every second series with unknown days."""
    half = F.when((F.col("series") % 2 == 0) | (F.col("qty_total") % 7 != 0), F.col("qty_total") / 2)
    return exports.plan_export(inputs.plan(spark, sf).select("series", "date", "qty_total", half.alias("dough_need")))


@query
def advisory_export(spark, sf):
    """Untyped quantities as they come out of a CSV."""
    qty = F.col("qty_total")
    raw = inputs.plan(spark, sf).select(
        "series", "date",
        F.when(qty % 4 == 0, "").when(qty % 4 == 1, "many").otherwise(qty.cast("string")).alias("qty"),
        F.when(qty % 3 == 0, F.lit(None)).otherwise(F.concat(qty.cast("string"), F.lit(".0"))).alias("special_qty"),
        "pred_mean",
    )
    return exports.advisory_export(raw)


@query
def windowed_export(spark, sf):
    """The plan as CSV in folders named by each series' first and last day."""
    path = shared_folder(spark, "export")
    plan = inputs.bare_plan(spark, sf).select("series", "date", "qty_total")
    exports.write_export(exports.with_window(plan), path, "window_start", "window_end")
    rows = spark.read.option("header", True).csv(path)
    return rows.groupBy(F.col("window_start").cast("date").alias("window_start"), F.col("window_end").cast("date").alias("window_end")).agg(
        F.countDistinct("series").alias("series"), F.count("*").alias("rows"), F.sum(F.col("qty_total").cast("bigint")).alias("qty_total"))


@query
def plan_json(spark, sf):
    rows = exports.to_json_rows(inputs.bare_plan(spark, sf).withColumn(
        "gap", F.when(F.col("qty_sold") == 0, F.lit(float("nan"))).otherwise(F.col("qty_sold").cast("double"))
    ), "series", "date")
    return rows


@query
def backtest_join(spark, sf):
    """History against a prediction that exists from 2000 on."""
    past = inputs.history(spark, sf)
    naive = past.withColumn("pred", F.lag("qty_sold", 7).over(spine.by_day())).where(F.col("date") >= "2000-01-01")
    return accuracy.backtest(past, naive)


@query
def accuracy_report(spark, sf):
    past = inputs.history(spark, sf)
    train, test = features.split_by_date(
        past.withColumn("pred", F.avg("qty_sold").over(spine.by_day().rowsBetween(-7, -1))), LAST_TRAIN_DAY
    )
    scored = accuracy.accuracy(test, train, season=7)
    return scored.select(
        "series", "rows", r6("mae"), F.format_string("%.8e", "mape").alias("mape"), r6("smape"), r6("mase")
    )


# --- people --------------------------------------------------------------------------------------


@query
def signup_dedupe(spark, sf):
    """All signups against a register of about half the addresses."""
    rows = inputs.signups(spark, sf)
    first = people.first_signups(people.valid_signups(rows))
    registered = first.where(F.md5(F.col("email_lc").cast("binary")) < "8")
    return people.new_signups(rows, registered).select("email_lc", "email", "ts", "event_id")


@query
def signup_count(spark, sf):
    return people.first_signups(people.valid_signups(inputs.signups(spark, sf))).agg(F.count("*").alias("signups"))


@query
def contact_validate(spark, sf):
    return people.check_contacts(inputs.contacts(spark, sf)).select(
        "conv_id", "turn", "id", "name", "email", "message", "error"
    )


@query
def contacts_latest(spark, sf):
    rows = people.newest_first(people.accepted_contacts(inputs.contacts(spark, sf)))
    return rows.select("id", "ts", "name", "email", "message")


@query
def contacts_appended(spark, sf):
    """Accepted messages appended in two parts to a table, and read back."""
    path = shared_folder(spark, "contacts")
    accepted = people.accepted_contacts(inputs.contacts(spark, sf))
    for part in (0, 1):
        published.append_rows(accepted.where(F.pmod("turn", F.lit(2)) == part), path)
    return people.newest_first(spark.read.parquet(path)).select("id", "ts", "name", "email", "message")


# --- streams -------------------------------------------------------------------------------------


@query
def stream_ingest(spark, sf):
    """The sales as CSV drops, streamed into the published table a few files at a time."""
    daily = inputs.daily_sales(spark, sf)
    folder = shared_folder(spark, "drops")
    qty = F.when(F.dayofmonth("date") == 13, "n/a").otherwise(F.col("qty_sold").cast("string"))
    daily.select(
        F.col("series").cast("string").alias("series"), F.date_format("date", "yyyy-MM-dd").alias("date"),
        qty.alias("qty_sold"), F.lit("u1").alias("upload"),
    ).repartition(8, "series", "date").write.option("header", True).csv(f"{folder}/in")
    drops = sales_stream.read_drops(spark, f"{folder}/in", files_at_once=3)
    sales_stream.ingest(drops, f"{folder}/sales", f"{folder}/rejected", f"{folder}/state").awaitTermination()
    good = published.read_series(spark, f"{folder}/sales").groupBy("series").agg(
        F.count("*").alias("days"), F.sum("qty_sold").alias("qty_sold")
    )
    bad = spark.read.parquet(f"{folder}/rejected").groupBy("series").agg(F.count("*").alias("rejected"))
    return good.join(bad, "series", "left").select(
        F.col("series").cast("bigint").alias("series"), "days", "qty_sold",
        F.coalesce("rejected", F.lit(0)).alias("rejected"),
    )


@query
def stream_signups(spark, sf):
    folder = shared_folder(spark, "signups")
    inputs.signups(spark, sf).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    signup_stream.register(stream, f"{folder}/table", f"{folder}/state").awaitTermination()
    rows = spark.read.parquet(f"{folder}/table")
    return rows.groupBy("email_lc").agg(F.count("*").alias("rows"))


# --- whole runs ------------------------------------------------------------------------------------


@query
def season_run(spark, sf):
    """History to scheduled plan: the whole current run, 30 days ahead."""
    days = season.season_days(inputs.history(spark, sf), POLICY.with_(horizon_days=30))
    return scheduler.scheduled_plan(days).select(
        "series", "date", "qty_sold", "qty_total", "special_added", r6("pred_mean"), "forecast_method"
    )


@query
def weekly_run(spark, sf):
    """History to balanced plan: the whole older run, 30 days ahead."""
    days = season.weekly_days(
        inputs.history(spark, sf), POLICY.with_(horizon_days=30), LAST_TRAIN_DAY, inputs.stock(spark, sf)
    )
    return weekly.balance_plan(days)


@query
def entry_slice(spark, sf):
    """Daily totals, gap filling, lags, a flat forecast, needs and totals in one plan."""
    past = features.with_past_demand(inputs.history(spark, sf))
    ahead = forecast.as_plan(forecast.flat_forecast(past, POLICY.with_(horizon_days=30)))
    needs = forecast.recipe_need(ahead, POLICY).groupBy("series").agg(
        F.sum(F.when(F.col("ingredient") == "apples", F.col("need"))).alias("apples_need"),
        F.sum(F.when(F.col("ingredient") == "dough", F.col("need"))).alias("dough_need"),
    )
    return serving.forecast_summary(ahead).join(needs, "series")


