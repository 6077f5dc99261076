"""SQL counterparts of the registered queries, over the same tables.

They state each result a second way: a calendar join where Spark stretches rows, recursive
steps where Spark folds arrays, elimination by row operations where numpy solves.
"""

from __future__ import annotations

from statistics import NormalDist

from larder.functions.messages import PLACEHOLDER_MARKERS, PLACEHOLDER_PREFIX
from larder.operators.menu import seeded_ideas
from larder.operators.people import CONTACT_ERRORS, EMAIL_PATTERN
from larder.registry.inputs import CUT_DAYS, LAST_TRAIN_DAY, POLICY
from larder.tables import ALPHA_GRID, CV_FOLDS, FEATURES

ORACLES: dict[str, str] = {}

Z = repr(NormalDist().inv_cdf(POLICY.service_level))
ROOT = repr(float(POLICY.lead_time_days) ** 0.5)
LEAD = POLICY.lead_time_days
IDEAS = {i: ", ".join(seeded_ideas(i, POLICY)) for i in POLICY.ingredients}
PER = {i: POLICY.recipe[i] for i in POLICY.ingredients}
EXPIRY = {i: POLICY.expiry_days(i) for i in POLICY.ingredients}

# --- shared inputs -------------------------------------------------------------------------

DAILY = """daily AS MATERIALIZED (
  SELECT l_suppkey AS series, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS qty_sold
  FROM lineitem GROUP BY 1, 2)"""

DENSE = DAILY + """,
days AS (
  SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM daily GROUP BY series),
dense AS MATERIALIZED (
  SELECT d.series, d.date, coalesce(s.qty_sold, 0.0) AS qty_sold
  FROM days d LEFT JOIN daily s ON s.series = d.series AND s.date = d.date)"""

BY_DAY = "(PARTITION BY series ORDER BY date)"


def over(first: int, last: int, keys: str = "series") -> str:
    def bound(k):
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"(PARTITION BY {keys} ORDER BY date ROWS BETWEEN {bound(first)} AND {bound(last)})"


def strict_mean(days: int) -> str:
    frame = over(-days, -1)
    return f"CASE WHEN count(*) OVER {frame} = {days} THEN avg(qty_sold) OVER {frame} END"


PLAN = DENSE + f""",
plan AS MATERIALIZED (
  SELECT series, date, CAST(qty_sold AS BIGINT) AS qty_sold, CAST(qty_sold AS BIGINT) AS qty_total,
         CAST(0 AS BIGINT) AS special_added, week AS pred_mean, week * 0.8 AS pred_lower, week * 1.2 AS pred_upper
  FROM (SELECT *, {strict_mean(7)} AS week FROM dense))"""

RECIPE = "recipe(pos, ingredient, per_item, lot_size, expiry_days, start_stock) AS (VALUES " + ", ".join(
    f"({k}, '{i}', {float(PER[i])}::DOUBLE, {POLICY.lots[i]}, {EXPIRY[i]}, {POLICY.start_stock.get(i, 0)})"
    for k, i in enumerate(POLICY.ingredients)
) + ")"

STOCK = DENSE + f""",
{RECIPE},
used AS (
  SELECT series, date, ingredient, lot_size, qty_sold * per_item AS need,
         sum(qty_sold * per_item) OVER (PARTITION BY series, ingredient ORDER BY date) AS used
  FROM dense CROSS JOIN recipe),
stock AS (
  SELECT series, date, ingredient, lot_size - used % lot_size + need AS "start",
         lot_size - used % lot_size AS "end"
  FROM used)"""

CALENDAR = """CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(month(date) AS INTEGER) AS month,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
  CAST(strftime(date, '%m-%d') = '12-25' AS INTEGER) AS is_xmas,
  CAST(strftime(date, '%m-%d') = '07-04' AS INTEGER) AS is_july4,
  CAST(strftime(date, '%m-%d') = '03-14' AS INTEGER) AS is_piday,
  CAST(date = CAST(date_trunc('year', date) + INTERVAL 10 MONTH
       + to_days(CAST((11 - isodow(date_trunc('year', date) + INTERVAL 10 MONTH)) % 7 + 21 AS INTEGER)) AS DATE)
       AS INTEGER) AS is_thanksgiving"""


def lags(strict: bool, source: str) -> str:
    roll = {n: strict_mean(n) if strict else f"avg(qty_sold) OVER {over(-n, -1)}" for n in (7, 28)}
    return f"""SELECT *, lag(qty_sold, 1) OVER {BY_DAY} AS lag_1, lag(qty_sold, 7) OVER {BY_DAY} AS lag_7,
  {roll[7]} AS roll7, {roll[28]} AS roll28 FROM {source}"""


FEATURED = f"features AS MATERIALIZED (SELECT *, {CALENDAR} FROM ({lags(False, 'dense')}))"
TRAINING = DENSE + ",\n" + FEATURED + """,
training AS MATERIALIZED (SELECT * FROM features WHERE lag_7 IS NOT NULL)"""

SPLIT = DENSE + f""",
early AS (SELECT *, min(date) OVER (PARTITION BY series) AS first_day
          FROM dense WHERE date <= DATE '{LAST_TRAIN_DAY}'),
late AS (SELECT * FROM dense WHERE date > DATE '{LAST_TRAIN_DAY}'),
train AS MATERIALIZED (SELECT * EXCLUDE (first_day), {CALENDAR} FROM ({lags(True, 'early')})
                       WHERE date >= first_day + 28),
test AS MATERIALIZED (SELECT *, {CALENDAR} FROM ({lags(True, 'late')})
                      WHERE lag_7 IS NOT NULL AND roll28 IS NOT NULL)"""

FOLDS = f"""
folds AS MATERIALIZED (
  SELECT *, CASE WHEN size > 0 THEN
      CASE WHEN idx < n - {CV_FOLDS} * size THEN 0 ELSE (idx - (n - {CV_FOLDS} * size)) // size + 1 END END AS block
  FROM (SELECT *, n // {CV_FOLDS + 1} AS size FROM (
    SELECT *, row_number() OVER {BY_DAY} - 1 AS idx, count(*) OVER (PARTITION BY series) AS n FROM train)))"""

ROUNDED_LAGS = """series, date, qty_sold, lag_1, lag_7, round(roll7, 6) AS roll7, round(roll28, 6) AS roll28"""

# --- sales input -----------------------------------------------------------------------------

ORACLES["daily_sales"] = f"WITH {DENSE} SELECT series, date, qty_sold FROM dense"

ORACLES["ingest_validate"] = """
WITH rows AS (
  SELECT l_suppkey AS series, l_quantity, l_orderkey % 97 = 0 AS no_day, l_linenumber = 7 AS no_qty FROM lineitem)
SELECT series, count(*) FILTER (NOT no_day AND NOT no_qty) AS good,
       count(*) FILTER (no_day) AS bad_date, count(*) FILTER (no_qty AND NOT no_day) AS bad_qty,
       sum(l_quantity) FILTER (NOT no_day AND NOT no_qty) AS kept_qty
FROM rows GROUP BY series"""

ORACLES["csv_payload"] = f"WITH {DAILY} SELECT series, date, qty_sold FROM daily"

ORACLES["mixed_csv"] = f"""WITH {DAILY}
SELECT series, date, qty_sold, CASE WHEN series % 2 = 1 THEN 'no. "' || series || '", sold' END AS note FROM daily"""

ORACLES["quoted_csv"] = f"""WITH {DAILY}
SELECT series, date, qty_sold, CASE WHEN day(date) % 3 = 0 THEN 'first ' || series || chr(10) || 'second "line",' || chr(10) || chr(10) || 'last'
                                    ELSE 'plain' END AS note FROM daily"""

ORACLES["dated_csv"] = f"""WITH {DAILY}
SELECT series, CASE WHEN series % 5 < 4 OR day(date) = month(date) THEN date END AS date, qty_sold,
       CASE WHEN series % 5 = 4 AND day(date) <> month(date) THEN 'ambiguous date' END AS error
FROM daily WHERE series % 5 < 4 OR day(date) <= 12"""

ORACLES["table_profile"] = f"""WITH {DAILY}
SELECT series, count(*) AS rows, min(date) AS first_day, max(date) AS last_day,
       'series,date,qty_sold' AS columns FROM daily GROUP BY series"""

ORACLES["sample_rows"] = f"WITH {DAILY} SELECT series, date, qty_sold FROM daily ORDER BY date, series LIMIT 5"

ORACLES["sales_upsert"] = f"""WITH {DAILY}
SELECT series, count(*) AS days, sum(CASE WHEN series % 2 = 0 THEN 2 * qty_sold ELSE qty_sold END) AS qty_sold,
       max(date) AS last_day FROM daily GROUP BY series"""

ORACLES["latest_snapshot"] = f"""WITH {DENSE}
SELECT series, count(*) AS days, CAST(sum(qty_sold) AS BIGINT) AS qty_total FROM dense GROUP BY series"""

# --- calendar and features -----------------------------------------------------------------------

ORACLES["calendar_features"] = f"WITH {DENSE} SELECT series, date, {CALENDAR} FROM dense"

ORACLES["iso_weeks"] = f"""WITH {DENSE}
SELECT series, date, CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(weekofyear(date) AS INTEGER) AS iso_week FROM dense"""

ORACLES["lag_roll"] = f"WITH {DENSE} SELECT {ROUNDED_LAGS} FROM ({lags(False, 'dense')})"
ORACLES["lag_roll_strict"] = f"WITH {DENSE} SELECT {ROUNDED_LAGS} FROM ({lags(True, 'dense')})"

ORACLES["training_frame"] = f"""WITH {TRAINING}
SELECT series, date, qty_sold, {', '.join(f'round(CAST({f} AS DOUBLE), 6) AS {f}' for f in FEATURES)} FROM training"""

ORACLES["train_test_split"] = f"""WITH {SPLIT}
SELECT 'train' AS part, {ROUNDED_LAGS} FROM train UNION ALL SELECT 'test', {ROUNDED_LAGS} FROM test"""

RECENT = """recent AS (
  SELECT series, max(date) AS last_day, avg(qty_sold) FILTER (age <= 7) AS mean7,
         avg(qty_sold) FILTER (age <= 14) AS mean14
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM dense) GROUP BY series)"""


def ahead(days: int) -> str:
    return f"""{RECENT},
ahead AS (SELECT series, mean7, mean14, CAST(i - 1 AS INTEGER) AS step, last_day + CAST(i AS INTEGER) AS date
          FROM recent, range(1, {days + 1}) r(i))"""


ORACLES["history_union"] = f"""WITH {DENSE}, {ahead(POLICY.horizon_days)}
SELECT series, date, qty_sold, lag(qty_sold) OVER {BY_DAY} AS lag_1 FROM dense
UNION ALL SELECT series, date, trunc(mean7), NULL FROM ahead"""

# --- models ------------------------------------------------------------------------------------------

P = len(FEATURES)


def systems(rows: str, keys: str) -> str:
    """One ridge system per key: means, scales, correlations times n, and their right-hand side."""
    moments = [f"avg({f}) AS m{i}, sqrt(var_pop({f})) AS d{i}" for i, f in enumerate(FEATURES)]
    moments += [f"covar_pop({f}, qty_sold) AS y{i}" for i, f in enumerate(FEATURES)]
    moments += [
        f"covar_pop({FEATURES[i]}, {FEATURES[j]}) AS c{i}_{j}" for i in range(P) for j in range(i, P)
    ]
    scaled = [f"CASE WHEN d{i} < 1e-9 THEN 1.0 ELSE d{i} END AS s{i}" for i in range(P)]

    def cell(i, j):
        a, b = min(i, j), max(i, j)
        ridge = " + alpha" if i == j else ""
        return f"CASE WHEN d{i} < 1e-9 OR d{j} < 1e-9 THEN 0.0 ELSE n * c{a}_{b} / (s{i} * s{j}) END{ridge}"

    matrix = ", ".join(
        "[" + ", ".join([cell(i, j) for j in range(P)] + [f"n * y{i} / s{i}"]) + "]" for i in range(P)
    )
    return f"""moments AS MATERIALIZED (
  SELECT {keys}, count(*) AS n, avg(qty_sold) AS my, {', '.join(moments)} FROM {rows} GROUP BY {keys}),
system AS MATERIALIZED (
  SELECT {keys}, alpha, n, my, [{', '.join(f's{i}' for i in range(P))}] AS s,
         [{', '.join(f'm{i}' for i in range(P))}] AS m, [{matrix}] AS a
  FROM (SELECT *, {', '.join(scaled)} FROM moments), alphas),
elimination AS (
  SELECT {keys}, alpha, 0 AS p, a FROM system
  UNION ALL
  SELECT {keys}, alpha, p + 1, list_transform(a, lambda r, i: CASE WHEN i = p + 1
           THEN list_transform(r, lambda v: v / a[p + 1][p + 1])
           ELSE list_transform(r, lambda v, j: v - r[p + 1] * a[p + 1][j] / a[p + 1][p + 1]) END)
  FROM elimination WHERE p < {P}),
solved AS MATERIALIZED (
  SELECT {', '.join(f's.{k.strip()}' for k in keys.split(','))}, s.alpha, s.n,
         list_transform(s.s, lambda d, i: e.a[i][{P + 1}] / d) AS coef, s.my, s.m
  FROM elimination e JOIN system s ON {' AND '.join(f'e.{k.strip()} = s.{k.strip()}' for k in keys.split(','))}
    AND e.alpha = s.alpha WHERE e.p = {P}),
models AS MATERIALIZED (
  SELECT {keys}, alpha, n, coef, my - list_sum(list_transform(coef, lambda c, i: c * m[i])) AS intercept FROM solved)"""


COEFS = ", ".join(f"round(coef[{i + 1}], 6) + 0.0 AS c_{f}" for i, f in enumerate(FEATURES))
PREDICTED = "intercept + " + " + ".join(f"coef[{i + 1}] * {f}" for i, f in enumerate(FEATURES))
ONE_ALPHA = "alphas(alpha) AS (VALUES (1.0::DOUBLE))"
ALL_ALPHAS = "alphas(alpha) AS (VALUES " + ", ".join(f"({a}::DOUBLE)" for a in ALPHA_GRID) + ")"

ORACLES["feature_moments"] = f"""WITH {TRAINING}
SELECT series, count(*) AS n, round(avg(qty_sold), 6) AS level, round(avg(dow), 6) AS mean_dow,
       round(avg(roll7), 6) AS mean_roll7, round(var_pop(lag_1), 6) AS var_lag_1,
       round(covar_pop(lag_1, roll28), 6) + 0.0 AS cov_lag_1_roll28,
       round(covar_pop(dow, is_weekend), 6) + 0.0 AS cov_dow_weekend
FROM training GROUP BY series"""

ORACLES["ridge_by_series"] = f"""WITH RECURSIVE {TRAINING}, {ONE_ALPHA}, {systems('training', 'series')}
SELECT series, n AS n_train, round(intercept, 6) + 0.0 AS intercept, {COEFS} FROM models"""

ORACLES["ridge_pooled"] = f"""WITH RECURSIVE {TRAINING}, {ONE_ALPHA},
pool AS (SELECT 1 AS pool, * FROM training), {systems('pool', 'pool')}
SELECT 'intercept' AS feature, round(intercept, 6) + 0.0 AS weight FROM models UNION ALL
SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]), round(unnest(coef), 6) + 0.0 FROM models"""

ORACLES["cv_folds"] = f"""WITH {SPLIT}, {FOLDS}
SELECT series, CAST(block AS INTEGER) AS block, count(*) AS rows, min(date) AS first_day, max(date) AS last_day
FROM folds GROUP BY series, block"""

SEARCH = f"""{SPLIT}, {FOLDS}, {ALL_ALPHAS},
fold_rows AS (SELECT f.fold, b.* FROM range(1, {CV_FOLDS + 1}) f(fold) JOIN folds b ON b.block < f.fold),
{systems('fold_rows', 'series, fold')},
scores AS MATERIALIZED (
  SELECT series, alpha, avg(mae) AS mean_mae FROM (
    SELECT t.series, t.block, m.alpha, avg(abs(qty_sold - ({PREDICTED}))) AS mae
    FROM folds t JOIN models m ON m.series = t.series AND m.fold = t.block GROUP BY ALL)
  GROUP BY series, alpha)"""

ORACLES["alpha_search"] = f"""WITH RECURSIVE {SEARCH}
SELECT series, alpha, round(mean_mae, 6) AS mean_mae FROM scores"""


def renamed(text: str, prefix: str) -> str:
    """The same CTEs under other names, for a second set of systems in one statement."""
    for name in ("moments", "system", "elimination", "solved", "models"):
        text = text.replace(f"{name} AS", f"{prefix}{name} AS").replace(f"FROM {name}", f"FROM {prefix}{name}")
        text = text.replace(f"JOIN {name}", f"JOIN {prefix}{name}")
    return text


BEST = f"""{SEARCH},
best AS (SELECT series, arg_min(alpha, (mean_mae, alpha)) AS alpha FROM scores GROUP BY series),
{renamed(systems('train', 'series'), 'final_')},
fitted AS MATERIALIZED (SELECT m.* FROM final_models m JOIN best b ON m.series = b.series AND m.alpha = b.alpha)"""

ORACLES["best_alpha_model"] = f"""WITH RECURSIVE {BEST}
SELECT series, alpha, round(intercept, 6) + 0.0 AS intercept, {COEFS} FROM fitted"""

ORACLES["holdout_metrics"] = f"""WITH RECURSIVE {BEST}
SELECT series, alpha, count(*) AS rows, round(avg(abs(y - p)), 6) AS mae,
       printf('%.8e', avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))) AS mape
FROM (SELECT t.series, f.alpha, qty_sold AS y, {PREDICTED} AS p FROM test t JOIN fitted f ON f.series = t.series)
GROUP BY series, alpha"""

ORACLES["rolling_backtest"] = f"""WITH RECURSIVE {DENSE}, {ONE_ALPHA},
cuts(cut) AS (VALUES {', '.join(f"(DATE '{day}')" for day in CUT_DAYS)}),
known AS (SELECT *, min(date) OVER (PARTITION BY series) AS first_day FROM ({lags(True, 'dense')})),
usable AS MATERIALIZED (
  SELECT * EXCLUDE (first_day), {CALENDAR} FROM known
  WHERE date >= first_day + 28 AND lag_7 IS NOT NULL AND roll28 IS NOT NULL),
cut_rows AS (SELECT cut, u.* FROM cuts JOIN usable u ON u.date <= cut),
{systems('cut_rows', 'series, cut')}
SELECT series, cut, any_value(n) AS n_train, count(*) AS rows, round(avg(abs(y - p)), 6) AS mae,
       printf('%.8e', avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))) AS mape
FROM (SELECT m.series, m.cut, m.n, qty_sold AS y, {PREDICTED} AS p
      FROM models m JOIN usable t ON t.series = m.series AND t.date > m.cut AND t.date <= m.cut + 28)
GROUP BY series, cut"""

ORACLES["residual_interval"] = f"""WITH {DENSE}
SELECT series, round(quantile_cont(r, 0.025), 6) + 0.0 AS q_lo, round(quantile_cont(r, 0.975), 6) + 0.0 AS q_hi
FROM (SELECT series, qty_sold - lag(qty_sold, 7) OVER {BY_DAY} AS r FROM dense) WHERE r IS NOT NULL GROUP BY series"""

# --- forecasts -----------------------------------------------------------------------------------------

DRAWS = 500
LOW, HIGH = 0.05 / 2 * (DRAWS - 1), (1 - 0.05 / 2) * (DRAWS - 1)


def drawn_quantile(at: float) -> str:
    first, second = (f"max(resid) FILTER (place = {int(at) + k})" for k in (1, 2))
    return f"round({first} + ({second} - {first}) * {at - int(at)!r}, 6)"


ORACLES["residual_bootstrap"] = f"""WITH {DENSE},
lagged AS (SELECT series, date, qty_sold - lag(qty_sold, 7) OVER {BY_DAY} AS resid FROM dense),
known AS (SELECT series, list(resid ORDER BY date) AS resids FROM lagged WHERE resid IS NOT NULL GROUP BY series),
draws AS (
  SELECT series, resids[1 + ('0x' || substr(md5('0#' || series || '#' || b), 1, 15))::BIGINT % len(resids)] AS resid
  FROM known, range({DRAWS}) AS r(b)),
placed AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY resid) AS place FROM draws)
SELECT series, {drawn_quantile(LOW)} AS q_lo, {drawn_quantile(HIGH)} AS q_hi FROM placed GROUP BY series"""

ORACLES["forecast_spine"] = f"""WITH {DENSE}, {ahead(90)}
SELECT series, step, date FROM ahead WHERE date <= DATE '2001-12-31'"""


def rolled(models: str, days: int) -> str:
    """Day-by-day recursion over `models(series, intercept, coef)`, 28 quantities of state."""
    calendar = " + ".join(f"coef[{i + 1}] * {c}" for i, c in enumerate(
        ("dow", "month", "is_weekend", "is_xmas", "is_july4", "is_piday", "is_thanksgiving")))
    return f"""opening AS MATERIALIZED (
  SELECT series, max(date) AS last_day, list(qty_sold ORDER BY date) AS recent FROM (
    SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM dense)
  WHERE age <= 28 GROUP BY series HAVING count(*) >= 7),
base AS MATERIALIZED (
  SELECT series, list({calendar} + intercept ORDER BY date) AS base, any_value(coef) AS coef FROM (
    SELECT series, date, coef, intercept, {CALENDAR}
    FROM (SELECT series, last_day + CAST(i AS INTEGER) AS date FROM opening, range(1, {days + 1}) r(i))
    JOIN {models} USING (series)) GROUP BY series),
walk AS (
  SELECT series, 0 AS step, recent, NULL::DOUBLE AS mean FROM opening WHERE series IN (SELECT series FROM base)
  UNION ALL
  SELECT series, step, list_append(recent[-27:], greatest(0.0, round_even(mean, 0))), mean FROM (
    SELECT w.series, w.step + 1 AS step, w.recent,
      base[w.step + 1] + coef[8] * w.recent[-1] + coef[9] * w.recent[-7]
      + coef[10] * (list_sum(w.recent[-7:]) / 7) + coef[11] * (list_sum(w.recent) / len(w.recent)) AS mean
    FROM walk w JOIN base USING (series) WHERE w.step < {days}))"""


def rolled_rows(lo: str, hi: str) -> str:
    return f"""series, last_day + step AS date, CAST(w.recent[-1] AS BIGINT) AS qty_sold,
  round(mean, 6) + 0.0 AS pred_mean, round(mean + {lo}, 6) + 0.0 AS pred_lower, round(mean + {hi}, 6) + 0.0 AS pred_upper"""


PINNED = (0.31, -0.07, 0.83, 2.0, 1.5, -0.5, 3.0, 0.11, 0.17, 0.23, 0.29)
ORACLES["recursive_forecast"] = f"""WITH RECURSIVE {DENSE},
pinned AS (SELECT DISTINCT series, 1.25::DOUBLE AS intercept,
           [{', '.join(f'{c}::DOUBLE' for c in PINNED)}] AS coef FROM daily),
{rolled('pinned', POLICY.horizon_days)}
SELECT {rolled_rows('-3.5', '4.5')} FROM walk w JOIN opening o USING (series) WHERE step > 0"""


def end_to_end(days: int) -> str:
    return f"""{TRAINING}, {ONE_ALPHA}, {systems('training', 'series')},
bounds AS (SELECT series, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM (
  SELECT t.series, qty_sold - ({PREDICTED}) AS r FROM training t JOIN models m ON m.series = t.series)
  GROUP BY series),
{rolled('models', days)}"""


ORACLES["forecast_end_to_end"] = f"""WITH RECURSIVE {end_to_end(POLICY.horizon_days)}
SELECT {rolled_rows('lo', 'hi')}, 'ridge' AS forecast_method
FROM walk w JOIN opening o USING (series) JOIN bounds USING (series) WHERE step > 0"""

ORACLES["pooled_forecast"] = f"""WITH RECURSIVE {TRAINING}, {ONE_ALPHA},
pool AS (SELECT 1 AS pool, * FROM training), {systems('pool', 'pool')},
pooled AS (SELECT series, intercept, coef FROM (SELECT DISTINCT series FROM daily), models),
{rolled('pooled', 14)}
SELECT {rolled_rows('0.0', '0.0')}, 'model' AS forecast_method FROM walk w JOIN opening o USING (series) WHERE step > 0"""

NEEDS = ", ".join(f"CAST(trunc(level * {PER[i]}) AS BIGINT) AS {i}_need" for i in POLICY.ingredients)
ORACLES["flat_forecast"] = f"""WITH {DENSE}, {ahead(POLICY.horizon_days)}
SELECT series, date, CAST(trunc(level) AS BIGINT) AS qty_sold, {NEEDS} FROM (SELECT *, mean7 AS level FROM ahead)"""
ORACLES["wave_forecast"] = f"""WITH {DENSE}, {ahead(POLICY.horizon_days)}
SELECT series, date, CAST(trunc(level) AS BIGINT) AS qty_sold, {NEEDS}
FROM (SELECT *, mean14 + (step % 7 - 3) * 0.5 AS level FROM ahead)"""

ORACLES["recipe_need"] = f"""WITH {PLAN}, {RECIPE}
SELECT series, date, ingredient, qty_total * per_item AS need FROM plan CROSS JOIN recipe"""

ORACLES["recipe_table_need"] = f"""WITH {PLAN},
lines AS (
  SELECT s_suppkey AS series, ingredient, 1 + (s_suppkey + k) % 3 AS per_item,
         CASE WHEN k < 2 THEN 10 * (1 + s_suppkey % 5) END AS lot
  FROM supplier CROSS JOIN (VALUES (0, 'apples'), (1, 'dough'), (2, 'cinnamon')) AS i(k, ingredient)
  WHERE (s_suppkey + k) % 4 <> 3)
SELECT series, date, ingredient, (qty_total * per_item)::DOUBLE AS need,
  CASE WHEN lot IS NULL THEN qty_total * per_item ELSE (qty_total * per_item + lot - 1) // lot * lot END AS lots_needed
FROM plan JOIN lines USING (series)"""

# --- stock and policy ------------------------------------------------------------------------------------

ORACLES["restock_flags"] = f"""WITH {STOCK}
SELECT *, CAST(coalesce("start" > lag("end") OVER (PARTITION BY series, ingredient ORDER BY date), FALSE) AS INTEGER)
  AS restocked FROM stock"""

ORACLES["last_stock"] = f"""WITH {STOCK}
SELECT series, ingredient, CAST(arg_max("end", date) AS BIGINT) AS qty FROM stock GROUP BY series, ingredient"""


def proxy_of(qty: str) -> str:
    frame = over(-6, 0)
    std = f"coalesce(stddev_samp({qty}) OVER {frame}, 0.0)"
    return f"CASE WHEN {std} < 1e-6 THEN 0.25 * avg({qty}) OVER {frame} ELSE {std} END"


ORACLES["rolling_std_proxy"] = f"""WITH {PLAN}
SELECT series, date, round({proxy_of('qty_total')}, 6) AS std_proxy FROM plan"""

STATS = f"""proxied AS (SELECT *, {proxy_of('qty_total')} AS proxy FROM plan),
stats AS MATERIALIZED (
  SELECT *,
    coalesce(avg(qty_total) OVER {over(-28, -1)}, avg(qty_total) OVER (PARTITION BY series)) AS buy_mean,
    coalesce(stddev_samp(qty_total) OVER {over(-28, -1)}, first_value(proxy) OVER {BY_DAY}) AS buy_std,
    coalesce(stddev_samp(qty_total) OVER {over(-28, 0)}, first_value(proxy) OVER {BY_DAY}) AS special_std,
    CAST(sum(qty_total) OVER {over(0, LEAD - 1)} AS BIGINT) AS lead_demand,
    {', '.join(f"CAST(coalesce(sum(qty_total) OVER {over(1, d)}, 0) AS BIGINT) AS future_{d}" for d in sorted(set(EXPIRY.values())))}
  FROM proxied)"""

SAFETY = f"greatest(0.0, {Z} * (buy_std * per_item) * {ROOT})"
ORACLES["safety_rop"] = f"""WITH {PLAN}, {STATS}, {RECIPE}
SELECT series, date, ingredient, lot_size, start_stock, round({SAFETY}, 6) AS safety,
       round(buy_mean * per_item * {LEAD} + {SAFETY}, 6) AS reorder_point,
       round(lead_demand * per_item + {SAFETY} + per_item, 6) AS target_cover
FROM stats CROSS JOIN recipe"""

ORACLES["service_levels"] = "WITH levels(service_level, z) AS (VALUES " + ", ".join(
    f"({0.5 + k / 100!r}::DOUBLE, {NormalDist().inv_cdf(0.5 + k / 100)!r}::DOUBLE)" for k in range(50)
) + """) SELECT s_suppkey AS series, round(service_level, 6) AS service_level, round(z, 6) + 0.0 AS z
FROM supplier JOIN levels ON round(0.5 + (s_suppkey % 50) / 100, 6) = round(service_level, 6)"""

ORACLES["round_up_lot"] = f"""WITH {PLAN}, {RECIPE}
SELECT series, date, ingredient,
  CAST(CASE WHEN isodow(date) < 6 THEN ceil(qty_total * per_item * 1.5 / lot_size) * lot_size
            ELSE ceil(qty_total * per_item * 1.5) END AS BIGINT) AS order_qty
FROM plan CROSS JOIN recipe"""

ORACLES["lead_demand"] = f"""WITH {PLAN}
SELECT series, date, CAST(sum(qty_total) OVER {over(0, LEAD - 1)} AS BIGINT) AS lead_demand FROM plan"""

ORACLES["future_need"] = f"WITH {PLAN}\n" + "\nUNION ALL\n".join(
    f"""SELECT series, date, '{i}' AS ingredient,
       CAST(round_even(coalesce(sum(qty_total) OVER {over(1, EXPIRY[i])}, 0) * {float(PER[i])}::DOUBLE, 0) AS BIGINT) AS future_need
FROM plan""" for i in POLICY.ingredients)

RUNNING = f"""{PLAN}, {RECIPE},
needs AS (SELECT series, date, ingredient, pos, qty_total * per_item AS need FROM plan CROSS JOIN recipe),
unclamped AS (SELECT *, 5000.0::DOUBLE - sum(need) OVER (PARTITION BY series, ingredient ORDER BY date) AS c FROM needs),
running AS MATERIALIZED (
  SELECT series, date, ingredient, pos, need,
         c - least(0.0, min(c) OVER (PARTITION BY series, ingredient ORDER BY date)) AS stock FROM unclamped)"""

ORACLES["clamped_running_stock"] = f"WITH {RUNNING} SELECT series, date, ingredient, need, stock FROM running"

FUTURE = "CASE ingredient " + " ".join(f"WHEN '{i}' THEN future_{EXPIRY[i]}" for i in EXPIRY) + " END"
ORACLES["surplus_rank"] = f"""WITH {RUNNING}, {STATS},
lines AS (
  SELECT s.series, s.date, ingredient, pos, stock,
    CAST(round_even({FUTURE} * per_item, 0) AS BIGINT) AS future_need,
    greatest(0.0, {Z} * (special_std * per_item) * {ROOT}) AS safety
  FROM stats s JOIN running USING (series, date) JOIN recipe USING (ingredient, pos))
SELECT series, date, ingredient, stock, future_need, round(safety, 6) AS safety,
  round(stock - future_need - safety, 6) + 0.0 AS surplus,
  CAST(row_number() OVER (PARTITION BY series, date ORDER BY stock - future_need - safety DESC, pos) AS INTEGER) AS rank
FROM lines"""

ORACLES["weekday_normalise"] = """
WITH given AS (
  SELECT o_orderkey, unnest([o_orderkey % 7, (o_orderkey + 3) % 7, (o_orderkey * 5) % 7]) AS k FROM orders),
known(k, day) AS (VALUES (0, 0), (1, 3), (2, 6), (5, 6), (6, 2))
SELECT o_orderkey AS order_key, coalesce(string_agg(day::VARCHAR, ',' ORDER BY day), '') AS days
FROM (SELECT DISTINCT o_orderkey, day FROM given LEFT JOIN known USING (k)) GROUP BY o_orderkey"""

# --- order-dependent planning -----------------------------------------------------------------------------

A, B = POLICY.ingredients
RESTOCK, REORDER = POLICY.restock_amounts, POLICY.reorder_points

OPENING = f"""closing AS MATERIALIZED (
  SELECT series, max(CASE WHEN ingredient = '{A}' THEN qty END) AS a0, max(CASE WHEN ingredient = '{B}' THEN qty END) AS b0
  FROM (SELECT series, ingredient, CAST(arg_max("end", date) AS BIGINT) AS qty FROM stock GROUP BY series, ingredient)
  GROUP BY series)"""
STOCKED_PLAN = STOCK + """,
plan AS MATERIALIZED (
  SELECT series, date, CAST(qty_sold AS BIGINT) AS qty_total, row_number() OVER (PARTITION BY series ORDER BY date) AS i
  FROM dense)"""


ORACLES["daily_signals"] = f"""WITH RECURSIVE {STOCKED_PLAN}, {OPENING},
levels AS (SELECT series, greatest(1, CAST(trunc(avg(qty_total)) AS BIGINT)) AS average,
           list(qty_total ORDER BY date) AS qty FROM plan GROUP BY series),
lines AS MATERIALIZED (
  SELECT series, ingredient, per_item, qty,
    CASE ingredient WHEN '{A}' THEN a0 ELSE b0 END AS st0,
    greatest(CASE ingredient WHEN '{A}' THEN {REORDER[A]} ELSE {REORDER[B]} END, {POLICY.safety_days} * average * per_item) AS thr,
    {POLICY.safety_days} * average * per_item * {POLICY.surplus_factor} AS high,
    CASE ingredient WHEN '{A}' THEN {RESTOCK[A]} ELSE {RESTOCK[B]} END AS amount
  FROM levels JOIN closing USING (series) CROSS JOIN recipe),
walk AS (
  SELECT series, ingredient, 0 AS i, CAST(st0 AS DOUBLE) AS st, 0 AS signal FROM lines
  UNION ALL
  SELECT series, ingredient, i, CASE WHEN after < thr THEN after + amount ELSE after END,
         CASE WHEN after < thr THEN 1 WHEN after > high THEN -1 ELSE 0 END
  FROM (SELECT w.series, w.ingredient, w.i + 1 AS i, w.st - l.qty[w.i + 1] * l.per_item AS after, thr, high, amount
        FROM walk w JOIN lines l ON l.series = w.series AND l.ingredient = w.ingredient WHERE w.i < len(l.qty)))
SELECT series, p.date, ingredient, CAST(signal AS BIGINT) AS signal FROM walk JOIN plan p USING (series, i)"""

WEEKS = f"""weeks AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY iso_year, iso_week) AS w FROM (
    SELECT series, isoyear(date) AS iso_year, weekofyear(date) AS iso_week, avg(qty_total) AS mean_qty,
           CAST(sum(qty_total) AS BIGINT) AS total_qty, min(date) AS first_day, max(date) AS last_day,
           count(*) FILTER (isodow(date) - 1 IN {POLICY.special_days}) AS specials
    FROM plan GROUP BY ALL))"""

ORACLES["week_totals"] = f"""WITH {PLAN}, {WEEKS}
SELECT series, CAST(iso_year AS INTEGER) AS iso_year, CAST(iso_week AS INTEGER) AS iso_week, round(mean_qty, 6) AS mean_qty, total_qty, first_day, last_day FROM weeks"""

CAP = POLICY.special_boost_max_per_day
NTH = f"""nth AS (SELECT *, isoyear(date) AS iso_year, weekofyear(date) AS iso_week, row_number() OVER (
  PARTITION BY series, isoyear(date), weekofyear(date) ORDER BY date) AS nth
  FROM plan WHERE isodow(date) - 1 IN {POLICY.special_days})"""

ORACLES["special_fill"] = f"""WITH RECURSIVE {PLAN}, {WEEKS}, {NTH},
fill AS (
  SELECT series, date, iso_year, iso_week, nth, total_qty % 23 AS extra, least({CAP}, total_qty % 23) AS added,
         total_qty % 23 - least({CAP}, total_qty % 23) AS remaining
  FROM nth JOIN weeks USING (series, iso_year, iso_week) WHERE nth = 1
  UNION ALL
  SELECT n.series, n.date, n.iso_year, n.iso_week, n.nth, f.extra, least({CAP}, f.remaining),
         f.remaining - least({CAP}, f.remaining)
  FROM fill f JOIN nth n ON n.series = f.series AND n.iso_year = f.iso_year AND n.iso_week = f.iso_week AND n.nth = f.nth + 1)
SELECT series, date, extra, CAST(nth AS INTEGER) AS nth_special, CAST(added AS BIGINT) AS added FROM fill"""

PA, PB = int(PER[A]), int(PER[B])
def balanced(source: str) -> str:
    return f"""{source}, {OPENING}, {WEEKS},
figures AS MATERIALIZED (
  SELECT *, greatest({REORDER[A]}, sa) AS ta, greatest({REORDER[B]}, sb) AS tb FROM (
    SELECT *, {POLICY.safety_days} * greatest(1, CAST(trunc(mean_qty) AS BIGINT)) * {PA} AS sa,
              {POLICY.safety_days} * greatest(1, CAST(trunc(mean_qty) AS BIGINT)) * {PB} AS sb,
              isodow(first_day) - 1 = {POLICY.restock_weekday} AS delivery FROM weeks)),
balance AS (
  SELECT series, CAST(0 AS BIGINT) AS w, a0 AS a, b0 AS b, FALSE AS buy_a, FALSE AS buy_b, FALSE AS big,
         CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS extra FROM closing
  UNION ALL
  SELECT series, w, a - made * {PA}, b - made * {PB}, buy_a, buy_b, big, pick, extra FROM (
    SELECT *, least(extra, {CAP} * specials) AS made FROM (
      SELECT *, CASE WHEN big THEN greatest(0, least(floor((a - ta) / {PA}), floor((b - tb) / {PB})))::BIGINT ELSE 0 END AS extra,
             CASE WHEN NOT big THEN 0 WHEN a - sa >= b - sb THEN 1 ELSE 2 END AS pick FROM (
        SELECT *, a > sa * {POLICY.surplus_factor} OR b > sb * {POLICY.surplus_factor} AS big FROM (
          SELECT series, w, sa, sb, ta, tb, specials, buy_a, buy_b,
                 a + CASE WHEN buy_a THEN {RESTOCK[A]} ELSE 0 END - total_qty * {PA} AS a,
                 b + CASE WHEN buy_b THEN {RESTOCK[B]} ELSE 0 END - total_qty * {PB} AS b FROM (
            SELECT f.*, p.a, p.b, f.delivery AND p.a - f.total_qty * {PA} < f.ta AS buy_a,
                   f.delivery AND p.b - f.total_qty * {PB} < f.tb AS buy_b
            FROM balance p JOIN figures f ON f.series = p.series AND f.w = p.w + 1)))))),
decided AS MATERIALIZED (SELECT * FROM balance b JOIN weeks USING (series, w))"""


BALANCE = balanced(STOCKED_PLAN)

FILLED = f"""{NTH}
SELECT p.series, p.date, p.qty_total AS qty_sold, CAST(added AS BIGINT) AS special_added,
       CAST(p.qty_total + added AS BIGINT) AS qty_total
FROM (SELECT p.*, CASE WHEN nth IS NULL THEN 0 ELSE greatest(0, least({CAP}, extra - {CAP} * (nth - 1))) END AS added
      FROM plan p JOIN decided d ON d.series = p.series AND p.date BETWEEN d.first_day AND d.last_day
      LEFT JOIN nth n ON n.series = p.series AND n.date = p.date) p"""

ORACLES["weekly_balance_plan"] = f"WITH RECURSIVE {BALANCE}, {FILLED}"


def week_buy(day: str, i: str) -> str:
    return f"{day}::VARCHAR || ': BUY EXTRA ' || {i} || ' this week — projected shortage ahead.'"


def week_special(day: str, i: str, ideas: str) -> str:
    return f"{day}::VARCHAR || ': SURPLUS projected — run a ' || {i} || ' special. Suggested items: ' || {ideas} || '.'"


def idea_case(i: str) -> str:
    return f"CASE {i} " + " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in IDEAS.items()) + " END"


ORACLES["weekly_balance_advisories"] = f"""WITH RECURSIVE {BALANCE},
found AS (
  SELECT *, first_day AS date, 'BUY' AS kind, '{A}' AS ingredient FROM decided WHERE buy_a UNION ALL
  SELECT *, first_day, 'BUY', '{B}' FROM decided WHERE buy_b UNION ALL
  SELECT *, last_day, 'SPECIAL', CASE pick WHEN 1 THEN '{A}' ELSE '{B}' END FROM decided WHERE big)
SELECT series, date, kind || '_' || upper(ingredient) AS type, ingredient,
  CASE kind WHEN 'BUY' THEN {week_buy('date', 'ingredient')}
            ELSE {week_special('date', 'ingredient', idea_case('ingredient'))} END AS message,
  CAST(iso_week AS INTEGER) AS week, first_day AS window_start, last_day AS window_end FROM found"""


def scheduled(source: str) -> str:
    """The scheduler as a recursion over days; the day's numbers come from the window statistics."""
    return f"""{source}, {STATS},
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER {BY_DAY} AS i, isodow(date) - 1 AS wd FROM stats),
stocked AS (
  SELECT DISTINCT series, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS held_a, 0.0::DOUBLE AS held_b,
         0.0::DOUBLE AS buy_a, 0.0::DOUBLE AS buy_b, 0.0::DOUBLE AS add_a, 0.0::DOUBLE AS add_b FROM plan
  UNION ALL
  SELECT series, i, greatest(0.0, s2a - round_even(second * {PA}, 0)), greatest(0.0, s2b - round_even(second * {PB}, 0)),
         held_a, held_b, buy_a, buy_b,
         CASE WHEN a_first THEN first ELSE second END, CASE WHEN a_first THEN second ELSE first END
  FROM (
    SELECT *, CASE WHEN NOT special OR sur2 <= 0 OR want2 <= 0 OR left2 - want2 * per2 < 0 THEN 0.0 ELSE want2 END AS second FROM (
      SELECT *, CASE WHEN a_first THEN s2b ELSE s2a END AS left2 FROM (
        SELECT *, greatest(0.0, s1a - round_even(first * {PA}, 0)) AS s2a, greatest(0.0, s1b - round_even(first * {PB}, 0)) AS s2b FROM (
          SELECT *, CASE WHEN NOT special OR sur1 <= 0 OR want1 <= 0 OR left1 - want1 * per1 < 0 THEN 0.0 ELSE want1 END AS first FROM (
            SELECT *,
              CASE WHEN a_first THEN s1a ELSE s1b END AS left1,
              CASE WHEN a_first THEN sur_a ELSE sur_b END AS sur1, CASE WHEN a_first THEN sur_b ELSE sur_a END AS sur2,
              CASE WHEN a_first THEN {PA} ELSE {PB} END AS per1, CASE WHEN a_first THEN {PB} ELSE {PA} END AS per2,
              least({CAP}, floor(CASE WHEN a_first THEN sur_a / {PA} ELSE sur_b / {PB} END)) AS want1,
              least({CAP}, floor(CASE WHEN a_first THEN sur_b / {PB} ELSE sur_a / {PA} END)) AS want2 FROM (
              SELECT *, sur_a >= sur_b AS a_first FROM (
                SELECT *, wd IN {POLICY.special_days} AS special,
                  s1a - round_even(future_{EXPIRY[A]} * {PA}, 0) - greatest(0.0, {Z} * (special_std * {PA}) * {ROOT}) AS sur_a,
                  s1b - round_even(future_{EXPIRY[B]} * {PB}, 0) - greatest(0.0, {Z} * (special_std * {PB}) * {ROOT}) AS sur_b FROM (
                  SELECT *, greatest(0.0, held_a + buy_a - round_even(qty_total * {PA}, 0)) AS s1a,
                            greatest(0.0, held_b + buy_b - round_even(qty_total * {PB}, 0)) AS s1b FROM (
                    SELECT *,
                      CASE WHEN wd = {POLICY.vendor_weekday} AND held_a < buy_mean * {PA} * {LEAD} + saf_a
                        THEN ceil(greatest(0.0, lead_demand * {PA} + saf_a + {PA} - held_a) / {POLICY.lots[A]}) * {POLICY.lots[A]} ELSE 0.0 END AS buy_a,
                      CASE WHEN wd = {POLICY.vendor_weekday} AND held_b < buy_mean * {PB} * {LEAD} + saf_b
                        THEN ceil(greatest(0.0, lead_demand * {PB} + saf_b + {PB} - held_b) / {POLICY.lots[B]}) * {POLICY.lots[B]} ELSE 0.0 END AS buy_b FROM (
                      SELECT n.*, w.a AS held_a, w.b AS held_b,
                        greatest(0.0, {Z} * (buy_std * {PA}) * {ROOT}) AS saf_a, greatest(0.0, {Z} * (buy_std * {PB}) * {ROOT}) AS saf_b
                      FROM stocked w JOIN numbered n ON n.series = w.series AND n.i = w.i + 1))))))))))),
done AS MATERIALIZED (
  SELECT n.*, held_a, held_b, buy_a, buy_b, add_a, add_b FROM stocked w JOIN numbered n USING (series, i))"""


ORACLES["schedule_plan"] = f"""WITH RECURSIVE {scheduled(PLAN)}
SELECT series, date, qty_sold, CAST(qty_total + add_a + add_b AS BIGINT) AS qty_total,
       CAST(add_a + add_b AS BIGINT) AS special_added FROM done"""


# Recipe lines as lists, one row of settings per series.
OWN_PLAN = f"""{PLAN},
numbered_plan AS MATERIALIZED (SELECT *, row_number() OVER {BY_DAY} AS i FROM plan),
pantry(pos, ingredient) AS (VALUES (0, 'apples'), (1, 'dough'), (2, 'cinnamon'), (3, 'butter'), (4, 'sugar')),
own AS MATERIALIZED (
  SELECT s_suppkey AS series, list(ingredient ORDER BY pos) AS names, list((1 + (s_suppkey + pos) % 3)::DOUBLE ORDER BY pos) AS per,
    list(CASE WHEN pos <> 2 THEN 10 * (1 + s_suppkey % 5) ELSE 1 END ORDER BY pos) AS lot,
    list(3 + (s_suppkey + 2 * pos) % 6 ORDER BY pos) AS shelf, list(20 * (pos + 1) ORDER BY pos) AS reorder,
    list(100 + 50 * ((s_suppkey + pos) % 3) ORDER BY pos) AS restock, list((40 * (pos + 1))::DOUBLE ORDER BY pos) AS stock0,
    range(1, 3 + s_suppkey % 4) AS ks, s_suppkey % 5 <> 4 AS ruled
  FROM supplier CROSS JOIN pantry WHERE pos < 2 + s_suppkey % 4 GROUP BY s_suppkey),
settings AS MATERIALIZED (
  SELECT *, CASE WHEN ruled THEN series % 7 ELSE {POLICY.vendor_weekday} END AS vendor,
    CASE WHEN ruled THEN [series % 7, (series + 3) % 7] ELSE {list(POLICY.special_days)} END AS specials_on,
    CASE WHEN ruled THEN 3 + series % 3 ELSE {POLICY.special_boost_max_per_day} END AS cap,
    CASE WHEN ruled THEN 1 + series % 3 ELSE {LEAD} END AS lead,
    CASE WHEN ruled THEN series % 2 ELSE {POLICY.restock_weekday} END AS delivery_day
  FROM own)"""

ORACLES["signals_by_table"] = f"""WITH RECURSIVE {OWN_PLAN},
levels AS (SELECT series, greatest(1, CAST(trunc(avg(qty_total)) AS BIGINT)) AS average FROM plan GROUP BY series),
walk AS (
  SELECT series, CAST(0 AS BIGINT) AS i, stock0 AS st, CAST([] AS BIGINT[]) AS signal FROM settings
  UNION ALL
  SELECT series, i, [after[k] + CASE WHEN signal[k] = 1 THEN restock[k] ELSE 0 END FOR k IN ks], signal FROM (
    SELECT *, [CASE WHEN after[k] < greatest(reorder[k], {POLICY.safety_days} * average * per[k]) THEN 1
                    WHEN after[k] > {POLICY.safety_days} * average * per[k] * {POLICY.surplus_factor} THEN -1 ELSE 0 END::BIGINT FOR k IN ks] AS signal
    FROM (SELECT p.series, p.i, s.* EXCLUDE (series), average, [w.st[k] - p.qty_total * s.per[k] FOR k IN s.ks] AS after
          FROM walk w JOIN numbered_plan p ON p.series = w.series AND p.i = w.i + 1
          JOIN settings s ON s.series = p.series JOIN levels l ON l.series = p.series)))
SELECT series, date, unnest(names) AS ingredient, unnest(signal) AS signal
FROM walk JOIN numbered_plan USING (series, i) JOIN settings USING (series)"""

ORACLES["balance_by_table"] = f"""WITH RECURSIVE {OWN_PLAN},
wk AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY y, w) AS wi FROM (
    SELECT series, isoyear(date) AS y, weekofyear(date) AS w, avg(qty_total) AS mean_qty, sum(qty_total)::BIGINT AS total_qty,
      min(date) AS first_day, max(date) AS last_day, count(*) FILTER (list_contains(specials_on, isodow(date) - 1)) AS specials
    FROM plan JOIN settings USING (series) GROUP BY ALL)),
balance AS (
  SELECT series, CAST(0 AS BIGINT) AS wi, stock0 AS st, CAST([] AS BOOLEAN[]) AS buy, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS pick FROM settings
  UNION ALL
  SELECT series, wi, [st1[k] - least(extra, cap * specials) * per[k] FOR k IN ks], buy, extra, pick FROM (
    SELECT *, CASE WHEN big THEN greatest(0, list_min([floor((st1[k] - thr[k]) / per[k]) FOR k IN ks])) ELSE 0 END::BIGINT AS extra,
           CASE WHEN big THEN list_position(gap, list_max(gap)) ELSE 0 END::BIGINT AS pick FROM (
      SELECT *, [st1[k] - saf[k] FOR k IN ks] AS gap, list_bool_or([st1[k] > saf[k] * {POLICY.surplus_factor} FOR k IN ks]) AS big FROM (
        SELECT *, [st[k] + CASE WHEN buy[k] THEN restock[k] ELSE 0 END - total_qty * per[k] FOR k IN ks] AS st1 FROM (
          SELECT *, [isodow(first_day) - 1 = delivery_day AND st[k] - total_qty * per[k] < thr[k] FOR k IN ks] AS buy FROM (
            SELECT *, [greatest(reorder[k], saf[k]) FOR k IN ks] AS thr FROM (
              SELECT f.*, s.* EXCLUDE (series), b.st, [{POLICY.safety_days} * greatest(1, trunc(mean_qty)) * s.per[k] FOR k IN s.ks] AS saf
              FROM balance b JOIN wk f ON f.series = b.series AND f.wi = b.wi + 1 JOIN settings s ON s.series = f.series))))))),
nth_day AS (SELECT series, date, row_number() OVER (PARTITION BY series, isoyear(date), weekofyear(date) ORDER BY date) AS nth
  FROM plan JOIN settings USING (series) WHERE list_contains(specials_on, isodow(date) - 1))
SELECT p.series, p.date, p.qty_total AS qty_sold, CAST(added AS BIGINT) AS special_added, CAST(p.qty_total + added AS BIGINT) AS qty_total,
       CAST(CASE WHEN p.date = first_day THEN len([x FOR x IN buy IF x]) ELSE 0 END AS BIGINT) AS lines_bought, pick
FROM (SELECT p.*, f.first_day, b.buy, b.pick, CASE WHEN nth IS NULL THEN 0 ELSE greatest(0, least(cap, extra - cap * (nth - 1))) END AS added
      FROM plan p JOIN settings s ON s.series = p.series
      JOIN wk f ON f.series = p.series AND p.date BETWEEN f.first_day AND f.last_day
      JOIN balance b ON b.series = f.series AND b.wi = f.wi
      LEFT JOIN nth_day n ON n.series = p.series AND n.date = p.date) p"""


def specials_in_turn(source: str, most: int = 5) -> str:
    """Adds add_1, add_2, ..: what the line of each rank burns, one rank after the other."""
    for r in range(1, most + 1):
        before = f"st_{r - 1}"
        want = f"least(cap, floor(sur[turn[{r}]] / per[turn[{r}]]))"
        source = f"""(SELECT *, [greatest(0.0, {before}[k] - round_even(add_{r} * per[k], 0)) FOR k IN ks] AS st_{r} FROM (
          SELECT *, CASE WHEN {r} > len(per) OR NOT special OR sur[turn[{r}]] <= 0 OR {want} <= 0
            OR {before}[turn[{r}]] - {want} * per[turn[{r}]] < 0 THEN 0.0 ELSE {want} END AS add_{r} FROM {source}))"""
    return source


def safe(std: str) -> str:
    return f"greatest(0.0, {Z} * ({std} * per[k]) * sqrt(lead::DOUBLE))"


TONIGHT = f"""(
  SELECT *, [x.k FOR x IN list_sort([{{'s': -sur[k], 'k': k}} FOR k IN ks])] AS turn FROM (
    SELECT *, [st_0[k] - round_even(future[k] * per[k], 0) - {safe('special_std')} FOR k IN ks] AS sur FROM (
      SELECT *, [greatest(0.0, held[k] + buy[k] - round_even(qty_total * per[k], 0)) FOR k IN ks] AS st_0 FROM (
        SELECT *, [CASE WHEN opens AND held[k] < buy_mean * per[k] * lead + {safe('buy_std')}
          THEN ceil(greatest(0.0, lead_demand * per[k] + {safe('buy_std')} + per[k] - held[k]) / lot[k]) * lot[k] ELSE 0.0 END FOR k IN ks] AS buy
        FROM (SELECT n.*, w.st AS held FROM stocked w JOIN numbered n ON n.series = w.series AND n.i = w.i + 1)))))"""
ORACLES["schedule_by_table"] = f"""WITH RECURSIVE {OWN_PLAN}, {STATS},
whole AS (SELECT series, list(qty_total ORDER BY date) AS q FROM plan GROUP BY series),
numbered AS MATERIALIZED (
  SELECT t.* EXCLUDE (lead_demand), p.i, s.* EXCLUDE (series), isodow(t.date) - 1 = vendor AS opens,
    list_contains(specials_on, isodow(t.date) - 1) AS special, coalesce(list_sum(q[p.i : p.i + lead - 1]), 0)::BIGINT AS lead_demand,
    [coalesce(list_sum(q[p.i + 1 : p.i + lead + shelf[k] // 2]), 0) FOR k IN ks] AS future
  FROM stats t JOIN numbered_plan p USING (series, date) JOIN settings s USING (series) JOIN whole USING (series)),
stocked AS (
  SELECT series, CAST(0 AS BIGINT) AS i, stock0 AS st, CAST([] AS DOUBLE[]) AS buy, CAST([] AS DOUBLE[]) AS adds FROM settings
  UNION ALL
  SELECT series, i, st_5, buy, [CASE k WHEN turn[1] THEN add_1 WHEN turn[2] THEN add_2 WHEN turn[3] THEN add_3
                                       WHEN turn[4] THEN add_4 WHEN turn[5] THEN add_5 END FOR k IN ks]
  FROM {specials_in_turn(TONIGHT)})
SELECT series, date, qty_sold, CAST(list_sum(adds) AS BIGINT) AS special_added, CAST(qty_total + list_sum(adds) AS BIGINT) AS qty_total, lead_demand,
  array_to_string([x::BIGINT FOR x IN buy], ',') AS orders, array_to_string([x::BIGINT FOR x IN adds], ',') AS extras
FROM stocked JOIN numbered USING (series, i)"""



def one_place(number: str) -> str:
    return f"round_even({number}, 1)::DECIMAL(38, 1)::VARCHAR"


SUMMARY = (
    f"CASE WHEN pred_mean IS NOT NULL THEN 'Pred ' || {one_place('pred_mean')} || ' (' || {one_place('pred_lower')}"
    f" || '–' || {one_place('pred_upper')} || ')' END"
)


def buy_text(i: str, x: str) -> str:
    saf = f"greatest(0.0, {Z} * (buy_std * {PER[i]}) * {ROOT})"
    return (
        f"date::VARCHAR || ': BUY ' || buy_{x}::BIGINT || ' {i} (stock ' || held_{x}::BIGINT || ' < ROP ' || "
        f"round_even(buy_mean * {PER[i]} * {LEAD} + {saf}, 0)::BIGINT || '). Target cover=' || "
        f"round_even(lead_demand * {PER[i]} + {saf} + {PER[i]}, 0)::BIGINT || '.'"
    )


ORACLES["schedule_advisories"] = f"""WITH RECURSIVE {scheduled(PLAN)},
found AS (""" + " UNION ALL ".join(
    f"""SELECT *, 'BUY_{i.upper()}' AS type, '{i}' AS ingredient, buy_{x}::BIGINT AS qty, NULL::BIGINT AS special_qty,
  {buy_text(i, x)} AS text, NULL::VARCHAR AS suggestions, 'below_ROP' AS reason FROM done WHERE buy_{x} > 0
UNION ALL SELECT *, 'SPECIAL_{i.upper()}', '{i}', NULL, add_{x}::BIGINT,
  date::VARCHAR || ': Scheduled ' || add_{x}::BIGINT || ' extra items to burn surplus of {i}.',
  '{IDEAS[i]}', 'surplus_burn' FROM done WHERE add_{x} > 0"""
    for i, x in zip(POLICY.ingredients, "ab", strict=True)
) + f""")
SELECT series, date, type, ingredient, qty, special_qty, concat_ws(' — ', text, {SUMMARY}) AS message,
  suggestions, reason, round(pred_mean, 6) AS pred_mean, round(pred_lower, 6) AS pred_lower,
  round(pred_upper, 6) AS pred_upper, {SUMMARY} AS pred_summary FROM found"""

# --- advisories ---------------------------------------------------------------------------------------------

SIGNALS = PLAN + f""",
signals AS MATERIALIZED (
  SELECT series, date, '{A}' AS ingredient, CASE WHEN qty_total > 35 THEN 1 WHEN qty_total = 0 THEN -1 ELSE 0 END AS signal FROM plan
  UNION ALL
  SELECT series, date, '{B}', CASE WHEN qty_total % 7 = 1 THEN 1 WHEN qty_total % 5 = 2 THEN -1 ELSE 0 END FROM plan)"""

ORACLES["unpivot_signals"] = f"WITH {SIGNALS} SELECT series, date, ingredient, signal FROM signals"

WEEKLY = SIGNALS + f""",
weeks AS (
  SELECT series, ingredient, isoyear(date) AS y, CAST(weekofyear(date) AS INTEGER) AS week, min(date) AS window_start, max(date) AS window_end,
         max(signal) = 1 AS short, count(*) FILTER (signal = -1) >= 2 OR arg_max(signal, date) = -1 AS surplus
  FROM signals GROUP BY ALL),
weekly AS MATERIALIZED (
  SELECT series, window_start AS date, 'BUY_' || upper(ingredient) AS type, ingredient,
         {week_buy('window_start', 'ingredient')} AS message, week, window_start, window_end FROM weeks WHERE short
  UNION ALL
  SELECT series, window_end, 'SPECIAL_' || upper(ingredient), ingredient,
         {week_special('window_end', 'ingredient', idea_case('ingredient'))}, week, window_start, window_end
  FROM weeks WHERE surplus)"""

ORACLES["weekly_advisories"] = f"WITH {WEEKLY} SELECT * FROM weekly"

ORACLES["stored_plan"] = ORACLES["unpivot_signals"]
ORACLES["stored_advisories"] = f"""WITH {WEEKLY}
SELECT series, date::VARCHAR AS date, type, ingredient, CAST(0 AS BIGINT) AS special_qty, message, week, 'plan_2024' AS source FROM weekly"""
ORACLES["ordered_advisories"] = f"""WITH {WEEKLY}
SELECT series, date, type, CAST(row_number() OVER (PARTITION BY series ORDER BY date, type) AS INTEGER) AS place FROM weekly"""
ORACLES["sorted_advisories"] = ORACLES["ordered_advisories"]
ORACLES["policy_config"] = f"""WITH {PLAN}
SELECT series, date, 'flour' AS ingredient, qty_total * 2.0::DOUBLE AS need FROM plan UNION ALL
SELECT series, date, 'sugar', qty_total * 5.0::DOUBLE FROM plan"""

ORACLES["advisory_predictions"] = f"""WITH {PLAN}
SELECT series, date, concat_ws(' — ', 'order ' || qty_total, {SUMMARY}) AS message, round(pred_mean, 6) AS pred_mean,
  round(pred_lower, 6) AS pred_lower, round(pred_upper, 6) AS pred_upper, {SUMMARY} AS pred_summary
FROM plan"""

WEEKEND = "Apple Turnovers, Apple Cider Donuts, Mini Apple Hand Pies"
NOTICE = f"'Based on recent average: ' || {one_place('mean7')} || ' items per day'"
SATURDAY = "(last_day + 1 + CAST((13 - isodow(last_day + 1)) % 7 AS INTEGER))"
ORACLES["fallback_advisories"] = f"""WITH {DENSE}, {RECENT}
SELECT series, last_day + 1 AS date, 'forecast' AS type, 'general' AS ingredient, NULL::BIGINT AS qty,
  NULL::BIGINT AS special_qty, {NOTICE} AS message, NULL::VARCHAR AS suggestions, NULL::VARCHAR AS reason FROM recent
UNION ALL
SELECT series, last_day + 1, 'BUY_{A.upper()}', '{A}', {POLICY.lots[A]}, 0, (last_day + 1)::VARCHAR
  || ': BUY {POLICY.lots[A]} {A} - based on recent demand of ' || {one_place('mean14')} || ' items/day', '', 'projected_demand' FROM recent
UNION ALL
SELECT series, {SATURDAY}, 'SPECIAL_{A.upper()}', '{A}', NULL, greatest(3, CAST(trunc(mean14 * 0.3) AS BIGINT)),
  {SATURDAY}::VARCHAR || ': Weekend special recommended - surplus expected', '{WEEKEND}', 'weekend_surplus' FROM recent
UNION ALL
SELECT series, DATE '2024-01-01', 'info', 'general', NULL, NULL, 'Processed ' || count(*) || ' rows successfully', NULL, NULL
FROM dense GROUP BY series"""

MENU = "menu(pool, pos, item) AS (VALUES " + ", ".join(
    f"('{i}', {pos}, '{item}')" for i, items in POLICY.menu.items() for pos, item in enumerate(items)
) + ")"
ASKED = """asked AS (
  SELECT s_suppkey AS seed, CASE s_suppkey % 3 WHEN 0 THEN 'apples' WHEN 1 THEN 'dough' ELSE 'cinnamon' END AS ingredient,
         CASE s_suppkey % 3 WHEN 0 THEN 'apples' WHEN 1 THEN 'dough' ELSE '_default' END AS pool FROM supplier)"""

ORACLES["menu_seeded"] = f"""WITH {MENU}, {ASKED}
SELECT ingredient, seed, string_agg(item, ', ' ORDER BY rank) AS ideas FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '#' || pool || '#' || item)) AS rank
  FROM asked JOIN menu USING (pool)) WHERE rank <= 5 GROUP BY ingredient, seed"""

ORACLES["menu_table"] = ORACLES["menu_seeded"]

ORACLES["menu_random"] = f"WITH {ASKED} SELECT ingredient, seed, CAST(5 AS BIGINT) AS items FROM asked"

# --- serving and exports --------------------------------------------------------------------------------------

BOOSTED = PLAN + """,
boosted AS MATERIALIZED (
  SELECT series, date, qty_total + added AS qty_total, added AS special_added
  FROM (SELECT *, CASE WHEN isodow(date) >= 4 THEN qty_total % 6 ELSE 0 END AS added FROM plan))"""
SUMS = """CAST(sum(qty_total) AS BIGINT) AS total_forecast, round_even(avg(qty_total), 1) AS avg_daily,
  round_even(sum(special_added) * 0.5::DOUBLE, 1) AS waste_saved_lbs, round_even(sum(special_added) * 0.5::DOUBLE * 2.8::DOUBLE, 1) AS co2_reduced_kg"""

ORACLES["forecast_summary"] = f"WITH {BOOSTED} SELECT series, {SUMS} FROM boosted GROUP BY series"

ORACLES["location_summary"] = f"""WITH {BOOSTED}
SELECT 3 AS location, {SUMS} FROM boosted WHERE series = 3 UNION ALL SELECT -1, 0, 0, 0, 0"""

ORACLES["next_points"] = f"""WITH {BOOSTED}
SELECT series, string_agg(qty_total::VARCHAR, ',' ORDER BY date) AS points
FROM (SELECT *, row_number() OVER {BY_DAY} AS i FROM boosted) WHERE i <= 14 GROUP BY series"""

FEED = WEEKLY + f""",
{RECENT},
mixed AS (
  SELECT series, date, type, message, ingredient FROM weekly
  UNION ALL SELECT -series, last_day + 1, 'forecast', {NOTICE}, 'general' FROM recent),
feed AS MATERIALIZED (
  SELECT series, date, type, CASE WHEN lone THEN '{PLACEHOLDER_PREFIX}: ' || message ELSE message END AS message,
         ingredient, NULL::VARCHAR AS suggestions, NULL::BIGINT AS special_qty, NULL::BIGINT AS qty, lone AS is_placeholder
  FROM (SELECT *, count(*) OVER (PARTITION BY series) <= 1 AND (type = 'forecast'
          OR contains(message, '{PLACEHOLDER_MARKERS[0]}') OR contains(message, '{PLACEHOLDER_MARKERS[1]}')) AS lone FROM mixed))"""

ORACLES["advisory_feed"] = f"WITH {FEED} SELECT * FROM feed"

ORACLES["demo_test"] = f"""WITH {FEED}
SELECT series, count(*) AS rows, min(date)::VARCHAR AS first_date,
  year(min(date)) = 2026 OR bool_or(contains(message, '{PLACEHOLDER_MARKERS[0]}')) OR count(*) = 23 AS is_demo
FROM feed GROUP BY series"""

ORACLES["plan_export"] = f"""WITH {BOOSTED}
SELECT series, date, qty_total, special_added, qty_total * {PA} AS apples_need, qty_total // 2 AS dough_need FROM boosted"""

ORACLES["plan_export_gaps"] = f"""WITH {PLAN},
halves AS (SELECT series, date, qty_total, CASE WHEN series % 2 = 0 OR qty_total % 7 <> 0 THEN qty_total / 2 END AS half FROM plan)
SELECT series, date, qty_total, CAST(coalesce(CASE WHEN count(*) OVER whole > count(half) OVER whole
  THEN round_even(half, 0) ELSE trunc(half) END, 0) AS BIGINT) AS dough_need
FROM halves WINDOW whole AS (PARTITION BY series)"""

ORACLES["advisory_export"] = f"""WITH {PLAN}
SELECT series, strftime(date, '%Y-%m-%d') AS date, CASE WHEN qty_total % 4 >= 2 THEN qty_total END AS qty,
  CASE WHEN qty_total % 3 = 0 THEN 0 ELSE qty_total END AS special_qty, round_even(pred_mean, 1) AS pred_mean FROM plan"""

ORACLES["windowed_export"] = f"""WITH {PLAN},
ends AS (SELECT *, min(date) OVER (PARTITION BY series) AS window_start, max(date) OVER (PARTITION BY series) AS window_end FROM plan)
SELECT window_start, window_end, count(DISTINCT series) AS series, count(*) AS rows, CAST(sum(qty_total) AS BIGINT) AS qty_total
FROM ends GROUP BY ALL"""

ORACLES["plan_json"] = f"""WITH {PLAN}
SELECT series, date, '{{"series":' || series || ',"date":"' || date || '","qty_sold":' || qty_sold || ',"qty_total":' || qty_total
  || ',"special_added":0,"gap":' || CASE WHEN qty_sold = 0 THEN 'null' ELSE qty_sold || '.0' END || '}}' AS record FROM plan"""

ORACLES["backtest_join"] = f"""WITH {DENSE}
SELECT series, date, qty_sold, CASE WHEN date >= DATE '2000-01-01' THEN lag(qty_sold, 7) OVER {BY_DAY} END AS pred FROM dense"""

ORACLES["accuracy_report"] = f"""WITH {DENSE},
scored AS (SELECT series, date, qty_sold AS y, avg(qty_sold) OVER {over(-7, -1)} AS p FROM dense),
scale AS (SELECT series, avg(c) AS scale FROM (
  SELECT series, abs(qty_sold - lag(qty_sold, 7) OVER {BY_DAY}) AS c FROM dense WHERE date <= DATE '{LAST_TRAIN_DAY}') GROUP BY series)
SELECT series, rows, round(mae, 6) AS mae, mape, round(smape, 6) AS smape,
  round(CASE WHEN scale = 0 THEN mae ELSE mae / scale END, 6) AS mase
FROM (SELECT series, count(*) AS rows, avg(abs(y - p)) AS mae,
        printf('%.8e', avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))) AS mape,
        avg(CASE WHEN y = 0 AND p = 0 THEN 0 ELSE abs(y - p) / ((abs(y) + abs(p)) / 2) END) AS smape
      FROM scored WHERE date > DATE '{LAST_TRAIN_DAY}' AND p IS NOT NULL GROUP BY series) LEFT JOIN scale USING (series)"""

# --- people -----------------------------------------------------------------------------------------------------

SIGNUPS = f"""signups AS (
  SELECT event_id, ts, trim(CASE WHEN event_id % 11 = 0 THEN u || '@nowhere' WHEN event_id % 13 = 0 THEN '   '
    ELSE ' ' || u || user_id || '@example.com' END) AS email
  FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'User' ELSE 'user' END AS u FROM events)),
valid AS (SELECT *, lower(email) AS email_lc FROM signups WHERE regexp_matches(email, '{EMAIL_PATTERN}'))"""

ORACLES["signup_dedupe"] = f"""WITH {SIGNUPS}
SELECT email_lc, email, ts, event_id FROM valid v
WHERE email_lc NOT IN (SELECT email_lc FROM valid WHERE md5(email_lc) < '8')
QUALIFY row_number() OVER (PARTITION BY email_lc ORDER BY ts, email, event_id) = 1"""

ORACLES["signup_count"] = f"WITH {SIGNUPS} SELECT count(DISTINCT email_lc) AS signups FROM valid"

CONTACTS = f"""contacts AS (
  SELECT conv_id, turn, CASE WHEN turn % 9 = 4 THEN '' ELSE role END AS name,
    CASE WHEN conv_id % 7 = 0 THEN '' WHEN conv_id % 5 = 0 THEN 'nobody' ELSE 'c' || conv_id || '@example.com' END AS email,
    trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS message,
    TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS ts FROM conversations),
checked AS (
  SELECT *, 'contact_' || strftime(ts, '%Y%m%d_%H%M%S') AS id,
    CASE WHEN name = '' THEN '{CONTACT_ERRORS["name"]}' WHEN email = '' THEN '{CONTACT_ERRORS["email"]}'
         WHEN message = '' THEN '{CONTACT_ERRORS["message"]}'
         WHEN NOT (contains(email, '@') AND contains(email, '.')) THEN '{CONTACT_ERRORS["format"]}' END AS error FROM contacts)"""

ORACLES["contact_validate"] = f"WITH {CONTACTS} SELECT conv_id, turn, id, name, email, message, error FROM checked"
ORACLES["contacts_latest"] = f"""WITH {CONTACTS}
SELECT id, ts, name, email, message FROM checked WHERE error IS NULL ORDER BY ts DESC, id"""

ORACLES["contacts_appended"] = ORACLES["contacts_latest"]

# --- streams and whole runs ---------------------------------------------------------------------------------------

ORACLES["stream_ingest"] = f"""WITH {DAILY}
SELECT series, count(*) FILTER (day(date) <> 13) AS days, sum(qty_sold) FILTER (day(date) <> 13) AS qty_sold,
       count(*) FILTER (day(date) = 13) AS rejected FROM daily GROUP BY series"""

ORACLES["stream_signups"] = f"WITH {SIGNUPS} SELECT DISTINCT email_lc, CAST(1 AS BIGINT) AS rows FROM valid"

ORACLES["season_run"] = "WITH RECURSIVE " + scheduled(end_to_end(30) + """,
plan AS MATERIALIZED (
  SELECT series, last_day + step AS date, CAST(w.recent[-1] AS BIGINT) AS qty_sold,
         CAST(w.recent[-1] AS BIGINT) AS qty_total, mean AS pred_mean
  FROM walk w JOIN opening o USING (series) WHERE step > 0)""") + """
SELECT series, date, qty_sold, CAST(qty_total + add_a + add_b AS BIGINT) AS qty_total,
       CAST(add_a + add_b AS BIGINT) AS special_added, round(pred_mean, 6) + 0.0 AS pred_mean, 'ridge' AS forecast_method FROM done"""

ORACLES["weekly_run"] = "WITH RECURSIVE " + balanced(f"""{STOCK}, {BEST.split(DENSE + ",", 1)[1]},
{rolled('fitted', 30)},
plan AS MATERIALIZED (
  SELECT series, last_day + step AS date, CAST(w.recent[-1] AS BIGINT) AS qty_total
  FROM walk w JOIN opening o USING (series) WHERE step > 0)""") + f", {FILLED}".replace(
    "AS qty_total\nFROM", "AS qty_total, 'ridge' AS forecast_method\nFROM")

ORACLES["entry_slice"] = f"""WITH {DENSE}, {ahead(30)},
plan AS (SELECT series, CAST(trunc(mean7) AS BIGINT) AS qty_total, 0 AS special_added FROM ahead)
SELECT series, {SUMS}, sum(qty_total * {float(PER[A])}::DOUBLE) AS apples_need,
       sum(qty_total * {float(PER[B])}::DOUBLE) AS dough_need FROM plan GROUP BY series"""
