"""Planning arithmetic as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.tables import WEEKDAY_NUMBERS, Policy


def whole(amount: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.rint(amount).cast("bigint")


def safety_stock(std: Column, lead_days: int | Column, z: float | Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(z) * std * F.sqrt(F.lit(lead_days).cast("double")))


def reorder_point(mean: Column, lead_days: int | Column, safety: Column) -> Column:
    return mean * F.lit(lead_days) + safety


def round_up_lot(qty: Column, lot: Column) -> Column:
    """Up to the next whole lot; without a usable lot size, up to the next whole unit."""
    return F.when(lot > 0, F.ceil(qty / lot) * lot).otherwise(F.ceil(qty)).cast("bigint")


def weekday_list(days: Column) -> Column:
    """Weekday names or digits in an array<string>, as sorted distinct numbers."""
    known = F.create_map(
        *[F.lit(x) for name, number in WEEKDAY_NUMBERS.items() for x in (name, number)],
        *[F.lit(x) for number in range(7) for x in (str(number), number)],
    )
    numbers = F.transform(days, lambda d: known[F.lower(F.substring(F.btrim(d), 1, 3))])
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))


# The coefficients of algorithm AS 241 (PPND16) for the normal quantile, by
# ascending power: numerator, then denominator.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(coefficients, x: Column) -> Column:
    above, below = (reduce(lambda total, c: total * x + F.lit(c), reversed(p), F.lit(0.0)) for p in coefficients)
    return above / below


def normal_quantile(level: Column) -> Column:
    """The standard normal deviate of a probability strictly between 0 and 1, else null."""
    from_centre = level - 0.5
    root = F.sqrt(-F.log(F.least(level, 1 - level)))
    far = F.when(root <= 5.0, _ratio(TAIL, root - 1.6)).otherwise(_ratio(FAR_TAIL, root - 5.0))
    value = F.when(
        F.abs(from_centre) <= 0.425, from_centre * _ratio(CENTRE, F.lit(0.180625) - from_centre * from_centre)
    ).otherwise(F.when(from_centre < 0, -far).otherwise(far))
    return F.when((level > 0) & (level < 1), value)


def z_scores(rows: DataFrame, level: str) -> DataFrame:
    """Add `z` for a service level held in a column."""
    return rows.withColumn("z", normal_quantile(F.col(level).cast("double")))


def recipe_rows(policy: Policy) -> Column:
    """The recipe as an array of structs, to be expanded with `inline` (no join needed)."""
    return F.array(*[
        F.struct(
            F.lit(pos).alias("pos"),
            F.lit(ingredient).alias("ingredient"),
            F.lit(float(per_item)).alias("per_item"),
            F.lit(int(policy.lots.get(ingredient, 0))).alias("lot_size"),
            F.lit(policy.expiry_days(ingredient)).alias("expiry_days"),
            F.lit(int(policy.start_stock.get(ingredient, 0))).alias("start_stock"),
        )
        for pos, (ingredient, per_item) in enumerate(policy.recipe.items())
    ])


def with_recipe(rows: DataFrame, policy: Policy, *fields: str) -> DataFrame:
    """One row per input row and ingredient, with the named recipe fields."""
    fields = fields or ("ingredient", "per_item")
    expanded = rows.select("*", F.explode(recipe_rows(policy)).alias("_recipe"))
    return expanded.select(*rows.columns, *[F.col(f"_recipe.{f}").alias(f) for f in fields])
