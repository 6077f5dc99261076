"""Menu ideas for an ingredient: seeded or random picks from its pool.

The menu is a setting held by the policy, so a pool is a literal array. Picking works on
that array within the asking row: no join, no pair rows, no exchange.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.tables import Policy

FALLBACK = "_default"


def seeded_ideas(ingredient: str, policy: Policy) -> list[str]:
    """Seeded picks from the policy's own menu; a pool no larger than the wish is kept whole.

    They depend on three settings only, so planners treat them as literals.
    """
    pool = list(policy.menu.get(ingredient, policy.menu.get(FALLBACK, ())))
    wanted = policy.suggestion_count
    if len(pool) <= wanted:
        return pool
    picked = np.random.default_rng(policy.suggestion_seed).choice(len(pool), size=wanted, replace=False)
    return [pool[i] for i in picked]


def idea_text(ingredient: Column, policy: Policy) -> Column:
    """The seeded picks of each recipe line as text, chosen by an ingredient column."""
    text = F.lit(", ".join(seeded_ideas(FALLBACK, policy)))
    for name in policy.ingredients:
        text = F.when(ingredient == name, F.lit(", ".join(seeded_ideas(name, policy)))).otherwise(text)
    return text


def pool_name(ingredient: Column, policy: Policy) -> Column:
    """The ingredient's own pool, or `_default` where the menu has none."""
    known = [name for name in policy.menu if name != FALLBACK]
    return F.when(ingredient.isin(known), ingredient).otherwise(FALLBACK)


def pool_items(pool: Column, policy: Policy) -> Column:
    pools = [(F.lit(name), F.array(*map(F.lit, items))) for name, items in policy.menu.items() if items]
    return F.create_map(*[column for pair in pools for column in pair])[pool]


def hashed_ideas(asked: DataFrame, policy: Policy) -> DataFrame:
    """(*asked, ideas): picks by the hash rank of a `seed` column, the same on every engine.

    A pool of at most `suggestion_count` items is returned whole in menu order.
    """
    k = policy.suggestion_count
    rows = asked.withColumn("_pool", pool_name(F.col("ingredient"), policy)).withColumn(
        "_items", pool_items(F.col("_pool"), policy)
    )
    seed, pool = F.col("seed").cast("string"), F.col("_pool")
    ranked = F.sort_array(F.transform(
        "_items", lambda item: F.struct(F.md5(F.concat_ws("#", seed, pool, item)).alias("rank"), item.alias("item"))
    ))
    picked = F.when(F.size("_items") <= k, F.col("_items")).otherwise(F.slice(ranked.getField("item"), 1, k))
    return rows.withColumn("ideas", F.array_join(picked, ", ")).drop("_pool", "_items")


def random_ideas(asked: DataFrame, policy: Policy) -> DataFrame:
    """(*asked, items): random picks without replacement and without a seed."""
    pool = pool_items(pool_name(F.col("ingredient"), policy), policy)
    return asked.withColumn("items", F.slice(F.shuffle(pool), 1, policy.suggestion_count))
