"""What each filter removes under every order of the filters (min-plus removal ranks).

A row's failures are a mask. M has a row per mask with 0 where a filter fails and infinity
elsewhere; P has a row per filter and a column per order: the filter's place in it, which is the
inverse permutation. Their min-plus product min over f of M[mask, f] + P[f, order] is
the step at which an order removes the rows of a mask. Weighted counts of the masks are scattered
to these steps; whatever a filter fails at a later step than that is redundant.

Only counts by part and mask reach this stage (2^filters rows a part, partially aggregated), so
its size doesn't depend on how many rows there are, nor on how many of them one part holds.

`failures` measures documents. Null text is empty, null lang the part ''. A document fails E if
the same text has a smaller doc_id anywhere in the table; rows of equal doc_id aren't smaller,
and null ids are neither smaller than others nor fail. Documents without a label row count as
neither good nor toxic; of several label rows of an id any may say so. Texts are compared by
their SHA-256: rows become counts per (text, part, label) before texts meet, so a text that a
third of all rows share is one row per part and label. Very long texts are only hashed and
measured where they lie. An empty table gives an empty result. Other columns stay behind.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
SALTS = 1024


def removal_steps(count: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of `count` filters, and by mask and order the step that removes (infinite: none)."""
    orders = list(itertools.permutations(range(count)))
    place = np.argsort(np.array(orders), axis=1).T + 1.0  # filter, order
    masks = np.arange(1 << count)[:, None] >> np.arange(count) & 1
    fails = np.where(masks == 1, 0.0, np.inf)
    return orders, (fails[:, :, None] + place[None, :, :]).min(1)


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `counts`: part, mask (bit i: fails names[i]), n, good, toxic. One row per part, order and step.
    """
    size = len(names)
    orders, step = removal_steps(size)
    steps = np.arange(1, size + 1)
    at = step[:, :, None] == steps  # mask, order, step
    letter = np.array(orders)  # order, step
    failing = (np.arange(1 << size)[:, None] >> np.arange(size) & 1).astype(bool)
    redundant = failing[:, letter] & (step[:, :, None] < steps)
    spelled = ["".join(names[i] for i in order) for order in orders]

    def of_part(key: tuple, table: pa.Table) -> pa.Table:
        weight = np.zeros((3, 1 << size), np.int64)
        masks = np.asarray(table.column("mask"))
        for row, name in enumerate(("n", "good", "toxic")):
            np.add.at(weight[row], masks, np.asarray(table.column(name)))
        removed, good, toxic = (np.tensordot(w, at, 1) for w in weight)
        kept = weight[0].sum() - removed.cumsum(1)
        alone = weight[0][1 << np.arange(size)]
        shapley = np.zeros(size, np.int64)
        np.add.at(shapley, letter, removed)
        cells = len(orders) * size
        columns = [kept, removed, np.tensordot(weight[0], redundant, 1), alone[letter], good, toxic, shapley[letter]]
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()] * cells, pa.string()), pa.array(np.repeat(spelled, size).tolist(), pa.string()),
             pa.array(np.tile(steps, len(orders)).astype(np.int32)), *(pa.array(c.ravel()) for c in columns)],
            names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    schema = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
              "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")
    return counts.groupBy("part").applyInArrow(of_part, schema)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, print (of the text), mask (A to D) for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    split = named.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    fails = [words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))
    return split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("print"), mask.alias("mask"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E), n, good, toxic."""
    told = labels.groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = measured(docs)
    # null ids meet no label: the second key spreads them
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("print"), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
    labelled = rows.withColumn("salt", spread).join(
        told.withColumn("l_salt", F.lit(0).cast("bigint")), (F.col("doc_id") == F.col("l_id")) & (F.col("salt") == F.col("l_salt")), "left")
    kind = ("print", "part", "mask", "good", "toxic")
    ids = labelled.withColumns({name: F.coalesce(name, F.lit(0)) for name in ("good", "toxic")}).groupBy(
        "doc_id", "salt", *kind).agg(F.count(F.lit(1)).alias("n"))
    no_id = F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(no_id).alias("no_id"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("print"))
    passing = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = groups.withColumn("first", first).withColumn("ok", passing).select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("ok").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("ok")).alias("n")))).alias("c"))
    return both.groupBy("part", "c.mask").agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))
