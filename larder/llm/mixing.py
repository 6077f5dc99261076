"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order, null last, get the weights in turn. Together they get `share`
times all words; a source's target stops at `most` times its own words and the excess goes to
the others by weight until none is above. As many complete epochs as fit come first. The rest
is drawn without replacement: a document with quality weight w and a uniform number u fixed
by its id has the exponential key -ln(u) / w, and documents are taken in key order until the
words are used up; the one at the border gives only the words that are left.

No source is sorted as a whole. Keys are dealt to `bins` equal steps of 1 - exp(-key), the
bins are summed, a running total over a source's bins finds the one where the words run out,
and only that bin's documents are put in order.

Null text counts 0 words and is never taken. Null is a source of its own. Rows that share a
doc_id are separate documents; equal keys are ordered by doc_id, then size, and rows that
agree in those are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import record, slices, texts, with_kept
from larder.session import settle

SUSPECT = bytes(set(range(33, 127)) - set(b"'\",.;:!?()-") - set(range(65, 91)) - set(range(97, 123)))
LEAST_QUALITY = 0.05


def measured(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size (words), quality (share of bytes that aren't digits or symbols); then
    the columns to keep."""
    schema = with_kept(docs, keep, "doc_id bigint, source string, size bigint, quality double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = [(text or "").encode("utf-8", "replace") for text in batch.column("text").to_pylist()]
            clean = [len(raw.translate(None, SUSPECT)) / len(raw) if raw else 1.0 for raw in raws]
            yield record(schema, [
                batch.column("doc_id"), batch.column("source"), pa.array([len(raw.split()) for raw in raws], pa.int64()),
                pa.array(np.maximum(clean, LEAST_QUALITY), pa.float64())], batch, keep)

    more = [name for name in keep if name != "text"]
    return texts(docs.withColumn("source", F.col("source").cast("string")), "source", *more).mapInArrow(run, schema)


def source_key() -> Column:
    """Sorts as the source does, with null last."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))


def targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """key, source_size, target: one row per source.

    With sources in order of most * size / weight, those in front are full. The level per
    unit of weight follows from running totals; a source is full if its limit is not above it, and the first that is not sets the level.
    """
    sources = sized.groupBy(source_key().alias("key")).agg(F.sum("size").alias("source_size"))
    # one short row per source: the only unpartitioned windows here
    place = (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    limit = F.col("source_size") * float(most)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("full_at", "key").rowsBetween(Window.unboundedPreceding, -1)
    levels = sources.select("key", "source_size", weight.alias("weight"), limit.alias("limit")).withColumn(
        "full_at", F.col("limit") / F.col("weight")
    ).withColumn(
        "left", F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ).withColumn(
        "level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ).withColumn("full", F.col("full_at") <= F.col("level"))
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return levels.select(
        "key", "source_size",
        F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), rest * F.col("weight"))).alias("target"))


def mix(sized: DataFrame, weights: Sequence[float], share: float, most: float, seed: str = "mix",
        bins: int = 65536) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of `sized`."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = sized.select(
        "doc_id", "source", "size", source_key().alias("key"),
        (-F.log(uniform) / F.col("quality")).alias("turn"),
    ).withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("turn"))) * bins), F.lit(bins - 1)).cast("int"))
    drawn = settle(drawn, "mixing")
    goals = targets(drawn, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("epochs", epochs.cast("bigint")).withColumn(
        "rest", F.round("target").cast("bigint") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("key").orderBy("bin")
    running = drawn.groupBy("key", "bin").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    border = running.join(goals, "key").where(F.col("upto") > F.col("rest")).groupBy("key").agg(
        F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("before")), "bin").alias("border"))
    goals = settle(goals.join(border, "key", "left").select(
        "key", "source_size", "target", "epochs", "rest",
        F.coalesce("border.bin", F.lit(bins)).alias("border_bin"), F.coalesce("border.before", F.lit(0)).alias("before")), "mixing")
    rows = drawn.join(goals, "key")
    base = F.col("epochs") * F.col("size")
    kept = ("doc_id", "source", "size", "source_size", "target")
    clear = rows.where(F.col("bin") != F.col("border_bin")).select(
        *kept, (base + F.when(F.col("bin") < F.col("border_bin"), F.col("size")).otherwise(0)).alias("taken"))
    ahead = Window.partitionBy("key").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(ahead), F.lit(0))
    edge = rows.where(F.col("bin") == F.col("border_bin")).withColumn("room", room).select(
        *kept, (base + F.least(F.col("size"), F.greatest(F.col("room"), F.lit(0)))).alias("taken"))
    return clear.unionByName(edge)
