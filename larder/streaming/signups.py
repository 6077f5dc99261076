"""Signups: validated as they arrive, and one per address over the table's lifetime."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators.people import new_signups, valid_signups
from larder.streaming.runs import batch_name

BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64("email_lc"), F.lit(BUCKETS)).cast("int")


def register(signups: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append addresses not registered before, however late they come.

    The table is laid out by a hash of the address, then by batch: a batch reads the buckets
    its addresses fall in, of all other batches. One that is run again writes the same rows over;
    another checkpoint writes beside them.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch.sparkSession, checkpoint, batch_id)
        arrived = batch.withColumn("ts", F.col("ts").cast("timestamp")).persist()
        keyed = valid_signups(arrived).select(F.lower("email").alias("email_lc"))
        touched = [r.bucket for r in keyed.select(_bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS
        fresh = new_signups(arrived, _registered(batch, table, name, touched))
        placed = fresh.withColumns({"bucket": _bucket(), "batch": F.lit(name)}).repartition("bucket")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(table)
        arrived.unpersist()

    trigger = trigger or {"availableNow": True}
    return (
        signups.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _registered(batch: DataFrame, table: str, name: str, buckets: list[int]) -> DataFrame:
    spark = batch.sparkSession
    try:
        known = spark.read.parquet(table)
    except AnalysisException:  # nothing has landed yet
        return spark.createDataFrame([], "email string")
    return known.where(F.col("bucket").isin(buckets) & (F.col("batch") != name)).select("email")
