"""Published tables: writes go to new snapshot folders and become visible when complete.

A table folder holds `snapshot=<id>` folders and a small `published` log. Readers look up
logged ids only, so they never see a half-written snapshot, and a job that lost executors
or was retried leaves at most an unlogged folder behind. Ids sort by age.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.spine import whole_series
from larder.session import settle

BUCKETS = 256
BASE_ID = "0"


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/published")
    except AnalysisException:
        return None


def publish(table: DataFrame, path: str, snapshot: str, *partitions: str) -> None:
    """Write the whole table as a snapshot, then log it."""
    table.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/snapshot={snapshot}")
    log = table.sparkSession.range(1).select(F.lit(snapshot).alias("id"))
    log.write.mode("append").parquet(f"{path}/published")


def read_latest(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The newest published snapshot, or an empty typed table, or None without a schema."""
    log = _log(spark, path)
    newest = None if log is None else log.agg(F.max("id")).first()[0]
    if newest is None:
        return None if schema is None else spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/snapshot={newest}")


# --- tables replaced series by series ---------------------------------------------------

UPLOAD = "upload"


def newest_upload(rows: DataFrame) -> DataFrame:
    """Of every series the rows of its newest upload; a day given twice in one is summed.

    Upload names sort by age; rows without one are older than any, rows without a series are left out. One exchange by day, after which a
    series has a row per day and upload, and one by series.
    """
    named = rows if UPLOAD in rows.columns else rows.withColumn(UPLOAD, F.lit(""))
    named = named.where(F.col("series").isNotNull()).withColumn(UPLOAD, F.coalesce(UPLOAD, F.lit("")))
    summed = named.groupBy("series", "date", UPLOAD).agg(F.sum("qty_sold").alias("qty_sold"))
    newest = summed.withColumn("_newest", F.max(UPLOAD).over(whole_series()))
    return newest.where(F.col(UPLOAD) == F.col("_newest")).select("series", "date", "qty_sold", UPLOAD)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.col("series").cast("string")), F.lit(buckets)).cast("int")


def _series_log(spark: SparkSession, path: str, writing: str | None = None) -> DataFrame | None:
    """(id, bucket, turn) of the landed snapshots; while one is written, those before it."""
    log = _log(spark, path)
    if log is None or writing is None:
        return log
    own = log.where(F.col("id") == writing).agg(F.min("turn")).first()[0]
    return log if own is None else log.where(F.col("turn") < own)


def _read_buckets(spark: SparkSession, path: str, log: DataFrame | None, only=None) -> DataFrame | None:
    if log is None:
        return None
    newest = log.groupBy("bucket").agg(F.max_by("id", "turn").alias("id")).collect()  # one row per bucket
    folders = [f"{path}/snapshot={r.id}/bucket={r.bucket}" for r in newest if only is None or r.bucket in only]
    return spark.read.parquet(*folders) if folders else None


def read_series(spark: SparkSession, path: str) -> DataFrame | None:
    """The current rows (series, date, qty_sold): each bucket's newest snapshot."""
    rows = _read_buckets(spark, path, _series_log(spark, path))
    return None if rows is None else rows.select("series", "date", "qty_sold")


def upsert_series(upload: DataFrame, path: str, snapshot: str, buckets: int | None = None) -> None:
    """Merge an upload: of every series the newest upload stays. Only touched buckets are rewritten.

    The number of buckets is chosen when the table is made (BUCKETS if not given) and kept in
    its log. Snapshots are ordered by the turn they landed in; the same id again is the
    same snapshot written over, from what stood before it. The upload is settled: which buckets it
    touches has to be known before it is merged, in one pass with the rows that stand there.
    """
    spark = upload.sparkSession
    log = _log(spark, path)
    made_with = None if log is None else log.agg(F.max("buckets")).first()[0]
    if made_with is not None and buckets not in (None, made_with):
        raise ValueError(f"the table has {made_with} buckets, not {buckets}")
    buckets = made_with or buckets or BUCKETS
    landed = None if log is None else log.agg(F.max("turn"), F.max(F.when(F.col("id") == snapshot, F.col("turn")))).first()
    turn = 0 if landed is None else landed[1] if landed[1] is not None else landed[0] + 1
    if UPLOAD not in upload.columns and snapshot != BASE_ID:  # newer than what has landed
        age = F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSS")
        upload = upload.withColumn(UPLOAD, F.concat_ws("|", age, F.lit(snapshot)))
    named = [c for c in ("series", "date", "qty_sold", UPLOAD) if c in upload.columns]
    arrived = settle(upload.where(F.col("series").isNotNull()).select(*named, _bucket(buckets).alias("bucket")), "arrived")
    touched = [r.bucket for r in arrived.select("bucket").distinct().collect()]  # at most `buckets` rows
    if touched:
        current = _read_buckets(spark, path, _series_log(spark, path, snapshot), set(touched))
        rows = arrived.drop("bucket")
        merged = newest_upload(rows if current is None else current.unionByName(rows, allowMissingColumns=True))
        # ranges end within a long series too, and a task writes to few buckets
        spread = merged.withColumn("bucket", _bucket(buckets)).repartitionByRange("bucket", "series", "date")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/snapshot={snapshot}")
        if landed is None or landed[1] is None:
            entries = spark.createDataFrame(
                [(snapshot, b, turn, buckets) for b in touched], "id string, bucket int, turn bigint, buckets int")
            entries.coalesce(1).write.mode("append").parquet(f"{path}/published")


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
