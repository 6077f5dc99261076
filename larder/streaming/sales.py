"""Sales drops: validate, quarantine, and replace the touched series as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.sources.published import UPLOAD, upsert_series
from larder.sources.sales import field, file_lines, good_rows, rejected_rows, validate, with_own_header
from larder.streaming.runs import batch_name

DROP_COLUMNS = ("series", "date", "qty_sold")


def read_drops(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the lines of CSV drops, each with its file."""
    return file_lines(spark.readStream.option("maxFilesPerTrigger", files_at_once), folder)


def dropped_rows(lines: DataFrame) -> DataFrame:
    """series, date, qty_sold, upload of each line, bound by its own file's header.

    A file is an upload, named by its time and path, unless a column `upload` names a larger
    one that spans several files. What a header lacks is null and goes to quarantine.
    """
    rows = with_own_header(lines)
    of_file = F.concat_ws("|", F.date_format("written", "yyyyMMddHHmmssSSS"), F.col("file"))
    header, record = F.col("header"), F.col("record")
    named = field(header, record, UPLOAD)
    return rows.select(*[field(header, record, c).alias(c) for c in DROP_COLUMNS], F.coalesce(named, of_file).alias(UPLOAD), "file")


def ingest(drops: DataFrame, table: str, quarantine: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Merge each micro-batch into the published sales table.

    Of every series the newest upload stays, however the files fall into batches. Snapshot ids
    and quarantine folders carry the stream's id and the batch's: a batch that is run again
    after a failure writes the same result over, and another checkpoint never does. A table loaded
    beforehand is published under `BASE_ID`; its rows are older than any drop.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        checked = validate(dropped_rows(batch), by="file").persist()
        error = F.when(F.col("series").isNull(), "no series").otherwise(F.col("error"))
        judged = checked.withColumn("error", error)
        name = batch_name(batch.sparkSession, checkpoint, batch_id)
        rejected_rows(judged).write.mode("overwrite").parquet(f"{quarantine}/batch={name}")
        upsert_series(good_rows(judged).select(*DROP_COLUMNS, UPLOAD), table, name)
        checked.unpersist()

    trigger = trigger or {"availableNow": True}
    return (
        drops.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
