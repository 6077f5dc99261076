"""Names of micro-batches that no other stream shares."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def batch_name(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """The stream's own id, which Spark keeps in its checkpoint, and the batch's number."""
    stream = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
    return f"{stream}-{batch_id:012d}"
