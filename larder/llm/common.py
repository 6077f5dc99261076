"""What the operators share: inputs, Arrow batches and words."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads; others, whatever their names, stay behind."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *(F.col(name) for name in more))


def with_kept(docs: DataFrame, keep: Sequence[str], fields: str) -> T.StructType:
    """The fields an operator adds, then the columns of `docs` that it carries along."""
    return T.StructType([*T.StructType.fromDDL(fields), *(docs.schema[name] for name in keep)])


def record(schema: T.StructType, columns: Sequence, batch: pa.RecordBatch, keep: Sequence[str]) -> pa.RecordBatch:
    """New columns followed by the kept ones of the same rows."""
    return pa.RecordBatch.from_arrays([*columns, *(batch.column(name) for name in keep)], names=schema.names)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a function makes of one stays small."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def words(text: str | None) -> list[bytes]:
    """Lower-case (A-Z only) words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def send(session: SparkSession, value) -> Broadcast:
    """Broadcasts a value of bounded size; its classes travel by value, as functions do."""
    return session.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})


def shared_value(shared: Broadcast):
    """The value, unpacked once per worker process and kept as long as that lives."""
    held = shared.value
    if "value" not in held:
        held["value"] = pickle.loads(held["packed"])
    return held["value"]


class Recipe:
    """What to make where the value arrives; only for things of bounded size, such as a
    vocabulary and a cache with a fixed capacity."""

    def __init__(self, make: Callable, *args):
        self.make, self.args, self.made = make, args, None

    def get(self):
        if self.made is None:
            self.made = self.make(*self.args)
        return self.made


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of every value (wraps around by design)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
