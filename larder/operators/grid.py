"""Series as rows of arrays, for the few operators whose state runs from day to day.

`nest` turns a series into one row of date-ordered arrays (its length is bounded by the
calendar). A fold then steps through the days once, for all series of an Arrow batch
together: state is a numpy vector with one entry per series, so the Python cost is per
day and batch, not per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nest(rows: DataFrame, values: list[str], order: str = "date") -> DataFrame:
    """One row per series: `n` and the named columns as arrays in date order.

    Rows already partitioned by series are gathered in place, without another exchange.
    """
    ordered = F.sort_array(F.collect_list(F.struct(order, *[v for v in values if v != order])))
    gathered = rows.groupBy("series").agg(ordered.alias("_days"))
    return gathered.select(
        "series",
        F.size("_days").alias("n"),
        *[F.col(f"_days.{v}").alias(v) for v in values],
    )


def unnest(nested: DataFrame, arrays: list[str], keep: list[str] = ()) -> DataFrame:
    """Arrays of equal length back to rows, with the 0-based position as `step`."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    rows = nested.select("series", *keep, F.posexplode(zipped).alias("step", "_day"))
    return rows.select("series", *keep, "step", *[F.col(f"_day.{a}").alias(a) for a in arrays])


def matrix(column: pa.Array, dtype=np.float64, fill=0) -> np.ndarray:
    """A list column as a (rows x longest) matrix, short rows padded at the end."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    grid = np.full((len(lengths), width), fill, dtype=dtype)
    grid[np.arange(width) < lengths[:, None]] = flat
    return grid


def lists(grid: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The inverse of `matrix`. Trailing axes are flattened into each row's list."""
    per_step = int(np.prod(grid.shape[2:], dtype=int))
    rows = grid.reshape(len(grid), -1)
    counts = np.asarray(lengths, dtype=np.int64) * per_step
    flat = rows[np.arange(rows.shape[1]) < counts[:, None]]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


class Segments:
    """The recipe lines of a batch of series, one after the other, in arrays over all lines."""

    def __init__(self, column: pa.Array):
        self.width = np.asarray(column.value_lengths(), np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.row = np.repeat(np.arange(len(self.width)), self.width)
        self.place = np.arange(len(self.row)) - self.begin[self.row]

    def flat(self, column: pa.Array, dtype=np.float64) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(dtype)

    def of(self, by_row: np.ndarray) -> np.ndarray:
        """A value per series for each of its lines."""
        return by_row[self.row]

    def least(self, by_line: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(by_line, self.begin)

    def most(self, by_line: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(by_line, self.begin)

    def largest(self, by_line: np.ndarray) -> np.ndarray:
        """The place of each series' largest value, the first of equal ones."""
        return self.least(np.where(by_line == self.of(self.most(by_line)), self.place, len(by_line)))

    def ranked(self, by_line: np.ndarray) -> np.ndarray:
        """Lines by series, largest value first, equal ones in recipe order."""
        return np.lexsort((self.place, -by_line, self.row))

    def lists(self, by_day: np.ndarray, days: np.ndarray) -> pa.Array:
        """(days x lines) -> a list per series, day after day."""
        counts = np.asarray(days, np.int64) * self.width
        begins = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(row)) - begins[row]
        flat = by_day[at // self.width[row], self.begin[row] + at % self.width[row]]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))


def days_of(column: str, width: Column) -> Column:
    """A list of days times lines as one list per day."""
    return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.slice(column, i * width + 1, width))


def fold(
    nested: DataFrame,
    step: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    outputs: dict[str, T.DataType],
    batch_rows: int = 256,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `step` computes for each batch of series, after those to keep (all if not given)."""
    kept = nested.columns if keep is None else keep
    schema = T.StructType([nested.schema[k] for k in kept] + [T.StructField(k, v) for k, v in outputs.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                added = step(batch)
                yield pa.RecordBatch.from_arrays(
                    [*[batch[k] for k in kept], *[added[k] for k in outputs]],
                    names=[*kept, *outputs],
                )

    return nested.mapInArrow(run, schema)


LONGS = T.ArrayType(T.LongType())
DOUBLES = T.ArrayType(T.DoubleType())
