"""Product codes for vectors, trained by rounds over exact integers (LAESA pivots).

Components become integers floor(scale * x). A vector is cut into equal consecutive parts; each
part position has a codebook that starts as that part of the first vectors by id. A round
gives every part its nearest entry (squared Euclidean distance, ties to the lower index), then
an entry becomes the componentwise floor of its parts' mean; unused entries stay. After the
last round all parts get their entries once more.

Some of the first entries are fixed pivots (each the farthest from those before it). A part's
distances to them are worked out once and stored beside it. A round needs the entries'
distances to the pivots only: by the triangle inequality |d(part, pivot) - d(entry, pivot)|
bounds a part's distance to an entry from below. Parts are searched in blocks that lie alike to the
pivots; a block takes the entries by rising bound, a few at a time, works these distances out
exactly, and stops as soon as the next bound exceeds the largest of its nearest distances.

A round is one pass over the stored rows: a task sends count and sums of every entry it used,
so at most parts * entries rows whatever it read, and the driver holds the codebooks (parts *
entries * length, whatever the table's size). Nothing is grouped by vector.

Null vectors and those that hold null or non-finite components are dropped. Empty vectors stay: their
parts are equal. Vectors of different lengths, lengths that don't divide into parts and
components of 2^26 and more after scaling have no defined codes: they raise a ValueError.
Null ids sort last; rows that share an id sort by their components; all of them get codes.
With fewer vectors than entries the codebook is that short. An empty table gives an empty
result. Other columns, whatever their names, stay behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices
from larder.session import settle

LARGEST = 1 << 26
EXACT_IN_DOUBLE = float(1 << 53)
BLOCK = 512
STEP = 64
ROWS = 8192
SALTS = 32


class Book:
    """A codebook of one part position, and its entries' distances to the fixed pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots
        self.to_pivots = pivot_distances(entries, pivots)

    def nearest(self, parts: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part's nearest entry, and the squared distance."""
        index, least = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        home = to_pivots.argmin(1)
        order = np.lexsort((to_pivots[np.arange(len(parts)), home], home))
        for start in range(0, len(order), BLOCK):
            rows = order[start : start + BLOCK]
            index[rows], least[rows] = self.nearest_of_block(parts[rows], to_pivots[rows])
        return index, least

    def nearest_of_block(self, parts: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = to_pivots.min(0), to_pivots.max(0)
        # stored distances are rounded: the bound gives way by more than that
        slack = 1e-5 * (self.to_pivots + high)
        bound = np.maximum(np.maximum(self.to_pivots - high, low - self.to_pivots) - slack, 0.0).max(1)
        turn = np.argsort(bound, kind="stable")
        least = np.full(len(parts), np.iinfo(np.int64).max)
        index = np.full(len(parts), len(turn))
        for start in range(0, len(turn), STEP):
            if start and bound[turn[start]] > np.sqrt(float(least.max())) * (1 + 1e-9):
                break
            tried = np.sort(turn[start : start + STEP])
            squares = squared_distances(parts, self.entries[tried])
            best = squares.argmin(1)
            found, at = squares[np.arange(len(parts)), best], tried[best]
            closer = (found < least) | ((found == least) & (at < index))
            least[closer], index[closer] = found[closer], at[closer]
        return index, least


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; in doubles where these hold every step exactly."""
    largest = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 4 * max(a.shape[1], 1) * largest * largest < EXACT_IN_DOUBLE:
        a, b = a.astype(np.float64), b.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((a - entry) ** 2).sum(1) for entry in b], 1)


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(squared_distances(parts, pivots).astype(np.float64))


def far_apart(entries: np.ndarray, count: int) -> np.ndarray:
    """The first entry, then always the one farthest from all chosen so far."""
    chosen, away = [0], squared_distances(entries, entries[:1])[:, 0]
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, squared_distances(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def integers(vectors: DataFrame, scale: int, keep: tuple[str, ...]) -> DataFrame:
    """vec_id, v (array<double> of whole numbers) and the columns to keep, of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), *keep).where(F.col("v").isNotNull() & ~odd)
    # the product of a finite double can overflow; it stays out of range then, which is refused
    return sound.withColumn("v", F.transform("v", lambda x: whole(x * scale)))


def whole(x: Column) -> Column:
    """floor, as a double (the integer function saturates)."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def matrix(column: pa.Array, parts: int, length: int) -> np.ndarray:
    """Rows of a list column, all of one length and in range, as integers."""
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes != length).any():
        raise ValueError(f"all vectors must have {length} components")
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    values = np.asarray(column.flatten(), np.float64)
    if len(values) and not np.abs(values).max() < LARGEST:
        raise ValueError(f"scaled components must be below {LARGEST}")
    return values.astype(np.int64).reshape(len(column), parts, length // parts)


def started(rows: DataFrame, parts: int, entries: int, pivots: int) -> list[Book]:
    """The first codebooks; at most `entries` rows come to the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return []
    listed = pa.array([r["v"] for r in first], pa.list_(pa.float64()))
    table = matrix(listed, parts, len(first[0]["v"]))
    return [Book(table[:, p], far_apart(table[:, p], pivots)) for p in range(parts)]


def prepared(rows: DataFrame, books: list[Book], keep: tuple[str, ...]) -> DataFrame:
    """vec_id, v (packed integers), near (packed distances of every part to the pivots), columns to keep."""
    parts, length = len(books), len(books) * books[0].entries.shape[1]
    pivots = [book.pivots for book in books]
    schema = rows.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            table = matrix(batch.column("v"), parts, length)
            near = np.concatenate([pivot_distances(table[:, p], pivots[p]) for p in range(parts)], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), *(packed(a) for a in (table.reshape(len(batch), -1).astype(np.int32), near.astype(np.float32))),
                 *(batch.column(name) for name in keep)], names=["vec_id", "v", "near", *keep])

    fields = "vec_id bigint, v binary, near binary"
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return settle(rows.select("vec_id", "v", *keep).mapInArrow(run, fields + more), "quantiser")


def packed(values: np.ndarray) -> pa.Array:
    """A row of numbers per binary value."""
    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def assigned(batch: pa.RecordBatch, books: list[Book]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every part position: the parts, their entries and squared distances."""
    length = books[0].entries.shape[1]
    table = unpacked(batch.column("v"), np.int32, len(books) * length).astype(np.int64)
    near = unpacked(batch.column("near"), np.float32, sum(len(book.pivots) for book in books)).astype(np.float64)
    at = 0
    for p, book in enumerate(books):
        parts = table[:, p * length : (p + 1) * length]
        yield parts, *book.nearest(parts, near[:, at : at + len(book.pivots)])
        at += len(book.pivots)


def moved(rows: DataFrame, books: list[Book]) -> list[Book]:
    """The codebooks after one round."""
    length = books[0].entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(book.entries), np.int64) for book in books]
        total = [np.zeros(book.entries.shape, np.int64) for book in books]
        for batch in slices(batches, ROWS):
            for p, (parts, index, _) in enumerate(assigned(batch, books)):
                count[p] += np.bincount(index, minlength=len(count[p]))
                np.add.at(total[p], index, parts)
        for p, book in enumerate(books):
            used = np.flatnonzero(count[p])
            if len(used):
                sums = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * length, total[p][used].ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[p][used]), sums],
                    names=["part", "entry", "n", "total"])

    sent = rows.select("v", "near").mapInArrow(run, "part int, entry int, n bigint, total array<bigint>")
    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(length)]
    table = [book.entries.copy() for book in books]
    for row in sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        table[row["part"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(length)]
    return [Book(entries, book.pivots) for entries, book in zip(table, books, strict=True)]


def digest(books: list[Book]) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    listed = (str(x) for book in books for x in book.entries.ravel().tolist())
    return hashlib.sha256(",".join(listed).encode()).hexdigest()


def quantise(vectors: DataFrame, parts: int = 4, entries: int = 256, scale: int = 1024, rounds: int = 4, pivots: int = 8,
             keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[Book]]:
    """vec_id, indexes (array<int>), error (bigint) and the columns to keep; and the codebooks."""
    rows = integers(vectors, scale, keep)
    books = started(rows, parts, entries, pivots)
    fields = "vec_id bigint, indexes array<int>, error bigint"
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    if not books:
        return rows.sparkSession.createDataFrame([], fields + more), books
    stored = prepared(rows, books, keep)
    for _ in range(rounds):
        books = moved(stored, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            index, error = zip(*((i, e) for _, i, e in assigned(batch, books)), strict=True)
            codes = np.stack(index, 1).astype(np.int32)
            listed = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * parts, codes.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), listed, pa.array(sum(error)), *(batch.column(name) for name in keep)],
                names=["vec_id", "indexes", "error", *keep])

    return stored.mapInArrow(run, fields + more), books


def with_group_error(coded: DataFrame, group: str) -> DataFrame:
    """Adds `label_error`, the error summed over rows that agree in `group` (nulls agree).

    Sums are partially aggregated; then rows meet their sum in one of several copies of it, so that
    a group that holds a third of all rows is spread."""
    coded = settle(coded, "codes")
    totals = coded.groupBy(F.col(group).alias("g")).agg(F.sum("error").alias("label_error"))
    copies = totals.withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "indexes"), F.lit(SALTS)).cast("int"))
    met = salted.join(copies, F.col(group).eqNullSafe(F.col("g")) & (F.col("salt") == F.col("s")))
    return met.select(*coded.columns, "label_error")
