"""What the two vector searches share: usable rows, blocks of rows against blocks of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part.

    Null vectors and ids, vectors that hold null or non-finite components and empty ones take
    no part; nor do vectors whose length isn't the most common one (the smaller of two).
    """
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    lengths = sound.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    return sound.where(F.size("v") == (lengths[0]["length"] if lengths else 0))


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length, at least one of them, as one array."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(chunk.flatten()) for chunk in chunks]).reshape(len(column), -1)


def by_blocks(rows: DataFrame, queries: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`search` for every block of rows and the queries sent there.

    Both sides have `block`; a block holds a bounded number of rows and of queries.
    """
    return rows.groupBy("block").cogroup(queries.groupBy("block")).applyInArrow(search, schema)


def spread(key: Column, parts: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts) if isinstance(parts, int) else parts)


def pieces_of(count: int, at_most: int = BLOCK_ROWS) -> int:
    return max(1, -(-count // at_most))


def nearest_first(found: DataFrame, score_type: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller vec_id."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").cast(score_type).alias("score"))


def best_in_block(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= edge)
    else:
        kept = np.arange(len(ids))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]
