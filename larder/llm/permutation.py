"""Approximate nearest neighbours by cosine with a permutation index.

A vector is represented by its `prefix` nearest pivots in order of nearness. A block of rows
keeps an inverted file per pivot: the rows that have it in their prefix, with its place. A
query walks the files of its own pivots and sums, for every row met, min(prefix - place in
row, prefix - place in query); twice that sum is what the footrule distance of the two
prefixes (a missing pivot counts as place `prefix`) stays below its maximum. The rows with
the smallest footrule distances, a share of each block with all ties, are then ranked
by their exact cosine in double precision.

Pivots come from a bounded sample (the smallest hashes of vec_id); all rows are indexed. Rows
are dealt to blocks of about 8,192 by hash, so equal vectors spread like all others, and
every block of queries meets every block of rows.

Zero vectors take no part, nor do those that `usable` leaves out. Rows that share a vec_id
count once, with the smallest of their vectors. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import send, shared_value
from larder.llm.vectors import best_in_block, by_blocks, matrix, nearest_first, pieces_of, spread, usable

FOUND = "query_id bigint, vec_id bigint, score double"


class Pivots:
    def __init__(self, vectors: np.ndarray, prefix: int):
        norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        self.unit = vectors / norms
        self.prefix = min(prefix, len(vectors))

    def order(self, units: np.ndarray) -> np.ndarray:
        """The nearest pivots of each row, nearest first."""
        return np.argsort(-(units @ self.unit.T), axis=1, kind="stable")[:, : self.prefix]


class Files:
    """Inverted files of one block: by pivot, rows and what each is worth at most."""

    def __init__(self, order: np.ndarray, pivots: int):
        rows, places = np.indices(order.shape)
        flat = order.ravel()
        turn = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[turn], np.arange(1, pivots))
        self.rows = np.split(rows.ravel()[turn], cuts)
        self.worth = np.split((order.shape[1] - places.ravel()[turn]).astype(np.int32), cuts)
        self.size = len(order)

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """By row, half of what its footrule distance to the query is below the maximum."""
        total = np.zeros(self.size, np.int32)
        for place, pivot in enumerate(order):
            total[self.rows[pivot]] += np.minimum(self.worth[pivot], len(order) - place)
        return total


def unique_rows(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(np.unique(ids)) == len(ids):
        return ids, vectors
    order = np.lexsort((*vectors.T[::-1], ids))
    first = np.r_[True, np.diff(ids[order]) != 0]
    return ids[order][first], vectors[order][first]


def approximate_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 256, prefix: int = 32,
                           share: float = 0.25, least: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every query."""
    rows = usable(vectors).where(F.exists("v", lambda x: x != 0))
    spark = rows.sparkSession
    counts = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = send(spark, Pivots(np.array([r["v"] for r in chosen]), prefix))
    row_blocks, query_blocks = pieces_of(counts[0]), pieces_of(counts[1])

    def block(row: Column, query: Column) -> Column:
        return (row * query_blocks + query).cast("int").alias("block")

    query_side = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).select(
        "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("to"))
    query_side = query_side.select(block(F.col("to"), spread(F.col("vec_id"), query_blocks)), "vec_id", "v")
    row_side = rows.select(
        "vec_id", "v", spread(F.col("vec_id"), row_blocks).alias("own"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("to"))
    row_side = row_side.select(block(F.col("own"), F.col("to")), "vec_id", "v")

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(mine) and len(asked):
            index = shared_value(shared)
            ids, data = unique_rows(np.asarray(mine["vec_id"]), matrix(mine["v"]))
            units = data / np.sqrt((data * data).sum(1, keepdims=True))
            files = Files(index.order(units), len(index.unit))
            wanted = max(least, int(np.ceil(share * len(ids)))) + 1  # one for the query itself
            asked_ids, asked_data = np.asarray(asked["vec_id"]), matrix(asked["v"])
            asked_norms = np.sqrt((asked_data * asked_data).sum(1))
            for query, vector, norm, order in zip(
                asked_ids, asked_data, asked_norms, index.order(asked_data / asked_norms[:, None]), strict=True):
                near = files.nearness(order)
                edge = np.partition(near, len(near) - wanted)[len(near) - wanted] if len(near) > wanted else 0
                places = np.flatnonzero((near >= edge) & (ids != query))
                dots = (data[places] * vector).sum(1)
                scores = dots / (np.sqrt((data[places] * data[places]).sum(1)) * norm)
                best = best_in_block(ids[places], scores, k)
                found += zip([query] * len(best), ids[places][best], scores[best], strict=True)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    return nearest_first(by_blocks(row_side, query_side, search, FOUND), "double", k)
