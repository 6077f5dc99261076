"""Exact top-k by integer inner product with a pivot-distance index.

Components x become floor(256 * x). One more component gives all rows the same norm M, so the
largest inner product with a query (whose extra component is 0) is the smallest distance:
d^2 = |q|^2 + M^2 - 2 <q, x>. Rows are keyed by nearest pivot and by ring, a step of
their distance to it; the index knows the least and largest distance in each annulus. A query
first searches the annulus it lies in. Its k-th best product there is a floor: by the
triangle inequality no row of an annulus is nearer than its distance to the pivot lies outside the
annulus, and annuli whose bound is below the floor are not visited. The others are searched
whole. Sums of integer products are exact in double precision below 2^53.

Pivots and rings come from a bounded sample (the smallest hashes of vec_id); they decide where
rows go, never the result. An annulus with many rows is split by a hash of vec_id, so equal
vectors spread over several blocks.

Vectors that `usable` leaves out take no part. Rows that share a vec_id are one candidate with
the better product, and one query with the smaller vector. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import send, shared_value
from larder.llm.vectors import best_in_block, by_blocks, matrix, nearest_first, pieces_of, spread, usable
from larder.session import settle

FOUND = "query_id bigint, vec_id bigint, score double"


class Annuli:
    """Pivots (with their extra component), the common norm and the rings' edges."""

    def __init__(self, sample: np.ndarray, square: float, pivots: int, rings: int):
        self.square = square
        self.rings = rings
        self.pivots = np.unique(sample, axis=0)[:: max(1, len(np.unique(sample, axis=0)) // pivots)][:pivots]
        self.lift = np.sqrt(np.maximum(square - (self.pivots * self.pivots).sum(1), 0))
        distances = self.of_rows(sample)
        nearest, own = distances.argmin(1), distances.min(1)
        steps = np.linspace(0, 1, rings + 1)[1:-1]
        self.edges = np.array([np.quantile(own[nearest == p], steps) if (nearest == p).any() else np.zeros(rings - 1)
                               for p in range(len(self.pivots))])

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.square - (rows * rows).sum(1), 0))
        dots = rows @ self.pivots.T + lift[:, None] * self.lift
        return np.sqrt(np.maximum(2 * self.square - 2 * dots, 0))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        own = (queries * queries).sum(1)[:, None]
        return np.sqrt(np.maximum(own + self.square - 2 * queries @ self.pivots.T, 0))

    def place(self, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the annulus, and distance to its pivot."""
        nearest = distances.argmin(1)
        own = distances[np.arange(len(distances)), nearest]
        ring = (own[:, None] > self.edges[nearest]).sum(1)
        return nearest * self.rings + ring, own


def exact_top(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 16, rings: int = 4,
              sample: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score (bigint): the k largest inner products of every query."""
    whole = usable(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))
    spark = whole.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    largest, n_queries = whole.agg(F.max(square), F.count(F.when(is_query, 1))).first()
    if largest is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    drawn = whole.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    index = Annuli(np.array([r["v"] for r in drawn]), largest, pivots, rings)
    shared = send(spark, index)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                index = shared_value(shared)
                annulus, distance = index.place(index.of_rows(matrix(batch.column("v"))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(annulus, pa.int32()), pa.array(distance)],
                    names=["vec_id", "v", "annulus", "distance"])

    rows = settle(whole.distinct().mapInArrow(placed, "vec_id bigint, v array<double>, annulus int, distance double"), "annuli")
    # one row per annulus: at most pivots x rings
    extents = {r["annulus"]: (r["least"], r["most"], pieces_of(r["n"])) for r in rows.groupBy("annulus").agg(
        F.min("distance").alias("least"), F.max("distance").alias("most"), F.count(F.lit(1)).alias("n")).collect()}
    query_parts = pieces_of(n_queries)
    splits = F.element_at(F.create_map(*[F.lit(x) for a, (_, _, n) in extents.items() for x in (a, n)]), F.col("annulus"))
    row_side = rows.select("vec_id", "v", "annulus", spread(F.struct("vec_id", "v"), splits).alias("split"),
                           F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("part"))
    block = (F.col("annulus").cast("bigint") * (1 << 40) + F.col("split") * (1 << 20) + F.col("part")).alias("block")
    row_side = row_side.select(block, "vec_id", "v")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))

    def routed(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                data = matrix(batch.column("v"))
                index, floors = shared_value(shared), np.asarray(batch.column("floor"), float)
                distances = index.of_queries(data)
                home = nearest_home(index, distances, extents)
                squares = (data * data).sum(1)
                at, to, split = [], [], []
                for annulus, (least, most, n) in extents.items():
                    if first:
                        goes = home == annulus
                    else:
                        d = distances[:, annulus // index.rings]
                        gap = np.maximum(np.maximum(least - d, d - most) - 1e-6 * index.square**0.5 - 1e-9, 0)
                        goes = (home != annulus) & ((squares + index.square - gap * gap) / 2 + 1 >= floors)
                    chosen = np.flatnonzero(goes)
                    at.append(np.repeat(chosen, n))
                    to.append(np.full(len(chosen) * n, annulus))
                    split.append(np.tile(np.arange(n), len(chosen)))
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(np.concatenate(to), pa.int32()),
                     pa.array(np.concatenate(split), pa.int64())], names=["vec_id", "v", "annulus", "split"])
        return run

    def visited(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInArrow(routed(first), "vec_id bigint, v array<double>, annulus int, split bigint")
        sent = sent.withColumn("part", spread(F.col("vec_id"), query_parts)).select(block, "vec_id", "v")
        return by_blocks(row_side, sent, searcher(k), FOUND)

    home = settle(visited(queries.withColumn("floor", F.lit(float("-inf"))), True), "annuli")
    best = nearest_first(home, "double", k)
    floors = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    again = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select(
        "vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    return nearest_first(home.unionByName(visited(again, False)), "bigint", k)


def nearest_home(index: Annuli, distances: np.ndarray, extents: dict) -> np.ndarray:
    """The occupied annulus with the smallest gap to each query, first by number."""
    names = np.array(sorted(extents))
    least, most = (np.array([extents[a][i] for a in names]) for i in (0, 1))
    d = distances[:, names // index.rings]
    return names[np.maximum(np.maximum(least - d, d - most), 0).argmin(1)]


def searcher(k: int):
    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(mine) and len(asked):
            ids, data = np.asarray(mine["vec_id"]), matrix(mine["v"])
            order = np.argsort(ids, kind="stable")
            ids, data = ids[order], data[order]
            first = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
            ids = ids[first]
            asked_ids, asked_data = np.asarray(asked["vec_id"]), matrix(asked["v"])
            for start in range(0, len(asked_ids), 256):
                # the best of the vectors that share a vec_id
                products = np.maximum.reduceat(asked_data[start : start + 256] @ data.T, first, axis=1)
                for query, scores in zip(asked_ids[start : start + 256], products, strict=True):
                    other = ids != query
                    best = best_in_block(ids[other], scores[other], k)
                    found += zip([query] * len(best), ids[other][best], scores[other][best], strict=True)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    return search
