import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import annuli, vectors
from larder.llm.annuli import exact_top
from larder.llm.common import table
from larder.llm.permutation import approximate_neighbours
from larder.llm.registry import ORACLES, op4_neighbours, op6_top_products
from tests.conftest import SF

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, block int"


def is_query():
    return F.col("vec_id") % 5 == 0


@pytest.fixture
def embeddings(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0, "v", 1) for i, v in rows], SCHEMA)


def odd_rows():
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(20)]  # equal vectors
    rows += [(300, None), (305, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (310, [float("nan")] * 6), (315, [float("inf")] + [0.0] * 5)]
    rows += [(320, [0.0] * 6), (325, []), (330, [1.0, 2.0]), (None, [1.0] * 6)]
    return rows + [rows[0], rows[0], rows[7]]


def sound(rows, zero):
    kept = {}
    for i, v in rows:
        if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all() and (zero or any(v)):
            kept[i] = np.array(v, np.float32).astype(float)
    return kept


def brute(rows, measure, k=5):
    out = []
    for q in rows:
        if q % 5 == 0:
            scored = sorted(((-measure(rows[q], v), i) for i, v in rows.items() if i != q))[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("pivots", "rings"), [(1, 1), (4, 3), (16, 4)])
def test_exact_products(embeddings, pivots, rings):
    rows = odd_rows()
    whole = {i: np.floor(256 * v) for i, v in sound(rows, True).items()}
    found = exact_top(embeddings(rows), is_query(), pivots=pivots, rings=rings).collect()
    assert sorted(map(tuple, found)) == brute(whole, lambda a, b: int(a @ b))


def test_cosine_with_every_row_ranked(embeddings):
    rows = odd_rows()
    wanted = brute(sound(rows, False), lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9))
    found = approximate_neighbours(embeddings(rows), is_query(), share=1.0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found) == wanted


@pytest.mark.parametrize("search", [exact_top, approximate_neighbours])
def test_few_rows(embeddings, search):
    assert search(embeddings([]), is_query()).collect() == []
    assert search(embeddings([(5, None), (6, [None])]), is_query()).collect() == []
    assert search(embeddings([(5, [1.0])]), is_query()).collect() == []
    assert [(r.query_id, r["rank"], r.vec_id) for r in search(embeddings([(5, [1.0]), (7, [2.0])]), is_query()).collect()] == [(5, 1, 7)]


def test_top_products_against_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    wanted = duck.execute(ORACLES["op6_top_products"]).fetchall()
    assert sorted(map(tuple, op6_top_products(spark, SF).collect())) == sorted(wanted)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    rows = {r.vec_id: np.array(r.embedding) for r in table(spark, sf, "embeddings").collect()}
    ids, data = np.array(list(rows)), np.array(list(rows.values()))
    units = data / np.linalg.norm(data, axis=1, keepdims=True)
    found = {}
    for r in op4_neighbours(spark, sf).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    queries = [i for i in rows if i % 50 == 0]
    assert sorted(found) == sorted(queries)
    hits = 0
    for q in queries:
        scores = units @ units[ids == q][0]
        scores[ids == q] = -2
        best = ids[np.argsort(-scores, kind="stable")[:5]]
        hits += len(set(best.tolist()) & set(found[q]))
        assert all(abs(scores[ids == i][0] - s) < 1e-9 for i, s in found[q].items())
    assert hits >= 0.9 * 5 * len(queries)


def test_one_id_with_a_third_of_all_rows(embeddings, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in [*range(60), *[3] * 30]]
    rows += [rows[3]] * 30
    blocks, emitted = [], []
    monkeypatch.setattr(annuli, "pieces_of", lambda count: max(1, -(-count // 20)))

    def by_blocks(row_side, query_side, each, schema):
        blocks[:] = ((r["block"], r.vec_id, tuple(r.v)) for r in row_side.collect())
        found = vectors.by_blocks(row_side, query_side, each, schema)
        emitted.extend(r["n"] for r in found.groupBy("query_id").count().withColumnRenamed("count", "n").collect())
        return found

    monkeypatch.setattr(annuli, "by_blocks", by_blocks)
    kept = exact_top(embeddings(rows), is_query(), pivots=1, rings=1).collect()
    assert len(blocks) == len(set(blocks)) and len(kept) == 12 * 5
    n_blocks = len({b for b, _, _ in blocks})
    assert max(emitted) <= 5 * n_blocks
    assert len({b for b, i, _ in blocks if i == 3}) > 1  # the vectors of one id are spread
