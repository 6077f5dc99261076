import hashlib
import math
import random

import numpy as np
import pytest

from larder.llm import quantiser
from larder.llm.quantiser import Book, digest, far_apart, pivot_distances, quantise, with_group_error
from larder.llm.registry import op11_vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, v string, near int, error string, g int, salt int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2, 3) for i, v, label in rows], SCHEMA)


def brute(rows, parts, entries, scale, rounds):
    """Plain integers, every entry tried. rows: (vec_id, components) -> codes and errors in order, digest."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(scale * x) for x in v] for _, v in rows]
    length = len(whole[0]) // parts
    cut = [[v[p * length : (p + 1) * length] for v in whole] for p in range(parts)]
    books = [list(column[:entries]) for column in cut]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(part, books[p])[1] for part in cut[p]]
            for e in set(own):
                mine = [part for part, o in zip(cut[p], own, strict=True) if o == e]
                books[p][e] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    found = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(rows))]
    listed = ",".join(str(x) for book in books for entry in book for x in entry)
    return ([(rows[i][0], [e for _, e in row], sum(d for d, _ in row)) for i, row in enumerate(found)],
            hashlib.sha256(listed.encode()).hexdigest())


@pytest.mark.parametrize("kind", ["even", "clustered", "ties"])
def test_against_brute_force(spark, kind):
    rnd = random.Random(kind)
    centres = [[rnd.uniform(-1, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(300):
        if kind == "even":
            v = [rnd.gauss(0, 0.2) for _ in range(12)]
        elif kind == "clustered":
            v = [x + rnd.gauss(0, 0.01) for x in centres[i % 6]]
        else:
            v = [rnd.choice([-0.5, 0.0, 0.5]) for _ in range(12)]
        rows.append((i * 7 % 300, v))
    coded, books = quantise(frame(spark, [(i, v, 0) for i, v in rows]), parts=4, entries=20, scale=64, rounds=3, pivots=4)
    wanted, wanted_digest = brute(rows, 4, 20, 64, 3)
    assert sorted((r.vec_id, r.indexes, r.error) for r in coded.collect()) == sorted(wanted)
    assert digest(books) == wanted_digest


def test_blocks_stop_early_and_find_the_nearest(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (64, 8))
    entries = np.concatenate([centres + rng.integers(-9, 9, (64, 8)) for _ in range(4)])
    parts = centres[rng.integers(0, 64, 20000)] + rng.integers(-9, 9, (20000, 8))
    book = Book(entries, far_apart(entries, 8))
    tried, plain = [], quantiser.squared_distances
    monkeypatch.setattr(quantiser, "squared_distances", lambda a, b: tried.append(len(a) * len(b)) or plain(a, b))
    index, least = book.nearest(parts, pivot_distances(parts, book.pivots).astype(np.float32).astype(np.float64))
    squares = plain(parts, entries)
    assert (index == squares.argmin(1)).all() and (least == squares.min(1)).all()
    assert sum(tried[1:]) < 0.75 * squares.size  # the first are the pivot distances


def test_large_components_stay_exact():
    a = np.array([[(1 << 26) - 1, -(1 << 26) + 1], [0, 1]], np.int64)
    assert quantiser.squared_distances(a, a).tolist() == [
        [0, ((1 << 26) - 1) ** 2 + (1 << 52)], [((1 << 26) - 1) ** 2 + (1 << 52), 0]]


def test_edges(spark):
    v = [0.1, -0.2, 0.3, 0.4]
    rows = [(3, v, None), (3, v, 1), (None, v, None), (1, None, 1), (2, [0.1, None, 0.2, 0.3], 1), (4, [math.nan, 0.0, 0.0, 0.0], 1),
            (5, [math.inf, 0.0, 0.0, 0.0], 1), (0, [1.0, 1.0, 1.0, 1.0], 1)]
    coded, books = quantise(frame(spark, rows), keep=("label",))
    found = sorted(with_group_error(coded, "label").collect(), key=str)
    assert [(r.vec_id, r.label) for r in found] == [(0, 1), (3, 1), (3, None), (None, None)]
    assert all(r.error == 0 and r.label_error == 0 for r in found)
    assert len(books[0].entries) == 4  # repeated rows are entries as well; ties go to the lower index
    assert {tuple(r.indexes) for r in found if r.vec_id != 0} == {(1, 1, 1, 1)}


def test_group_errors_add_up(spark):
    rows = [(i, [math.sin(i * k) for k in range(1, 9)], None if i % 3 else i % 2) for i in range(90)]
    coded, _ = quantise(frame(spark, rows), entries=3, keep=("label",))
    found = with_group_error(coded, "label").collect()
    totals = {}
    for r in found:
        totals[r.label] = totals.get(r.label, 0) + r.error
    assert len(found) == 90 and all(r.label_error == totals[r.label] for r in found)


def test_empty_tables_and_vectors(spark):
    coded, books = quantise(frame(spark, []), keep=("label",))
    assert coded.columns == ["vec_id", "indexes", "error", "label"] and coded.count() == 0 and books == []
    coded, _ = quantise(frame(spark, [(1, [], 0), (2, [], 0)]))
    assert [tuple(r) for r in coded.orderBy("vec_id").collect()] == [(1, [0, 0, 0, 0], 0), (2, [0, 0, 0, 0], 0)]


@pytest.mark.parametrize("rows", [[(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [1.0] * 6, 0)], [(1, [1e300] * 4, 0)]])
def test_vectors_without_codes_are_refused(spark, rows):
    with pytest.raises(Exception, match="components"):
        quantise(frame(spark, rows))[0].collect()


def test_empty_query(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op11_vector_codes(spark, str(tmp_path)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert op11_vector_codes(spark, str(tmp_path)).count() == 0
