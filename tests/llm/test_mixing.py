import hashlib
import math
from collections import defaultdict

import pytest

from larder.llm.common import table, words
from larder.llm.mixing import measured, mix
from larder.llm.registry import op5_mixing
from tests.conftest import SF

SPEC = {"weights": (3, 1, 2), "share": 1.5, "most": 2.0}


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Give out by weight, stop at the limit, share the excess anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[n] for n in full)
        open_ = sum(weight[n] for n in names if n not in full)
        target = {n: most * sizes[n] if n in full else left * weight[n] / open_ for n in names}
        above = {n for n in names if target[n] > most * sizes[n] * (1 + 1e-12)}
        if not above:
            return target
        full |= above


def brute(rows, seed="mix"):
    """rows: (doc_id, source, size, quality) -> taken by doc_id, with distinct ids."""
    sizes = defaultdict(int)
    for _, source, size, _ in rows:
        sizes[source] += size
    taken = {}
    for source, target in brute_targets(sizes).items():
        mine = [r for r in rows if r[1] == source]
        epochs = math.floor(target / sizes[source]) if sizes[source] else 0
        room = round(target) - epochs * sizes[source]

        def key(row):
            u = (int(hashlib.md5(f"{seed}:{row[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / row[3], row[0]

        for row in sorted(mine, key=key):
            more = min(row[2], max(room, 0))
            room -= row[2]
            taken[row[0]] = epochs * row[2] + more
    return taken


@pytest.mark.parametrize("bins", [1, 7, 65536])
def test_against_brute_force(spark, bins):
    rows = [(i, [None, "a", "b", "ä", "zz"][i * i % 5], (i * 37) % 50, 0.05 + (i % 9) / 9) for i in range(400)]
    rows += [(1000 + i, "tiny", i, 1.0) for i in range(2)] + [(2000, "empty", 0, 1.0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, quality double")
    found = mix(frame, bins=bins, **SPEC).collect()
    sizes = defaultdict(int)
    for _, source, size, _ in rows:
        sizes[source] += size
    wanted, goals = brute(rows), brute_targets(sizes)
    assert {r.doc_id: r.taken for r in found} == wanted
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goals[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size


def test_targets_stop_at_the_limit_one_after_the_other(spark):
    rows = [(1, "a", 1, 1.0), (2, "b", 10, 1.0), (3, "c", 12, 1.0), (4, "d", 300, 1.0), (5, "e", 900, 1.0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, quality double")
    goals = brute_targets({"a": 1, "b": 10, "c": 12, "d": 300, "e": 900})
    assert {r.source: round(r.target, 6) for r in mix(frame, **SPEC).collect()} == {k: round(v, 6) for k, v in goals.items()}


def test_rows(documents):
    rows = [(1, None, None, None), (2, "", None, "s"), (None, "a b c", None, "s"), (3, "x y", None, None), (3, "x y", None, None)]
    found = mix(measured(documents(rows)), **SPEC).collect()
    assert len(found) == 5 and sum(r.size for r in found) == 7
    assert mix(measured(documents([])), **SPEC).collect() == []


def test_heavier_documents_come_first_more_often(spark):
    rows = [(i, "s", 1, 1.0 if i % 2 else 0.1) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, quality double")
    twice = [r.doc_id % 2 for r in mix(frame, (1,), 1.3, 2.0).collect() if r.taken == 2]
    assert 590 <= len(twice) <= 610 and sum(twice) > 0.8 * len(twice)


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    found = op5_mixing(spark, SF).collect()
    assert {r.doc_id: r.size for r in found} == size
    by_source = defaultdict(int)
    for r in found:
        by_source[r.source] += r.taken
    assert all(abs(by_source[r.source] - r.target) <= 1 for r in found)
    assert sorted(map(tuple, op5_mixing(spark, SF).collect())) == sorted(map(tuple, found))
