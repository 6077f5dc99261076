import random

import numpy as np
import pytest

from larder.llm import jaccard
from larder.llm.common import table, words
from larder.llm.graph import components
from larder.llm.jaccard import WordPrints, link_documents, search_links, shingle_sets, signatures, size_classes
from larder.llm.registry import op2_ngram_jaccard
from tests.conftest import SF


def shingles(text, n=3):
    ws = words(text)
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def brute(rows, percent=90):
    """Rows (doc_id, text), ids not null: {doc_id: (n_shingles, component)}; equal ids are one node."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and root(i) != root(j) and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i, len(s), root(i)) for i, s in sets)


def made(seed, groups=25, copies=12, length=(1, 90)):
    rng = random.Random(seed)
    rows, ids = [], list(range(1000))
    rng.shuffle(ids)
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(*length))]
        for _ in range(rng.randrange(1, copies)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(300)}"
            if rng.random() < 0.4:
                copy += [f"y{rng.randrange(300)}" for _ in range(rng.randrange(6))]
            if rng.random() < 0.2:
                copy = [w.upper() for w in copy]
            rows.append((ids.pop(), rng.choice([" ", "\n", "\t "]).join(copy)))
            base = copy if rng.random() < 0.3 else base
    return rows


def result(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect())


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (2, 3), (3, 1)])
def test_against_brute_force(documents, seed, block):
    rows = made(seed) + [(2001, None), (2002, ""), (2003, " \n"), (2004, "one"), (2005, "ONE"), (2006, "one two"), (2007, "one  two")]
    wanted = brute(rows)
    assert result(link_documents(documents(rows), block_documents=block)) == wanted
    assert len({c for _, _, c in wanted}) < len(rows) - 20


def test_chains_and_big_groups(documents):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[i : i + 40])) for i in range(20)] + [(100 + i, " ".join(base[:39] + [f"z{i}"])) for i in range(40)]
    assert result(link_documents(documents(rows), block_documents=16)) == brute(rows)


def test_repeated_ids_and_nulls(documents):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (5, "q r s t"), (7, "q r s t"), (9, "a b c d e"), (3, "z z z")]
    found = result(link_documents(documents(rows + [(3, "z z z")])))
    assert found == sorted([(3, 1, 3), (3, 1, 3), (5, 3, 5), (5, 3, 5), (5, 2, 5), (7, 2, 5), (9, 3, 5)])
    null = link_documents(documents([(None, "a b c"), (4, "a b c"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in null if r.doc_id) == [(4, 1, 4)]
    assert all(r.component_id is None for r in null if r.doc_id is None) and len(null) == 3
    assert link_documents(documents([])).collect() == []


@pytest.mark.parametrize("percent", [90, 80])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(3)
    for size in [*range(1, 60), 150, 400]:
        for _ in range(6):
            whole = rng.integers(0, 1 << 62, 2 * size).astype(np.uint64)
            drop = rng.integers(0, size * (100 - percent) // percent + 1)
            a, b = whole[:size], np.r_[whole[: size - drop // 2], whole[size : size + drop // 2]]
            shared = len(set(a.tolist()) & set(b.tolist()))
            if 100 * shared < percent * (len(a) + len(b) - shared):
                continue
            owner = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
            holder, sign = signatures(owner, np.r_[a, b], np.array([len(a), len(b)]), percent)
            assert set(sign[holder == 0].tolist()) & set(sign[holder == 1].tolist())


def test_few_sets_deal_anew():
    rng = np.random.default_rng(4)
    sizes = np.full(200, 300)
    value = rng.integers(0, 1 << 62, 60_000).astype(np.uint64)
    holder, _ = signatures(np.repeat(np.arange(200), 300), value, sizes, 80)
    assert len(holder) < 200 * 2 * 200  # a level of each of two classes, not six


def test_size_classes_cover_linked_sizes():
    first, _, _ = size_classes(5000, 90)
    number = lambda s: np.searchsorted(first, s, "right") - 1
    for small in range(1, 3000):
        assert number(small * 10 // 9) - number(small) <= 1


def test_search_finds_every_component():
    for seed in range(30):
        rows = made(seed, groups=3, copies=15, length=(5, 30))
        owner, value = shingle_sets([words(t) for _, t in rows], 3, WordPrints())
        forest = {i: i for i, _ in rows}

        def root(i):
            while forest[i] != i:
                i = forest[i]
            return i

        for a, b in search_links(owner, value, np.zeros(len(rows), int), 90):
            a, b = rows[a][0], rows[b][0]
            assert root(a) != root(b)
            forest[max(root(a), root(b))] = min(root(a), root(b))
        assert sorted((i, len(shingles(t)), root(i)) for i, t in rows) == brute(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {n: n for e in edges for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: root(n) for n in linked}


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert result(op2_ngram_jaccard(spark, SF)) == brute(rows)


def test_chance_ties_bring_no_texts_together(documents, monkeypatch):
    rng, searched = random.Random(8), []
    search = jaccard.links_in_blocks

    def counted(members, n, percent):
        searched.append(members.count())
        return search(members, n, percent)

    monkeypatch.setattr(jaccard, "links_in_blocks", counted)
    passage = [f"p{i}" for i in range(24)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(3000)}" for _ in range(18)])) for i in range(150)]
    rows += [(200 + i, f"{text} y") for i, text in rows[:5]]
    assert result(link_documents(documents(rows), n=5, percent=80)) == sorted(
        (i, len(shingles(t, 5)), i - 200 if i >= 200 else i) for i, t in rows)
    assert searched == [10]  # the copies and what they are copied from, of 155 texts


@pytest.mark.parametrize("percent", [90, 80, 40])
def test_no_link_is_ruled_out(percent):
    rng = np.random.default_rng(6)
    for _ in range(40):
        sets = []
        for size in rng.integers(1, 400, 4):
            base = rng.integers(0, 1 << 62, size)
            for _ in range(6):
                kept = base[rng.random(size) < rng.uniform(0.6, 1)]
                sets.append(set(np.r_[kept, rng.integers(0, 1 << 62, rng.integers(0, size // 8 + 2))].tolist()))
        sets = [s for s in sets if s]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        bits = jaccard.parities(owner, np.array([v for s in sets for v in s], np.uint64), sizes)
        for side in (np.zeros(len(sets), int), rng.integers(0, 2, len(sets))):
            group = np.arange(len(sets))
            for a, b in jaccard.not_ruled_out(sizes, side, bits, percent):
                group[group == group[a]] = group[b]
            for i, a in enumerate(sets):
                for j, b in enumerate(sets[:i]):
                    if 100 * len(a & b) >= percent * len(a | b) and (side[i] != side[j] or side.min() == side.max()):
                        assert group[i] == group[j]


def test_packed_signatures():
    rng = np.random.default_rng(7)
    sign = rng.integers(0, 1 << 48, 5000).astype(np.uint64)
    sign[:40] = sign[40:80]
    ids = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    whole = [(sign[:2000], ids[:2000]), (sign[2000:], ids[2000:])]
    found, ranges = [], jaccard.packed_signatures(whole, 9).to_pylist()
    for row in ranges:
        values, of = jaccard.unpacked_signatures(jaccard.zstandard.ZstdDecompressor().decompress(row["found"]))
        assert np.all(values * np.uint64(9) >> np.uint64(48) == row["part"])
        found += zip(values.tolist(), of.tolist(), strict=True)
    assert sorted(found) == sorted(zip(sign.tolist(), ids.tolist(), strict=True)) and len(ranges) == 9
    tied = jaccard.found_ties(whole).to_pylist()
    assert sorted((r["doc_id"], r["hub"]) for r in tied) == sorted(
        (max(a, b), min(a, b)) for a, b in zip(ids[:40].tolist(), ids[40:80].tolist(), strict=True))
