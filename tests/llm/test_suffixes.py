import hashlib
import random

import numpy as np
import pytest

from larder.llm.common import table
from larder.llm.registry import op1_suffix_arrays
from larder.llm.suffixes import BLOCK, LENGTH, Family, blocks_of, remove_repeats, runs_of
from tests.conftest import SF


def brute(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_bytes, n_removed, n_spans, kept)}."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - LENGTH + 1):
            window = raw[p : p + LENGTH]
            if window in seen:
                gone[p : p + LENGTH] = b"\x01" * LENGTH
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc_id] = len(raw), sum(gone), (b"\0" + bytes(gone)).count(b"\0\x01"), kept
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, line = text(60), text(22)[:80]
    rows = [(0, text(200))]
    for i in range(1, n):
        kind = rng.randrange(8)
        if kind == 0:
            new = rows[rng.randrange(len(rows))][1]
        elif kind == 1:  # near copy
            words = rows[rng.randrange(len(rows))][1].split(" ")
            for _ in range(3):
                words[rng.randrange(len(words))] = word()
            new = " ".join(words)
        elif kind == 2:
            new = text(rng.randrange(40)) + common + text(rng.randrange(40))
        elif kind == 3:
            new = text(rng.randrange(30)) + " " + line + " " + text(rng.randrange(30))
        elif kind == 4:
            new = "".join(rng.choice(["ab" * 90, "x" * 150, "abc" * 50, text(10)]) for _ in range(4))
        elif kind == 5:
            old = rows[rng.randrange(len(rows))][1]
            cut = rng.randrange(len(old) + 1)
            new = old[cut : cut + rng.randrange(80, 260)] + text(15)
        elif kind == 6:
            new = common[:99] + text(1)
        else:
            new = text(rng.randrange(80))
        rows.append((i * 7 % 101 if n <= 101 else i, new))
    return list({i: (i, t) for i, t in rows}.values())


def result(frame):
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in frame.collect()]


@pytest.mark.parametrize(("seed", "batch_rows", "hot"), [(1, 1 << 16, 100_000), (2, 5, 100_000), (3, 40, 2), (4, 1, 1)])
def test_against_brute_force(documents, seed, batch_rows, hot):
    rows = made(seed) + [(None, "null id first " * 30), (500, None), (501, ""), (502, "x" * 99), (503, "null id first " * 12)]
    found = result(remove_repeats(documents(rows).repartition(3), batch_rows, hot))
    wanted = brute(rows)
    assert dict(found) == wanted and len(found) == len(wanted)
    assert sum(v[1] > 0 for v in wanted.values()) > 10


def test_repeated_rows_are_one_document(documents):
    rows = made(9, 12)
    wanted = brute(rows)
    found = result(remove_repeats(documents(rows + rows[:6]), 7, 3))
    assert len(found) == len(rows) + 6
    assert all(v == wanted[i] for i, v in found)
    two = result(remove_repeats(documents([(1, "a" * 30 + "bc" * 80), (1, "d" * 50 + "bc" * 80)])))
    assert len(two) == 2 and sum(v[1] for _, v in two) > 150


def test_empty_table(documents):
    assert remove_repeats(documents([])).collect() == []


def test_long_texts_go_through_in_blocks(documents):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 3 * BLOCK + 12345).astype(np.uint8).tobytes()
    assert sum(len(data) - (~valid).sum() for data, valid, _, _ in blocks_of([raw, b"x" * 150])) == len(raw) - LENGTH + 1 + 51
    text = raw.decode()
    found = dict(result(remove_repeats(documents([(1, text), (2, text[BLOCK - 70 : 2 * BLOCK + 500]), (3, "q" + text[777 : 777 + 150] + "q")]))))
    assert found[1][1] == 0 and found[2][3] == b"" and found[3][3] == b"qq"


def test_every_window_is_in_one_run():
    data = np.random.default_rng(5).integers(97, 99, 5000).astype(np.uint8)
    valid = np.ones(len(data), bool)
    valid[3000:3099] = False
    low, high, anchor, _ = runs_of(data, valid)
    assert sum(high - low + 1) == valid[: len(data) - LENGTH + 1].sum()
    assert ((anchor >= high) & (anchor - low <= 76)).all()


def test_levels_grow_geometrically():
    family = Family()
    for i in range(64):
        rows = np.zeros((4, 10), np.int64)
        rows[0] = np.arange(10) * 64 + i
        family.add(rows)
        sizes = [level.shape[1] for level in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert family.whole().shape[1] == 640 and len(sizes) <= 7


def test_whole_table(spark):
    wanted = brute([(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])
    rows = op1_suffix_arrays(spark, SF).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        size, removed, spans, kept = wanted[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, removed, spans, hashlib.sha256(kept).hexdigest())
