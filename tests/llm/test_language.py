import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larder.llm.common import table
from larder.llm.language import ORDER, PAD, Coder, build, fit, gram_counts, learning_sample, predict, remainder
from larder.llm.registry import op9_language
from tests.conftest import SF


def slow_bits(samples, text):
    """Code length by walking dictionaries of contexts, byte by byte."""
    tree = defaultdict(Counter)
    for sample in samples:
        data = PAD + sample.encode()
        for i in range(ORDER, len(data)):
            for size in range(ORDER + 1):
                tree[data[i - size : i]][data[i]] += 1
    data, bits = PAD + text.encode(), 0.0
    for i in range(ORDER, len(data)):
        for size in range(ORDER, -1, -1):
            seen = tree.get(data[i - size : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / whole)
                break
            bits -= math.log2(len(seen) / whole)
        else:
            bits += 8
    return bits


SAMPLES = {"a": ["the cat sat on the mat", "then that"], "b": ["der hund und die katze", "é ö"], "c": ["x"]}


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(label, text) for label, texts in SAMPLES.items() for text in texts]
    return build(gram_counts(spark.createDataFrame(rows, "label string, text string")).toPandas())


def test_exact_code_lengths(trees):
    coder = Coder(trees)
    texts = ["the hat", "die the", "zzz", "é", "x", "\n", "\x00\xff", "a" * 50, "the cat sat on the mat"]
    found = coder.lengths([t.encode() for t in texts])
    for text, row in zip(texts, found, strict=True):
        assert row == pytest.approx([slow_bits(SAMPLES[name], text) for name in trees.languages], rel=1e-5)


def test_long_texts_are_read_whole(trees):
    coder = Coder(trees)
    raw = b"the cat sat on the mat and zz " * 80_000
    whole = coder.costs(np.frombuffer(PAD + raw, np.uint8)).sum(0, np.float64)
    assert coder.lengths([b"x", raw, b"", b"the"])[1] == pytest.approx(whole, rel=1e-6)


def test_rows(documents, trees):
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, "the cat"), (4, "the cat"), (None, "und die"), (6, "the " * 9)]
    found = [(r.doc_id, r.lang_pred, r.score) for r in predict(documents(rows), trees).collect()]
    assert [f[1] for f in found] == ["und", "und", "und", "a", "a", "b", "a"]
    assert all(0 <= s <= 1 for _, _, s in found)
    assert predict(documents([]), trees).collect() == []


def test_nothing_to_learn(documents):
    docs = documents([(1, "text", None), (2, None, "en")])
    assert fit(docs) is None
    assert [r.lang_pred for r in predict(docs, None).collect()] == ["und", "und"]


def test_held_out_accuracy(spark):
    rows = op9_language(spark, SF).collect()
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_only_learning_rows_are_read(documents):
    rows = [(i, "aaa bbb" if zlib.crc32(str(i).encode()) % 3 == 1 else "ccc ddd", "x") for i in range(1, 30)]
    trees = fit(documents(rows).where(remainder(3) != 1))
    assert trees.code[0][ord("a")][0] > 8 > trees.code[0][ord("c")][0]


def test_no_label_is_left_out(documents):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(5)]
    rows += [(100 + i, "der hund und die katze " * 2000, "de") for i in range(4)]  # longer than what is read of a row
    rows += [(None, f"el gato y el perro {i}", "es") for i in range(4)]
    trees = fit(documents(rows), rows_per_language=3, longest=1000)
    assert trees.languages == ["de", "en", "es"]
    asked = [(1, "und die katze"), (2, "and the cat"), (3, "el perro y el gato")]
    assert {r.doc_id: r.lang_pred for r in predict(documents(asked), trees).collect()} == {1: "de", 2: "en", 3: "es"}
    counts = gram_counts(learning_sample(documents(rows), "lang", 3, 1000)).where("size = 1").groupBy("label").sum("n").collect()
    assert {r[0]: r[1] for r in counts} == {"de": 3000, "en": 300, "es": 60}


def test_whole_table_against_the_slow_coder(spark):
    docs = table(spark, SF, "documents")
    trees = fit(docs.where(remainder(3) != 1))
    sample = learning_sample(docs.where(remainder(3) != 1), "lang", 400, 20_000).collect()
    grams = {name: Counter() for name in trees.languages}
    for row in sample:
        data = PAD + row.text.encode()
        for i in range(ORDER, len(data)):
            for size in range(1, ORDER + 2):
                grams[row.label][data[i - size + 1 : i + 1]] += 1
    totals = {name: (Counter(), Counter()) for name in grams}
    for name, counted in grams.items():
        for gram, n in counted.items():
            totals[name][0][gram[:-1]] += n
            totals[name][1][gram[:-1]] += 1

    def bits(name, data, i):
        cost = 0.0
        for size in range(ORDER + 1, 0, -1):
            context, gram = data[i - size + 1 : i], data[i - size + 1 : i + 1]
            total, different = totals[name][0][context], totals[name][1][context]
            if grams[name][gram]:
                return cost - math.log2(grams[name][gram] / (total + different))
            if total:
                cost -= math.log2(different / (total + different))
        return cost + 8.0

    found = {r.doc_id: r for r in op9_language(spark, SF).collect()}
    for row in docs.orderBy("doc_id").collect():
        data = PAD + row.text.encode()
        length = {name: sum(bits(name, data, i) for i in range(ORDER, len(data))) for name in trees.languages}
        best = min(length.values())
        assert length[found[row.doc_id].lang_pred] == pytest.approx(best, rel=1e-5)
        score = 1 / sum(2.0 ** max(best - b, -900.0) for b in length.values())
        assert found[row.doc_id].score == pytest.approx(score, abs=1e-3)
