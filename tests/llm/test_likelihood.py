import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from larder.llm.common import table, words
from larder.llm.likelihood import Edges, Vocabulary, lattice_log, learned, score_documents
from larder.llm.pieces import read_pieces
from larder.llm.registry import op7_lattice_likelihood
from tests.conftest import SF

PIECES = [("▁", -1.0), ("▁a", -2.0), ("a", -3.0), ("ab", -4.0), ("b", -5.0), ("▁ab", -6.0), ("é", -7.0), ("ba", -8.0), ("▁▁", -9.0)]


def segmentations(vocabulary, raw):
    """Every way to write the word, as lists of piece numbers."""
    number = {p: i for i, p in enumerate(vocabulary.pieces)}
    if not raw:
        return [[]]
    return [[number[raw[:n]], *rest] for n in range(1, len(raw) + 1) if raw[:n] in number for rest in segmentations(vocabulary, raw[n:])]


def test_marginals_and_expected_counts():
    vocabulary = Vocabulary(PIECES)
    raws = [b"a", b"ab", b"abab", b"\xc3\xa9a", b"zz", b"bab" * 3]
    log = vocabulary.log[:, 0]
    logs = lattice_log(vocabulary, raws)[:, 0]
    expected = np.zeros(len(vocabulary.pieces))
    weights = np.arange(1.0, len(raws) + 1)
    for raw, found, weight in zip(raws, logs, weights, strict=True):
        ways = segmentations(vocabulary, b" " + raw)
        values = [math.exp(sum(log[i] for i in way)) for way in ways]
        assert found == pytest.approx(math.log(sum(values)))
        for way, value in zip(ways, values, strict=True):
            np.add.at(expected, way, weight * value / sum(values))
    assert Edges(vocabulary, raws).expected(log, weights) == pytest.approx(expected)


def test_long_words_stay_finite():
    logs = lattice_log(Vocabulary(PIECES), [b"x" * 5000, b"ab" * 3000, "é".encode() * 10])
    assert np.isfinite(logs).all() and (logs < 0).all()


def base_of(rows):
    counts = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*words(text), None])
    tokens = sum(counts.values())
    out = {}
    for i, text in rows:
        own = [*words(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (tokens + 0.1 * (len(counts) + 1))) for w in own)
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), tokens, base)
    return out


@pytest.mark.parametrize("heavy_share", [1_000_000, 20, 1])
def test_whole_table_with_few_or_many_broadcast_words(spark, heavy_share):
    docs = table(spark, SF, "documents")
    wanted = base_of([(r.doc_id, r.text) for r in docs.collect()])
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = score_documents(docs, pieces, heavy_share).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        held, n, known, tokens, base = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    by_share.append({r.doc_id: r.score for r in rows})
    assert by_share[-1] == pytest.approx(by_share[0], rel=1e-9)


by_share: list[dict] = []


def test_better_than_the_base_on_held_out_text(spark):
    held = [r for r in op7_lattice_likelihood(spark, SF.replace("0.001", "0.01")).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens
    assert all(r.score < 0 for r in held)


def test_probabilities_add_up_to_at_most_one(documents):
    """Every text of one short word over a two-letter alphabet, scored by one model."""
    learn = [(i, "a ab b", "x") for i in range(2, 9)] + [(9, "ba a", "y")]
    asked = [(100 + i, bin(i)[3:].replace("0", "a").replace("1", "b"), None) for i in range(2, 256)]
    rows = score_documents(documents(learn + asked), PIECES).collect()
    assert sum(10 ** r.score for r in rows if r.doc_id >= 100) < 1


def brute_scores(rows):
    """log10 probability of each text: every segmentation of every word is written out."""
    vocabulary = Vocabulary(PIECES)
    learn = [(words(text), lang) for i, text, lang in rows if zlib.crc32(str(i).encode()) % 10]
    langs = [*sorted({lang for _, lang in learn if lang}), None]
    seen = {k: Counter(w for own, lang in learn if lang == k for w in own) for k in langs}
    ends = {k: sum(lang == k for _, lang in learn) for k in langs}
    tokens = {k: seen[k].total() + ends[k] for k in langs}
    every, of_all = sum(seen.values(), Counter()), sum(tokens.values())

    def ways(word, weight):
        return [(way, math.prod(weight[i] for i in way)) for way in segmentations(vocabulary, b" " + word)]

    def parts(k):
        weight = dict(enumerate(vocabulary.start))
        short_ends = ends[k] * len(seen[k]) / max(tokens[k], 1)
        for _ in range(2):
            uses = Counter({i: 50.0 * p for i, p in enumerate(vocabulary.start)})
            for word in seen[k]:
                found = ways(word, weight)
                for way, p in found:
                    for i in way:
                        uses[i] += p / sum(q for _, q in found)
            whole = sum(uses.values()) + short_ends + 1
            weight = {i: u / whole for i, u in uses.items()}
        return weight, (short_ends + 1) / whole

    def probability(lattice, own, count, k, once):
        if not count:
            return once / (tokens[k] + once) * 0.95 * lattice
        return (own + once * (0.95 * lattice + 0.05 * count / of_all)) / (tokens[k] + once)

    out = {i: 0.0 for i, _, _ in rows}
    for k in langs:
        weight, end = parts(k)
        once = max(sum(n == 1 for n in seen[k].values()), 1)
        for i, text, _ in rows:
            p = (ends[k] + 1) / (sum(ends.values()) + len(langs)) * probability(end, ends[k], sum(ends.values()), k, once)
            for word in words(text):
                p *= probability(sum(q for _, q in ways(word, weight)), seen[k][word], every[word], k, once)
            out[i] += p
    return {i: math.log10(p) for i, p in out.items()}


@pytest.mark.parametrize("heavy_share", [5_000_000, 12])
def test_scores_of_documents_are_sums_over_all_segmentations(documents, heavy_share):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([
        ("ab a ab baba", "x"), ("a b ab", "x"), ("b ba b", "y"), ("\u00e9a ba ab ab", "y"), ("bb ab", None), ("", "x"),
        ("a zz ab", "y"), ("ab ab ab a", "x"), ("b", None), ("bab bab", "z"), ("a abba \u00e9", "z"), ("ab zb", "x")])]
    wanted = brute_scores(rows)
    found = {r.doc_id: r.score for r in score_documents(documents(rows), PIECES, heavy_share).collect()}
    assert found == pytest.approx(wanted, rel=1e-9)


def test_every_language_has_weights_of_its_own(documents):
    rows = [(i, f"a b {'ab' * (i % 30)}", f"l{i % 30}") for i in range(300)]
    _, _, model, _, _ = learned(documents(rows).select("text", "lang"), PIECES, 100)
    assert sorted(filter(None, model.languages)) == sorted({lang for _, _, lang in rows})


def test_rows(documents):
    rows = [(1, None), (2, ""), (None, "a a"), (3, "a b"), (3, "a b"), (3, "c"), (10, "x" * 3000, "q"), (11, "\x00 é", "r")]
    found = score_documents(documents(rows), PIECES).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 3), (1, 1), (2, 1), (3, 2), (3, 3), (3, 3), (10, 2), (11, 3)]
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in found)
    assert score_documents(documents([]), PIECES).collect() == []
