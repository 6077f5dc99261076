import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from larder.llm.common import table
from larder.llm.pieces import Lattice, marked, read_pieces, token_counts
from larder.llm.registry import op3_token_counts
from tests.conftest import SF


@pytest.fixture(scope="module")
def pieces():
    return read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def library(pieces, byte_fallback):
    extra = [(f"<0x{i:02X}>", 0.0) for i in range(256)] if byte_fallback else []
    # scores of the extra entries never compete: none of them occurs in the texts
    lowest = min(score for _, score in pieces)
    vocabulary = [("<unk>", lowest), *((p, lowest) for p, _ in extra), *pieces]
    return Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))


TEXTS = ["", " ", "  ", " a", "a ", "a  b", "plain words here", "tab\tand\nline", "éè 𝔘𝔘 ☃☃☃ x", "▁ ▁a", "日本語 x", "a" * 500]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_as_the_library(pieces, byte_fallback):
    lattice, tokenizer = Lattice(pieces, byte_fallback), library(pieces, byte_fallback)
    rng = random.Random(5)
    made = ["".join(rng.choice("the andofing er  \té☃𝔘▁") for _ in range(rng.randrange(80))) for _ in range(400)]
    for text in TEXTS + made:
        assert lattice.text(text)[0] == len(tokenizer.encode(marked(text)).tokens), text


def test_ties_go_to_the_longest_last_piece():
    tied = [("▁", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -1.0), ("bc", -1.0), ("abc", -2.0), ("▁a", -1.0)]
    tokenizer = library(tied, False)
    for text in ("abc", "abcabc", "cab", "aabbcc", "bcb"):
        assert Lattice(tied, False).text(text)[0] == len(tokenizer.encode(marked(text)).tokens)


def test_rows(documents, pieces):
    found = token_counts(documents([(1, None), (None, "a"), (2, ""), (2, "a a")]), pieces).collect()
    assert sorted((r.doc_id or 0, r.n_pieces) for r in found) == [(0, 1), (1, 0), (2, 0), (2, 2)]
    assert token_counts(documents([]), pieces).collect() == []


def test_very_long_texts(documents, pieces):
    rng = random.Random(6)
    texts = ["".join(rng.choices("aenrst", k=30_000)), "the and of " * 40_000]
    tokenizer = library(pieces, True)
    found = {r.doc_id: r.n_pieces for r in token_counts(documents(list(enumerate(texts))), pieces).collect()}
    assert found == {i: len(tokenizer.encode(marked(text)).tokens) for i, text in enumerate(texts)}


def test_whole_table(spark, pieces):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    tokenizer = library(pieces, True)
    rows = op3_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for row in rows:
        assert row.n_pieces == len(tokenizer.encode(marked(docs[row.doc_id])).tokens)
