import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from larder.llm.bpe import Encoder, encode_decode, read_ranks
from larder.llm.common import table
from larder.llm.registry import op10_byte_bpe
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_ranks(PATH), public_tokenizers.PATTERN)


def ids(encoder, text):
    found = list(memoryview(encoder.encode(text)).cast("i"))
    assert encoder.decode(found) == text.encode()
    return found


@pytest.mark.parametrize("text", [
    "", " ", "a", "\n\n  \t x", "a" * 5000, "ab" * 3000, "é" * 999, "I'll we've  THE'S", "日本語 テキスト", "\x00\x1c\x85  ",
    "x" + " " * 4000 + "y", "0123456789" * 300, "<|endoftext|>", "𞻰🙂🏽‍👩", "\U00018da7\U00018da7a1 \U000323b0",
])
def test_as_tiktoken(encoder, reference, text):
    assert ids(encoder, text) == reference.encode_ordinary(text)


def test_random_strings(encoder, reference):
    rng = random.Random(3)
    pools = ["ab", "the and of ing er", "aàâä é \n", "".join(map(chr, range(32, 1500)))]
    for _ in range(400):
        pool = rng.choice(pools)
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(300)))
        assert ids(encoder, text) == reference.encode_ordinary(text)


def test_every_code_point(encoder, reference):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        text = "".join(f"a {c}{c}a1{c}1 !{c}! {c}  {c} " for c in points[i : i + 4096])
        assert ids(encoder, text) == reference.encode_ordinary(text)


def test_very_long_pieces_and_texts(encoder, reference):
    rng = random.Random(8)
    for text in ("".join(rng.choices("abcdefghij", k=40_000)), "é" * 20_000, "a " * 300_000 + "the end" * 80_000):
        assert ids(encoder, text) == reference.encode_ordinary(text)


def test_rows_without_text(documents):
    found = encode_decode(documents([(1, None), (None, "a"), (2, ""), (2, "")]), PATH, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or 0, len(r.ids), bytes(r.decoded)) for r in found.collect()) == [
        (0, 1, b"a"), (1, 0, b""), (2, 0, b""), (2, 0, b"")]
    assert encode_decode(documents([]), PATH, public_tokenizers.PATTERN).collect() == []


def test_whole_table(spark, reference):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = op10_byte_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for row in rows:
        wanted = reference.encode_ordinary(docs[row.doc_id])
        assert row.n_tokens == len(wanted)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()
