import math

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from larder.llm.bpe import read_ranks
from larder.llm.common import table, words
from larder.llm.mixing import measured, mix
from larder.llm.registry import MIX
from tests.conftest import SF
from tests.llm.test_mixing import brute as taken_by
from tests.llm.test_suffixes import brute as without_repeats


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage is given and gives, written and read again as in a run."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = table(spark, SF, "documents")
    for name, stage in pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF).write.parquet(path)
        found = spark.read.parquet(path)
        out.append((docs.collect(), found.collect(), found.columns))
        docs = found
    return out


def test_columns(stages):
    for _, _, columns in stages[:-1]:
        assert columns == list(pipeline.COLUMNS)


def test_language_keeps_what_has_letters(stages):
    given, kept, _ = stages[0]
    assert sorted(kept) == sorted(r for r in given if any(c.isalpha() for c in r.text or ""))


def five_word_groups(rows):
    """{doc_id: smallest id of its group}, linked at 0.8 by runs of five words."""
    split = {i: words(t) for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}
    group = {i: {i} for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and group[i] is not group[j] and a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[i] |= group[j]
                for member in group[i]:
                    group[member] = group[i]
    return {i: min(members) for i, members in group.items()}


def test_near_copies_link_by_five_words(spark, documents, stages):
    given, kept, _ = stages[1]
    assert len(kept) < len(given)
    groups = five_word_groups([(r.doc_id, r.text) for r in given])
    assert sorted(kept) == sorted(r for r in given if groups[r.doc_id] == r.doc_id)
    # one changed word in 50: 41 / 51 by five words, 45 / 51 by three; two changed words stay apart
    base = [f"w{i}" for i in range(50)]
    one, two = [*base[:20], "x", *base[21:]], [*base[:15], "y", *base[16:30], "z", *base[31:]]
    rows = [(i, " ".join(w)) for i, w in ((1, base), (2, one), (3, two))]
    assert sorted(r.doc_id for r in pipeline.near_copies(spark, documents(rows), SF).collect()) == [1, 3]


def test_repeats_are_cut(stages):
    given, kept, _ = stages[2]
    wanted = {i: v[3].decode("utf-8", "ignore") for i, v in without_repeats([(r.doc_id, r.text) for r in given]).items()}
    assert {r.doc_id: r.text for r in kept} == {i: t for i, t in wanted.items() if t}
    assert all(r.n_chars == len(r.text) for r in kept)


def test_mix_takes_effect(spark, stages):
    given, kept, _ = stages[3]
    sized = measured(spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()
    taken = taken_by([(r.doc_id, r.source, r["size"], r.quality) for r in sized])
    copies = {r.doc_id: math.floor(taken[r.doc_id] / r["size"] + 0.5) for r in sized if r["size"]}
    count = {}
    for r in kept:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {i: n for i, n in copies.items() if n}
    texts = {r.doc_id: r.text for r in given}
    assert all(r.text == texts[r.doc_id] for r in kept)


def test_encoding(stages):
    given, found, _ = stages[4]
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, r.ids) for r in found) == sorted((r.doc_id, library.encode_ordinary(r.text)) for r in given)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)


def test_run_is_the_stages_in_turn(spark, stages):
    assert sorted(map(str, pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1][1]))


def test_nulls_and_empty_tables(spark, documents):
    rows = [(1, None), (None, "some words here"), (2, ""), (3, "123"), (4, "words and words", "en", None), (4, "words and words", "en", None)]
    for given in (rows, []):
        docs = documents(given)
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
        ids = sorted((r.doc_id or 0) for r in docs.collect())
        assert set(ids) <= {0, 4} and bool(given) == bool(ids)
