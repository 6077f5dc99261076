import hashlib
import random
import re
from functools import cache

import numpy as np

from larder.llm.common import table
from larder.llm.registry import op8_sentence_spans
from larder.llm.spans import cut, cuts, remove_repeated_spans, word_ranks
from tests.conftest import SF

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@cache
def rank_of(word):
    return int(word_ranks(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def plain_parts(text):
    """Sentences, and (words, start, end) of every part: one word after the other."""
    raw = (text or "").encode("utf-8", "replace")
    found = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(raw)]
    gaps = [raw[a[2] : b[1]] for a, b in zip(found, found[1:])] + [b"\n"]
    ends = [w[-1:] in (b".", b"!", b"?") or b"\n" in gap for (w, _, _), gap in zip(found, gaps)]

    def rank(i):
        if not 0 <= i < len(found) or ends[i]:
            return -1
        return rank_of(found[i][0])

    inner = [rank(i) >= 0 and all(rank(i - k) > rank(i) for k in (1, 2, 3)) and all(rank(i + k) >= rank(i) for k in (1, 2, 3))
             for i in range(len(found))]
    parts, first = [], 0
    for i in range(len(found)):
        if ends[i] or inner[i]:
            begin = found[first][1] if first else 0
            stop = found[i + 1][1] if i + 1 < len(found) else len(raw)
            parts.append((tuple(w for w, _, _ in found[first : i + 1]), begin, stop))
            first = i + 1
    return sum(ends), parts, raw


def brute(rows, run=3, least=25):
    """Rows (doc_id, text) with distinct ids, null id first: n_sentences, n_parts, n_removed, kept by id."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if not text:
            out[doc_id] = (0, 0, 0, text)
            continue
        sentences, parts, raw = plain_parts(text)
        sentences = sentences if parts else 0
        gone = set()
        for i in range(len(parts)):
            key, j = (), i
            while j < len(parts) and (j - i < run or len(key) < least):
                key += parts[j][0]
                j += 1
            if j - i < run or len(key) < least:
                break
            if key in seen:
                gone |= set(range(i, j))
            seen.add(key)
        kept = b"".join(raw[a:b] for i, (_, a, b) in enumerate(parts) if i not in gone).decode() if parts else text
        out[doc_id] = (sentences, len(parts), len(gone), kept)
    return out


ROWS = [
    (5, "A b. C d! E f? G h. I j."), (3, "X y. C D! e  f?\nG h. Z."), (9, "C d! E f? G h."), (1, None), (2, ""),
    (7, "one. two. one. two. one. two. one."), (8, "one. two."), (None, "G h. I j. K l."), (11, "G h. I j. K l. M"),
    (12, "no end"), (13, "A. B. C. " * 400), (14, "\n\n \n"), (15, "  É! É\xa0 x\x85y z. " * 3), (16, "a b c d, e f g h; i j k l m n o p q r s t " * 5),
]


def results(frame):
    return {r.doc_id: (r.n_sentences, r.n_parts, r.n_removed, r.kept_text) for r in frame.collect()}


def test_against_brute_force(documents):
    for run, least in ((2, 1), (3, 1), (3, 6), (1, 25)):
        assert results(remove_repeated_spans(documents(ROWS), run, least)) == brute(ROWS, run, least)


def test_repeated_rows_share_their_result(documents):
    text = "A b. C d. E f. G h."
    found = remove_repeated_spans(documents([(4, text), (4, text), (4, "Q. " + text)]), least=3).collect()
    by_text = sorted((r.n_sentences, r.n_removed) for r in found)
    assert len(found) == 3 and by_text[0] == by_text[1]
    assert {n for _, n in by_text} == {0, 4}
    assert remove_repeated_spans(documents([])).collect() == []


def test_whole_table(spark):
    wanted = brute([(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])
    rows = op8_sentence_spans(spark, SF).collect()
    assert len(rows) == len(wanted) and sum(r.n_removed > 0 for r in rows) > 10
    for r in rows:
        *counts, kept = wanted[r.doc_id]
        assert [r.n_sentences, r.n_parts, r.n_removed] == counts and r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_passages_inside_sentences(documents):
    rng = random.Random(7)
    prose = lambda n: [f"w{rng.randrange(5000)}" + rng.choice(["", "", "", "", "", "", ",", ";"]) for _ in range(n)]
    passages = [prose(n) for n in range(51, 81)]
    rows = [(k * 100 + i, " ".join([*prose(20), *passage, *prose(20)])) for k in (1, 2) for i, passage in enumerate(passages)]
    rows += [(300 + i, " ".join(prose(90))) for i in range(30)]
    found = {r.doc_id: r for r in remove_repeated_spans(documents(rows)).collect()}
    for i, text in rows:
        r = found[i]
        if 200 <= i < 300:  # later occurrence: only words of the passage go
            own = text.split()
            left = r.kept_text.split()
            assert r.n_removed >= 3 and left[:20] == own[:20] and left[-20:] == own[-20:]
        else:
            assert r.n_removed == 0 and r.kept_text == text
    assert found.keys() == dict(rows).keys()


def test_ordinary_short_phrases_stay(documents):
    rows = [(i, f"Unique{i} start{i}. Thank you. See below. All the best. Number{i} ends{i} here{i}.") for i in range(20)]
    assert all(r.n_removed == 0 for r in remove_repeated_spans(documents(rows)).collect())


def test_very_long_text(documents):
    text = " ".join(f"w{i}" + "." * (i % 9 == 0) for i in range(150_000))
    found = results(remove_repeated_spans(documents([(1, text), (2, "before. " + text + " after.")])))
    assert found[1][2] == 0 and found[2][1] - found[2][2] <= 4 and len(found[2][3].split()) < 30


def test_very_frequent_spans(documents, monkeypatch):
    monkeypatch.setattr("larder.llm.spans.LEAST_HOT", 5)
    monkeypatch.setattr("larder.llm.spans.HOT_SPANS", 50)
    rows = [(i, f"own{i} words{i}. " + "Copied line one. Copied line two. Copied line three. " * (i % 3 + 1) + f"end{i}.") for i in range(30)]
    rows += [(100 + i, f"a{i // 2} b{i // 2}. c{i // 2}. d{i // 2}. e") for i in range(20)]
    for least in (1, 9):
        assert results(remove_repeated_spans(documents(rows), 3, least)) == brute(rows, 3, least)


def test_texts_are_cut_alike_in_any_company():
    texts = [t for _, t in ROWS] * 3
    alone = [next(cut([(t or "").encode()])) for t in texts]
    for one, other in zip(alone, cuts(texts), strict=True):
        assert (one.first.tolist(), one.start.tolist(), one.sentences) == (other.first.tolist(), other.start.tolist(), other.sentences)


def test_cuts_do_not_depend_on_the_surroundings():
    def parts(text):
        found = next(cut([text.encode()]))
        return [text.split()[a:b] for a, b in zip(found.first, found.first[1:])]

    for passage in ("uno dos, tres cuatro cinco " * 12, " ".join(f"v{i * i}" for i in range(60))):
        inner = parts(passage)[1:-1]
        assert len(inner) >= 3
        around = [p for p in parts("q r s t u v w " + passage + " x y z x y z x") if p in inner]
        assert around[: len(inner)] == inner
