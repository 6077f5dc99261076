import itertools
import re
from collections import defaultdict

import numpy as np

from larder.llm.audit import audit, failures, removal_steps

LABELS = "doc_id bigint, quality int, toxic int, n int, part string"


def brute(docs, labels):
    """One document after the other through every order."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    harmful = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    rows = defaultdict(list)
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)}
        rows[lang or ""].append(({f for f, failed in fails.items() if failed}, doc_id in good, doc_id in harmful))
    out = {}
    for part, members in rows.items():
        shapley = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                redundant = sum(f in m[0] for m in members) - len(gone)
                left = [m for m in left if f not in m[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(m[0] == {f} for m in members),
                                                   sum(m[1] for m in gone), sum(m[2] for m in gone)]
        for (name, order, step), row in out.items():
            if name == part:
                row.append(shapley[order[step - 1]])
    return out


def found(documents, spark, docs, labels):
    frame = audit(failures(documents(docs), spark.createDataFrame([(*row, 1, "x") for row in labels], LABELS)))
    rows = frame.collect()
    assert len(rows) == len({tuple(r)[:3] for r in rows})
    return {tuple(r)[:3]: list(r)[3:] for r in rows}


def test_against_brute_force(documents, spark):
    varied = " ".join(f"w{i}" for i in range(120))
    texts = [varied, varied + " #", "A" * 30, "", None, "same " * 150, "same " * 150, varied.upper(), "short | text", " \t\n", "É" * 50]
    docs = [(i, texts[i * i % len(texts)], [None, "", "en", "de"][i % 4]) for i in range(60)]
    docs += [(7, varied, "en"), (7, varied, "de"), (None, varied, "en"), (None, "", None), (-5, varied, "xx"), (-5, varied, "xx")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(7, 0, 1), (7, 1, 0), (None, 1, 1), (2, None, None), (999, 1, 1), (-5, 1, 0)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    assert found(documents, spark, docs, labels) == brute(docs, labels)


def test_every_part_has_all_rows_and_zeros(documents, spark):
    clean = " ".join(f"w{i}" for i in range(100))
    rows = found(documents, spark, [(1, clean, "en"), (2, "x", None)], [])
    assert len(rows) == 1200
    assert all(v == [1, 0, 0, 0, 0, 0, 0] for (part, _, _), v in rows.items() if part == "en")
    assert rows["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_empty_tables(documents, spark):
    assert found(documents, spark, [], []) == {}


def test_very_long_and_hot_texts(documents, spark):
    long = "word " * 400_000
    docs = [(i, "copy", "en") for i in range(3000)] + [(5000, long, "en"), (5001, long, "en")]
    rows = found(documents, spark, docs, [])
    assert rows["en", "EABCD", 1] == [2, 3000, 0, 0, 0, 0, sum(rows["en", "".join(o), o.index("E") + 1][1] for o in itertools.permutations("ABCDE"))]


def test_min_plus_steps():
    orders, step = removal_steps(3)
    assert len(orders) == 6 and np.isinf(step[0]).all()
    for mask in range(1, 8):
        for k, order in enumerate(orders):
            assert step[mask, k] == 1 + min(order.index(f) for f in range(3) if mask >> f & 1)
