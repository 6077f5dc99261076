import re

from larder.llm.licenses import BASE, LICENSES, Rule, licence_rules, scan, summary


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def brute(text, rules):
    """Words, base places and detections (start, end, rank, label) by one rule at one word at a time."""
    listed = words(text)
    numbered = [f"{i}:{w}" for i, w in enumerate(listed)]
    base = sorted((i, label) for phrase, label in BASE.items() for i in range(len(listed))
                  if listed[i : i + len(phrase.split())] == phrase.split())
    hits = {}
    for rule in rules:
        if not set(rule.keywords) & set(listed):
            continue
        body = re.compile(" [0-9]+:" + rule.pattern.replace(" ?", "(?: )?").replace(" ", " [0-9]+:") + "(?= )")
        for i in range(len(listed)):
            m = body.match(" " + " ".join(numbered[i : i + 60]) + " ")
            if m:
                end = int(m.group().split(" ")[-1].split(":")[0])
                hits.setdefault(i, []).append((-end, rule.rank, rule.label))
    longest = [(i, -min(found)[0], *min(found)[1:]) for i, found in sorted(hits.items())]

    def crosses(a, b):
        return a[0] < b[0] <= a[1] < b[1] or b[0] < a[0] <= b[1] < a[1]

    ranked = [d for d in longest if not any(e[2] < d[2] and crosses(d, e) for e in longest)]
    return len(listed), base, [d for d in ranked if not any(e[0] < d[0] and d[1] <= e[1] for e in ranked)]


TEXTS = [
    None, "", "   ", "no permission of any kind",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
    "SPDX-License-Identifier: Apache-2.0 licensed under the MIT License. cc by-nc-sa 4.0, see GNU General Public License v3.0 or later",
    "CC BY-NC 4.0 cc-by-nc cc by nc nc cc by nc", "under the mit license under the mit license" * 3,
    "This work is licensed under the GNU Lesser General Public License version 2.1 or later (LGPL 2.1+), or the 3-clause BSD license.",
    "Dual licensed under the MIT license and the Mozilla Public License 2.0. Creative Commons Attribution Noncommercial Share Alike 4.0",
    "ÉCOLE under the mit licensé; under the MİT license; Apache License version 2\x00.0 all rights reserved",
    "license: isc, license is zlib license license unlicense wtfpl 0BSD odc by",
]


def test_against_brute_force(documents):
    texts = [*TEXTS, " ".join(t or "" for t in TEXTS), " ".join(reversed([t or "-" for t in TEXTS]))]
    rules = licence_rules()
    for row in scan(documents(list(enumerate(texts))), keep=("doc_id",)).collect():
        n, base, found = brute(texts[row.doc_id], rules)
        assert (row.n_words, [tuple(b) for b in row.base]) == (n, base)
        assert [tuple(d)[:4] for d in row.detections] == found, texts[row.doc_id]


def test_summary(documents):
    rows = {r.doc_id: r for r in summary(scan(documents([
        (1, "Released under the MIT License"), (2, None), (3, "x cc by nc y cc by nc; SPDX-License-Identifier: ISC"), (3, "cc0")]),
        keep=("doc_id", "word")), "doc_id", "word").orderBy("doc_id", "n_words").collect() if r.n_words != 1}
    assert rows[1][1:] == ("y", 5, 1, 1, 1, "mit", "mit", 0.95)
    assert rows[2][1:] == ("y", 0, 0, None, None, "", "", 0.0)
    assert rows[3][1:] == ("y", 12, 2, 1, 5, "cc-by-nc", "cc-by-nc,isc", 1.0)


def test_rank_and_containment(documents):
    rules = [Rule(1, "wide", ("b",), "a b c", 0.5), Rule(0, "inner", ("b",), "b", 1.0), Rule(0, "best", ("d",), "d e", 1.0),
             Rule(2, "crossing", ("d",), "c1 d", 0.3), Rule(3, "same", ("d",), "d e", 0.1), Rule(0, "gated", ("zzz",), "a", 1.0)]
    found = scan(documents([(1, "a b c c1 d e b")]), rules=rules, base={}, keep=()).first()
    assert [(d.start, d.end, d.label) for d in found.detections] == [(0, 2, "wide"), (4, 5, "best"), (6, 6, "inner")]


def test_very_long_text(documents):
    text = "filler words without a keyword " * 100_000 + "under the mit license " * 1_000
    row = summary(scan(documents([(1, text)]), keep=("doc_id",)), "doc_id").first()
    assert row[1:] == (504_000, 1_000, 500_000, 503_996, "mit", "mit", 0.95)


def test_empty_table(documents):
    assert summary(scan(documents([]), keep=("doc_id",)), "doc_id").collect() == []


def test_rules_are_many_and_each_name_is_found(documents):
    rules = licence_rules()
    assert len(rules) >= 300 and all(rule.keywords for rule in rules)
    named = {"mit": "MIT", "gpl-3": "GNU GPL v3", "epl-2": "Eclipse Public License 2.0", "ofl-1": "SIL Open Font License 1.1", "x11": "X11",
             "cc-by-sa": "Creative Commons Attribution ShareAlike 4.0", "unlicense": "Unlicense", "bsd-3": "New BSD"}
    rows = [(i, f"Code here is distributed under the terms of the {name} license") for i, name in enumerate(named.values())]
    found = {r.doc_id: r.labels for r in summary(scan(documents(rows), keep=("doc_id",)), "doc_id").collect()}
    assert [found[i] for i in range(len(named))] == list(named) and set(named) <= set(LICENSES)


def test_no_python_in_the_plan(documents):
    plan = summary(scan(documents([(1, "x")]), keep=("doc_id",)), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
