"""License scans by ordered signature rules, in DataFrame functions alone.

A text becomes its lower-case (A-Z) words; the words of texts that hold a keyword are written
with their places, "0:under 1:the 2:mit 3:license", so that what a regex finds tells where it
stands. Every rule is a regex with a rank, a label and a weight, and is tried only on texts that
hold one of its keywords. Rules come from forms (tag, notice, field, title, full name, short
name, in this order of rank) filled with the names of each license.

Overlapping detections are resolved in three steps. Of those that start at one word the longest
stays, ties to the better rank. One that crosses another of better rank (neither interval holds the
other) goes. Of the rest, one whose interval lies within another's goes. Base phrases are found beside the rules at
every place they stand, overlapping ones too; their labels always stay.

All of it happens within the row: nothing is shuffled or broadcast, and a hot text or source is
spread like any other row. A rule spans a bounded number of words, so each detection is
compared with that many neighbours at most, however long the text.

Null text is empty: no words, no detections, empty labels and score 0. Null ids and repeated
rows are rows like all others. The operator adds its columns behind those to keep; others stay
behind whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Patterns below are over words: a blank is the step from one word to the next.
V = "(?: version| v)?"
CC = "(?:cc|creative commons)"
OF = "(?: (?:international|unported|generic|license))?"
LATER = "(?: or(?: any)? later)?"

#: label: keywords (one of them must be a word of the text), full names, short names and tags
LICENSES: dict[str, tuple[str, str, str]] = {
    "mit": ("mit expat", "mit(?: x11)?|expat", "mit license"),
    "mit-0": ("mit", "mit no attribution|mit 0", "mit 0"),
    "apache-1": ("apache", f"apache(?: software)?(?: license)?{V} 1(?: [01])?", "apache 1(?: [01])?"),
    "apache-2": ("apache apache2", f"apache(?: software)?(?: license)?{V} 2(?: 0)?", "apache 2(?: 0)?|apache2|asl 2(?: 0)?"),
    "apache": ("apache", "apache(?: software)?", "apache license"),
    "bsd-0": ("bsd 0bsd", "zero clause bsd|bsd zero clause", "0bsd"),
    "bsd-2": ("bsd freebsd", "(?:2|two) clause bsd|simplified bsd|freebsd", "bsd 2(?: clause)?"),
    "bsd-3": ("bsd", "(?:3|three) clause bsd|(?:new|modified|revised) bsd", "bsd 3(?: clause)?"),
    "bsd-4": ("bsd", "(?:4|four) clause bsd|original bsd", "bsd 4(?: clause)?"),
    "bsd": ("bsd", "bsd(?: style)?", "bsd license"),
    "gpl-1": ("gpl gplv1 gnu", f"gnu (?:general public license|gpl){V} 1(?: 0)?{LATER}", f"gpl{V} 1(?: 0)?|gplv1"),
    "gpl-2": ("gpl gplv2 gnu", f"gnu (?:general public license|gpl){V} 2(?: 0)?{LATER}", f"gpl{V} 2(?: 0)?{LATER}|gplv2"),
    "gpl-3": ("gpl gplv3 gnu", f"gnu (?:general public license|gpl){V} (?:3|v3)(?: 0)?{LATER}", f"gpl{V} 3(?: 0)?{LATER}|gplv3"),
    "gpl": ("gpl gnu", "gnu (?:general public license|gpl)|general public license", "gpl"),
    "lgpl-2.1": ("lgpl lgplv2 gnu", f"gnu (?:lesser|library) general public license{V} 2(?: [01])?{LATER}", f"lgpl{V} 2(?: [01])?{LATER}|lgplv2"),
    "lgpl-3": ("lgpl lgplv3 gnu", f"gnu lesser general public license{V} 3(?: 0)?{LATER}", f"lgpl{V} 3(?: 0)?{LATER}|lgplv3"),
    "lgpl": ("lgpl gnu", "gnu (?:lesser|library) general public license", "lgpl"),
    "agpl-3": ("agpl agplv3 gnu affero", f"(?:gnu )?affero general public license{V} 3(?: 0)?{LATER}", f"agpl{V} 3(?: 0)?{LATER}|agplv3"),
    "agpl": ("agpl affero", "(?:gnu )?affero general public license", "agpl"),
    "gfdl": ("gfdl gnu", "gnu free documentation license", "gfdl(?: 1 [123])?"),
    "mpl-1": ("mozilla mpl", f"mozilla public license{V} 1(?: [01])?", "mpl 1(?: [01])?"),
    "mpl-2": ("mozilla mpl", f"mozilla public license{V} 2(?: 0)?", "mpl 2(?: 0)?"),
    "mpl": ("mozilla", "mozilla public license", "mpl license"),
    "epl-1": ("eclipse epl", f"eclipse public license{V} 1(?: 0)?", "epl 1(?: 0)?"),
    "epl-2": ("eclipse epl", f"eclipse public license{V} 2(?: 0)?", "epl 2(?: 0)?"),
    "edl": ("eclipse", "eclipse distribution license", "edl 1 0"),
    "cddl": ("cddl", "common development and distribution license", "cddl(?: 1 [01])?"),
    "cpl": ("cpl common", "common public license", "cpl 1 0"),
    "eupl": ("eupl european", "european union public licen[cs]e", "eupl(?: 1 [012])?"),
    "osl-3": ("osl open", f"open software license{V} 3(?: 0)?", "osl 3(?: 0)?"),
    "afl-3": ("afl academic", f"academic free license{V} 3(?: 0)?", "afl 3(?: 0)?"),
    "ecl-2": ("ecl educational", f"educational community license{V} 2(?: 0)?", "ecl 2(?: 0)?"),
    "artistic-1": ("artistic", f"artistic license{V} 1(?: 0)?", "artistic 1(?: 0)?"),
    "artistic-2": ("artistic", f"artistic license{V} 2(?: 0)?", "artistic 2(?: 0)?"),
    "isc": ("isc", "isc|internet systems consortium", "isc license"),
    "zlib": ("zlib", "zlib(?: libpng)?", "zlib license"),
    "libpng": ("libpng", "libpng", "libpng license"),
    "boost-1": ("boost bsl", f"boost software license{V}(?: 1(?: 0)?)?", "bsl 1 0"),
    "unlicense": ("unlicense", "unlicense", "the unlicense"),
    "wtfpl": ("wtfpl fuck", "do what the fuck you want to public license", "wtfpl"),
    "postgresql": ("postgresql", "postgresql", "postgresql license"),
    "python-2": ("python psf", f"python software foundation license{V} 2", "psf 2(?: 0)?"),
    "psf": ("python psf", "python software foundation(?: license)?", "psf license"),
    "php-3": ("php", f"php license{V} 3(?: 0[01])?", "php 3(?: 0[01])?"),
    "ruby": ("ruby", "ruby", "ruby license"),
    "vim": ("vim", "vim", "vim license"),
    "x11": ("x11", "x11", "x11 license"),
    "ncsa": ("ncsa", "university of illinois ncsa open source|ncsa open source", "ncsa"),
    "ms-pl": ("microsoft ms", "microsoft public license", "ms pl"),
    "ms-rl": ("microsoft ms", "microsoft reciprocal license", "ms rl"),
    "ofl-1": ("ofl sil", f"(?:sil )?open font license{V}(?: 1 [01])?", "ofl(?: 1 [01])?"),
    "odbl": ("odbl database", f"open database license{V}(?: 1 0)?", "odbl(?: 1 0)?"),
    "odc-by": ("odc", "open data commons attribution license", "odc by"),
    "pddl": ("pddl", "public domain dedication and license", "pddl"),
    "cc0": ("cc0 cc creative", f"{CC} zero{V}(?: 1 0)?", "cc0(?: 1 0)?"),
    "cc-by": ("cc creative", f"{CC} attribution(?: [1-4] [05])?{OF}", "cc by(?: [1-4] [05])?"),
    "cc-by-sa": ("cc creative", f"{CC} attribution share ?alike(?: [1-4] [05])?{OF}", "cc by sa(?: [1-4] [05])?"),
    "cc-by-nd": ("cc creative", f"{CC} attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?{OF}", "cc by nd(?: [1-4] [05])?"),
    "cc-by-nc": ("cc creative", f"{CC} attribution non ?commercial(?: [1-4] [05])?{OF}", "cc by nc(?: [1-4] [05])?"),
    "cc-by-nc-sa": ("cc creative", f"{CC} attribution non ?commercial share ?alike(?: [1-4] [05])?{OF}", "cc by nc sa(?: [1-4] [05])?"),
    "cc-by-nc-nd": ("cc creative", f"{CC} attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?{OF}", "cc by nc nd(?: [1-4] [05])?"),
    "public-domain": ("domain", "public domain", "dedicated to the public domain"),
    "proprietary": ("reserved proprietary", "proprietary", "all rights reserved"),
}

GIVEN = "(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered)"
UNDER = "(?: under| by)(?: the)?(?: (?:terms|conditions) of)?(?: the)?"
#: weight, and the pattern a name is put into; the best rank comes first
FORMS: list[tuple[float, str]] = [
    (1.0, "spdx license identifier (?:{short}|{name})"),
    (0.95, GIVEN + UNDER + " {name}(?: licen[cs]e)?"),
    (0.9, "licen[cs]e(?: is| type| name)? (?:{name}|{short})(?: licen[cs]e)?"),
    (0.8, "(?:the )?{name} licen[cs]e"),
    (0.7, "(?:under|see|subject to) (?:the )?{short}"),
    (0.6, "{short}"),
]


@dataclass(frozen=True)
class Rule:
    rank: int
    label: str
    keywords: tuple[str, ...]
    pattern: str
    weight: float

    @property
    def most_words(self) -> int:
        return self.pattern.count(" ") + 1


def licence_rules(licenses: Mapping[str, tuple[str, str, str]] = LICENSES, forms: Sequence[tuple[float, str]] = FORMS) -> list[Rule]:
    """A rule per form and license, ordered by rank. Full names that say "license" can stand for short ones."""
    return [
        Rule(rank, label, tuple(keywords.split()),
             form.format(name=f"(?:{name})", short=f"(?:{name}|{short})" if "licen" in name else f"(?:{short})"), weight)
        for rank, (weight, form) in enumerate(forms)
        for label, (keywords, name, short) in licenses.items()
    ]


def placed(pattern: str) -> str:
    """The pattern over numbered words: what stands for it is group 1, found at every start."""
    return "(?=( [0-9]+:" + re.sub(" ", " [0-9]+:", pattern.replace(" ?", "(?: )?")) + ")(?= ))"


def found(numbered: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(numbered, pattern, 1)


def first_place(match: Column) -> Column:
    return F.substring_index(F.ltrim(match), ":", 1).cast("int")


def last_place(match: Column) -> Column:
    return F.substring_index(F.substring_index(match, " ", -1), ":", 1).cast("int")


def scan(docs: DataFrame, rules: Sequence[Rule] | None = None, base: Mapping[str, str] = BASE, keep: Sequence[str] = ()) -> DataFrame:
    """Columns to keep, then n_words, base (start, label) and detections (start, end, rank, label, weight)."""
    rules = licence_rules() if rules is None else rules
    reach = max((rule.most_words for rule in rules), default=1)
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), CAPITALS, SMALL)
    listed = docs.select(*keep, F.array_remove(F.split(text, BETWEEN), "").alias("_words"))
    keywords = sorted({k for rule in rules for k in rule.keywords} | {phrase.split()[-1] for phrase in base})
    held = listed.withColumn("_held", F.array_intersect("_words", F.array(*map(F.lit, keywords)) if keywords else no_words()))
    numbers = F.transform("_words", lambda w, i: F.concat(i.cast("string"), F.lit(":"), w))
    text = F.concat(F.lit(" "), F.array_join(numbers, " "), F.lit(" "))
    held = held.withColumn("_numbered", F.when(F.size("_held") > 0, text).otherwise(F.lit("")))

    table = F.array(*(F.struct(
        F.lit(rule.rank).alias("rank"), F.lit(rule.label).alias("label"), F.lit(rule.weight).alias("weight"),
        F.array(*map(F.lit, rule.keywords)).alias("keywords"), F.lit(placed(rule.pattern)).alias("pattern")) for rule in rules))
    phrases = F.array(*(F.struct(F.lit(placed(phrase)).alias("pattern"), F.lit(label).alias("label"), F.lit(phrase.split()[-1]).alias("keyword"))
                        for phrase, label in base.items()))

    def detections(rule: Column) -> Column:
        # in the order they are sorted by: start, the longest, the best rank
        return F.transform(found(F.col("_numbered"), rule["pattern"]), lambda m: F.struct(
            first_place(m).alias("start"), (-last_place(m)).alias("back"), rule["rank"].alias("rank"), rule["label"].alias("label"),
            rule["weight"].alias("weight")))

    def places(phrase: Column) -> Column:
        return F.transform(found(F.col("_numbered"), phrase["pattern"]), lambda m: F.struct(
            first_place(m).alias("start"), phrase["label"].alias("label")))

    gated = F.filter(table, lambda rule: F.arrays_overlap(F.col("_held"), rule["keywords"]))
    asked = F.filter(phrases, lambda phrase: F.array_contains(F.col("_held"), phrase["keyword"]))
    nothing = F.expr("cast(array() AS array<struct<start:int,back:int,rank:int,label:string,weight:double>>)")
    nowhere = F.expr("cast(array() AS array<struct<start:int,label:string>>)")
    seen = held.select(
        *keep, F.size("_words").cast("bigint").alias("n_words"),
        (F.array_sort(F.flatten(F.transform(asked, places))) if base else nowhere).alias("base"),
        (F.array_sort(F.flatten(F.transform(gated, detections))) if rules else nothing).alias("_all"))
    longest = seen.withColumn("_all", F.filter("_all", lambda d, i: (i == 0) | (F.get(F.col("_all"), i - 1)["start"] != d["start"])))

    def leading(d: Column, i: Column) -> Column:
        around = F.slice("_all", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
        before = lambda e: (e["start"] < d["start"]) & (d["start"] <= -e["back"]) & (e["back"] > d["back"])
        after = lambda e: (d["start"] < e["start"]) & (e["start"] <= -d["back"]) & (d["back"] > e["back"])
        return ~F.exists(around, lambda e: (e["rank"] < d["rank"]) & (before(e) | after(e)))

    ranked = longest.withColumn("_all", F.filter("_all", leading))

    def outer(d: Column, i: Column) -> Column:
        before = F.slice("_all", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)))
        return ~F.exists(before, lambda e: e["back"] <= d["back"])

    kept = ranked.withColumn("_all", F.filter("_all", outer))
    shown = F.transform("_all", lambda d: F.struct(d["start"], (-d["back"]).alias("end"), d["rank"], d["label"], d["weight"]))
    return kept.select(*keep, "n_words", "base", shown.alias("detections"))


def no_words() -> Column:
    return F.expr("cast(array() AS array<string>)")


def summary(scanned: DataFrame, *keep: str) -> DataFrame:
    """Columns to keep, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the weight of the best detection; a base phrase counts 0.95.
    """
    named = F.transform("base", lambda b: b["label"])
    also = F.transform("detections", lambda d: d["label"])
    starts = F.transform("base", lambda b: b["start"])
    weights = F.concat(F.transform("detections", lambda d: d["weight"]), F.transform("base", lambda b: F.lit(0.95)), F.array(F.lit(0.0)))
    return scanned.select(
        *keep, "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(named, also))), ",").alias("labels"),
        F.array_max(weights).alias("score"))
