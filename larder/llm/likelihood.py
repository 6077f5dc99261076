"""Document likelihood by a subword lattice.

The vocabulary is an existing one. A word, with a mark in front, is written by any sequence of its
pieces (single bytes among them); the forward recursion in log space adds up the
probabilities of all segmentations. Each language with at least a hundredth of the labelled learning
rows, so a hundred at most whatever the labels hold, has piece probabilities of its own, and so have
all others and null together: they start from the weights the vocabulary's scores give and are
re-estimated from the expected counts over the language's distinct learning words, which are what new
words look like.

The lattice of a word has two more edges, the word itself as a unit of its language and of all
languages. With c_k occurrences among the N_k learning tokens of language k, c among all N,
    q_k(word) = w * lattice_k(word) + (1 - w) * c / N
    p_k(word) = (c_k + b_k * q_k) / (N_k + b_k),     b_k the number of words seen once in k.
The text's probability is the sum over languages of their share times the product of p_k
over its words and one end. `lang` is used for learning only; a text is scored from its
words alone.

Words with at least K / `heavy_share` of all tokens, K the number of languages, are scored in tasks and
broadcast, at most `heavy_share` numbers. The others travel as (row, word, number), meet the
counts of their word, and come back as sums per row. Both ways work in doubles, so which one a
word takes changes nothing.

Null text is the empty text: one end token. Repeated rows are scored and returned as often as they
come, each under a number of its own that is written down with its first sums; null doc_id counts as
the empty text for the hash. Texts and words of any length are read whole: a word's lattice takes
memory in proportion to its bytes. Languages equally frequent go by code point. Without learning rows
all counts are 0. An empty table gives an empty result; other columns stay behind.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import mixed, send, shared_value, slices, texts, words
from larder.session import settle

LANGUAGE_SHARE = 100
HEAVY_SHARE = 5_000_000
HELD_WORDS = 300_000
ROUNDS = 2
LATTICE_WEIGHT = 0.95
PRIOR_USES = 50.0
BYTE_WEIGHT = 1e-6
MARK = b" "
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))
LN10 = np.log(10.0)


class Vocabulary:
    """Pieces as byte strings (0..255 are the single bytes); `log` has a column per language."""

    def __init__(self, pieces: list[tuple[str, float]], languages: int = 1):
        usual = [(p.replace("▁", " ").encode(), s) for p, s in pieces if "▁" not in p[1:]]
        usual = [(raw, score) for raw, score in usual if len(raw) > 1]
        self.pieces = [bytes([i]) for i in range(256)] + [raw for raw, _ in usual]
        best = max((score for _, score in usual), default=0.0)
        weight = np.r_[np.full(256, BYTE_WEIGHT), [1.0 / (50.0 + best - score) for _, score in usual]]
        self.start = weight / weight.sum()
        self.log = np.tile(np.log(self.start)[:, None], languages)
        self.longest = max(map(len, self.pieces))
        lengths = np.array([len(p) for p in self.pieces])
        flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        stop = np.cumsum(lengths)
        marks = string_prints(flat, stop - lengths, stop)
        self.order = np.argsort(marks)
        self.marks = marks[self.order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.marks >> U64(44)).astype(np.int64)] = True

    def learn(self, expected: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """New probabilities from expected uses and ends by language; gives the logs of the ends'."""
        uses = expected + PRIOR_USES * self.start[:, None]
        total = uses.sum(0) + ends + 1.0
        self.log = np.log(uses / total)
        return np.log((ends + 1.0) / total)


def string_prints(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:stop], the same wherever a string stands."""
    up = np.cumprod(np.r_[U64(1), np.full(len(data), BASE)], dtype=U64)
    down = np.cumprod(np.r_[U64(1), np.full(len(data), INVERSE)], dtype=U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(VALUES[data] * down[:-1], out=total[1:], dtype=U64)
    return mixed((total[stop] - total[start]) * up[start] + (stop - start).astype(U64))


class Edges:
    """The lattices of some words: edges with their places, by distance of their end from the
    word's start. Node i of a word of m bytes is at its begin + i, so a word has m + 1 nodes."""

    def __init__(self, vocabulary: Vocabulary, raws: list[bytes]):
        marked = [MARK + raw for raw in raws]
        lengths = np.array([len(raw) for raw in marked])
        data = np.frombuffer(b"".join(marked), np.uint8)
        owner = np.repeat(np.arange(len(marked)), lengths)
        begins = np.cumsum(lengths) - lengths
        left = np.repeat(begins + lengths, lengths) - np.arange(len(data))  # bytes from here to the end
        up = np.cumprod(np.r_[U64(1), np.full(len(data), BASE)], dtype=U64)
        down = np.cumprod(np.r_[U64(1), np.full(len(data), INVERSE)], dtype=U64)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(VALUES[data] * down[:-1], out=total[1:], dtype=U64)
        starts, stops, ids = [np.arange(len(data))], [np.arange(len(data)) + 1], [data.astype(np.int64)]
        for length in range(2, min(vocabulary.longest, int(lengths.max(initial=0))) + 1):
            start = np.flatnonzero(left >= length)
            mark = mixed((total[start + length] - total[start]) * up[start] + U64(length))
            maybe = vocabulary.filter[(mark >> U64(44)).astype(np.int64)]
            start, mark = start[maybe], mark[maybe]
            spot = np.minimum(np.searchsorted(vocabulary.marks, mark), len(vocabulary.marks) - 1)
            found = vocabulary.marks[spot] == mark
            starts.append(start[found])
            stops.append(start[found] + length)
            ids.append(vocabulary.order[spot[found]])
        start, stop, self.ids = (np.concatenate(x) for x in (starts, stops, ids))
        word = owner[start]
        reach = stop - begins[word]
        order = np.lexsort((word, reach))
        self.ids, word, start, stop = self.ids[order], word[order], start[order], stop[order]
        self.begin = begins + np.arange(len(marked))  # node numbers
        self.end = self.begin + lengths
        self.start, self.stop = start + word, stop + word
        self.steps = np.r_[0, np.flatnonzero(np.diff(reach[order])) + 1, len(order)]
        self.nodes = len(data) + len(marked)

    def forward(self, log: np.ndarray) -> np.ndarray:
        """Log probability of all ways to each node; `log` by piece, or by piece and language."""
        value = np.full((self.nodes, *log.shape[1:]), -np.inf)
        value[self.begin] = 0.0
        for a, b in zip(self.steps, self.steps[1:], strict=False):
            target = self.stop[a:b]
            first = np.r_[0, np.flatnonzero(np.diff(target)) + 1] if b > a else np.zeros(0, int)
            if len(first):
                value[target[first]] = np.logaddexp.reduceat(value[self.start[a:b]] + log[self.ids[a:b]], first)
        return value

    def expected(self, log: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece, words counted by weight."""
        ahead = self.forward(log)
        back = np.full(self.nodes, -np.inf)
        back[self.end] = 0.0
        whole = np.empty(self.nodes)
        weight = np.empty(self.nodes)
        node_word = np.repeat(np.arange(len(self.begin)), self.end - self.begin + 1)
        whole[:] = ahead[self.end][node_word]
        weight[:] = weights[node_word]
        # edges by start, the last starts first
        reach = self.start - self.begin[node_word[self.start]]
        order = np.lexsort((self.start, -reach))
        start, stop, ids = self.start[order], self.stop[order], self.ids[order]
        steps = np.r_[0, np.flatnonzero(np.diff(reach[order])) + 1, len(order)]
        for a, b in zip(steps, steps[1:], strict=False):
            if b > a:
                first = np.r_[0, np.flatnonzero(np.diff(start[a:b])) + 1]
                back[start[a:b][first]] = np.logaddexp.reduceat(back[stop[a:b]] + log[ids[a:b]], first)
        share = np.exp(ahead[start] + log[ids] + back[stop] - whole[start]) * weight[start]
        return np.bincount(ids, share, len(log))


def in_groups(raws: list[bytes]) -> Iterator[np.ndarray]:
    """Places of the words, of like length together, some 200,000 bytes at a time."""
    order = np.argsort([len(raw) for raw in raws], kind="stable")
    sizes = np.cumsum([len(raws[i]) + 1 for i in order])
    cuts = np.flatnonzero(np.diff(sizes // 200_000)) + 1 if len(sizes) else []
    yield from (part for part in np.split(order, cuts) if len(part))


def lattice_log(vocabulary: Vocabulary, raws: list[bytes]) -> np.ndarray:
    """Natural log of the marginal probability of every word, by language."""
    out = np.zeros((len(raws), vocabulary.log.shape[1]))
    for places in in_groups(raws):
        edges = Edges(vocabulary, [raws[i] for i in places])
        out[places] = edges.forward(vocabulary.log)[edges.end]
    return out


class Model:
    """Totals of the learning rows; turns counts of words into log10 probabilities."""

    def __init__(self, languages: list[str | None], counts: dict):
        self.languages = languages
        self.tokens = np.array([counts["tokens"][k] + counts["ends"][k] for k in range(len(languages))], float)
        self.ends = np.array(counts["ends"], float)
        self.once = np.maximum(np.array(counts["once"], float), 1.0)
        self.train_tokens = int(self.tokens.sum())
        self.types = int(counts["types"]) + (self.ends.sum() > 0)
        self.shares = np.log10((self.ends + 1.0) / (self.ends.sum() + len(languages)))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.train_tokens + 0.1 * (self.types + 1)))

    def scores(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """By word and language; both arguments are too."""
        every = counts.sum(1, keepdims=True)
        backing = LATTICE_WEIGHT * np.exp(lattice) + (1 - LATTICE_WEIGHT) * every / max(self.train_tokens, 1)
        room = self.once / (self.tokens + self.once)
        # a new word has the lattice only, which may lie below the smallest double
        new = np.log10(room * LATTICE_WEIGHT) + lattice / LN10
        seen = (counts + self.once * backing) / (self.tokens + self.once)
        return np.where(every > 0, np.log10(np.where(every > 0, seen, 1.0)), new)


def held_out_column(modulus: int = 10) -> Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % modulus == 0


def learning_counts(docs: DataFrame, languages: list[str | None]) -> DataFrame:
    """word, n (array, by language) over all learning rows."""
    number = {name: i for i, name in enumerate(languages)}
    rest = len(languages) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(number.get(lang, rest), Counter()).update(words(text))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from flushed(held)
                    held = {}
        yield from flushed(held)

    def flushed(held: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for language, counter in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counter), pa.binary()), pa.array([language] * len(counter), pa.int32()),
                 pa.array(list(counter.values()), pa.int64())], names=["word", "language", "n"])

    found = docs.mapInArrow(run, "word binary, language int, n bigint")
    by_language = [F.sum(F.when(F.col("language") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(languages))]
    return found.groupBy("word").agg(*by_language)


def expected_pieces(counts: DataFrame, vocabulary: Vocabulary, languages: int) -> np.ndarray:
    """Expected uses of each piece over a language's distinct learning words; a row per piece and
    language comes back."""
    shared = send(counts.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared_value(shared)
        total = np.zeros_like(vocabulary.log)
        for batch in batches:
            raws = batch.column("word").to_pylist()
            for k in range(languages):
                mine = [raws[i] for i in np.flatnonzero(np.asarray(batch.column(f"n{k}")))]
                for places in in_groups(mine):
                    edges = Edges(vocabulary, [mine[i] for i in places])
                    total[:, k] += edges.expected(vocabulary.log[:, k], np.ones(len(places)))
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece), pa.array(language), pa.array(total[piece, language])], names=["piece", "language", "uses"])

    found = counts.mapInArrow(run, "piece bigint, language bigint, uses double")
    out = np.zeros_like(vocabulary.log)
    total = found.groupBy("piece", "language").agg(F.sum("uses").alias("uses")).toArrow()
    out[total["piece"].to_numpy(), total["language"].to_numpy()] = total["uses"].to_numpy()
    return out


def learned(docs: DataFrame, pieces: list[tuple[str, float]], heavy_share: int):
    """Word counts, model, vocabulary and the log probability of an end."""
    seen = settle(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "likelihood")
    labelled = seen.where("lang IS NOT NULL")
    rows = labelled.agg(F.sum("n")).first()[0] or 0
    named = [r["lang"] for r in labelled.where(F.col("n") * LANGUAGE_SHARE >= rows).orderBy(F.desc("n"), "lang").collect()]
    languages = [*named, None]  # the last: null and all others
    number = F.coalesce(*[F.when(F.col("lang") == name, F.lit(i)) for i, name in enumerate(named)], F.lit(len(named)))
    ends = {r["k"]: r["n"] for r in seen.groupBy(number.alias("k")).agg(F.sum("n").alias("n")).collect()}
    counts = settle(learning_counts(docs, languages), "likelihood")
    columns = [f"n{i}" for i in range(len(languages))]
    every = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    total = counts.agg(
        F.count(F.lit(1)).alias("types"),
        F.array(*[F.coalesce(F.sum(c), F.lit(0)) for c in columns]).alias("tokens"),
        F.array(*[F.count(F.when(F.col(c) > 0, 1)) for c in columns]).alias("types_by_language"),
        F.array(*[F.count(F.when(F.col(c) == 1, 1)) for c in columns]).alias("once")).first().asDict()
    model = Model(languages, total | {"ends": [ends.get(k, 0) for k in range(len(languages))]})
    vocabulary = Vocabulary(pieces, len(languages))
    types = np.array(total["types_by_language"], float)
    for _ in range(ROUNDS):
        ends = model.ends * types / np.maximum(model.tokens, 1.0)
        end_log = vocabulary.learn(expected_pieces(counts, vocabulary, len(languages)), ends)
    floor = max(1.0, model.train_tokens * len(languages) / heavy_share)
    heavy = counts.where((every >= floor) & (F.length("word") <= 64))
    return counts, heavy, model, vocabulary, end_log


def score_documents(docs: DataFrame, pieces: list[tuple[str, float]], heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    rows = texts(docs, "lang").withColumn("lang", F.col("lang").cast("string"))
    counts, heavy, model, vocabulary, end_log = learned(rows.where(~held_out_column()).select("text", "lang"), pieces, heavy_share)
    width = len(model.languages)
    columns = [f"n{i}" for i in range(width)]
    sums = [f"s{i}" for i in range(width)]
    doubles = ", ".join(f"{s} double" for s in sums)
    spelled = send(docs.sparkSession, (vocabulary, model))

    def known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared_value(spelled)
        for batch in batches:
            seen = np.column_stack([np.asarray(batch.column(c), float) for c in columns])
            logs = model.scores(seen, lattice_log(vocabulary, batch.column("word").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(model.base(seen.sum(1))), *(pa.array(logs[:, k]) for k in range(width))],
                names=["word", "base", *sums])

    # at most heavy_share / width words of at most 64 bytes
    top = heavy.mapInArrow(known_words, f"word binary, base double, {doubles}").toArrow()
    end = model.scores(model.ends[None, :], end_log[None, :])
    table = np.vstack([np.column_stack([top[s].to_numpy() for s in sums]), end])
    base = np.r_[top["base"].to_numpy(), model.base(model.ends.sum()[None])]
    shared = send(docs.sparkSession, ({raw: i for i, raw in enumerate(top["word"].to_pylist())}, table, base))
    end_known = int(model.ends.sum() > 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the broadcast words of each text, and its other words as lists."""
        number, table, base = shared_value(shared)
        last = len(base) - 1
        by_language = np.ascontiguousarray(table.T)
        for batch in slices(batches, 2048):
            found = [Counter(words(text)) for text in batch.column("text").to_pylist()]
            size = len(found)
            raws = list(chain.from_iterable(found))
            times = np.fromiter(chain.from_iterable(c.values() for c in found), np.int64, len(raws))
            ids = np.fromiter(map(number.get, raws, repeat(-1)), np.int64, len(raws))
            owner = np.repeat(np.arange(size), [len(c) for c in found])
            n_tokens = np.bincount(owner, times, size).astype(np.int64) + 1
            new = np.flatnonzero(ids < 0)
            other, other_n = [raws[i] for i in new], times[new]
            offsets = np.r_[0, np.cumsum(np.bincount(owner[new], minlength=size))]
            # the end of each text stands after its words
            old = ids >= 0
            ids = np.r_[ids[old], np.full(size, last)]
            times = np.r_[times[old], np.ones(size, np.int64)]
            owner = np.r_[owner[old], np.arange(size)]
            known = np.bincount(owner, times, size).astype(np.int64) - (1 - end_known)
            logs = [np.bincount(owner, column[ids] * times, size) for column in by_language]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(n_tokens, pa.int64()), pa.array(known),
                 pa.array(np.bincount(owner, base[ids] * times, size)), *(pa.array(x) for x in logs),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(other, pa.binary())),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(other_n, pa.int32()))],
                names=["doc_id", "row", "n_tokens", "n_known", "base", *sums, "other", "times"])

    keyed = rows.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    first = settle(keyed.mapInArrow(read, "doc_id bigint, row bigint, n_tokens bigint, n_known bigint, base double, "
                                    + doubles + ", other array<binary>, times array<int>"), "likelihood")
    rare = first.select("row", F.explode(F.arrays_zip("other", "times")).alias("w")).select(
        "row", F.col("w.other").alias("word"), F.col("w.times").alias("times"))
    joined = rare.join(counts, "word", "left")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared_value(spelled)
        for batch in batches:
            if not len(batch):
                continue
            raws = batch.column("word").to_pylist()
            place: dict[bytes, int] = {}
            code = np.array([place.setdefault(raw, len(place)) for raw in raws])
            _, at = np.unique(code, return_index=True)
            seen = np.column_stack([np.asarray(batch.column(c).take(pa.array(at)).fill_null(0), float) for c in columns])
            logs = model.scores(seen, lattice_log(vocabulary, list(place)))
            whole = seen.sum(1)
            times = np.asarray(batch.column("times"), float)
            ids = pa.table({"row": batch.column("row"), "known": times * (whole[code] > 0),
                            "base": model.base(whole)[code] * times, **{s: logs[code, k] * times for k, s in enumerate(sums)}})
            short = ids.group_by("row").aggregate([(c, "sum") for c in ("known", "base", *sums)])
            yield pa.RecordBatch.from_arrays(
                [short["row"].combine_chunks(), short["known_sum"].combine_chunks().cast(pa.int64()),
                 short["base_sum"].combine_chunks(), *(short[f"{s}_sum"].combine_chunks() for s in sums)],
                names=["row", "n_known", "base", *sums])

    partial = joined.mapInArrow(meet, f"row bigint, n_known bigint, base double, {doubles}")
    own = first.select("row", "doc_id", "n_tokens", "n_known", "base", *sums)
    added = partial.select("row", F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("n_tokens"),
                           "n_known", "base", *sums)
    total = own.unionByName(added).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", *sums)))
    shared_by = [F.col(s) + F.lit(float(model.shares[k])) for k, s in enumerate(sums)]
    best = F.greatest(*shared_by) if width > 1 else shared_by[0]
    spread = sum((F.pow(F.lit(10.0), x - best) for x in shared_by[1:]), F.pow(F.lit(10.0), shared_by[0] - best))
    return total.select(
        "doc_id", held_out_column().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"), (best + F.log10(spread)).alias("score"))
