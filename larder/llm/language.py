"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to `order` bytes long. A byte is coded in the
longest context that the language has seen: with count c of total T over d different bytes
it costs -log2(c / (T + d)), and the escape to the next shorter context -log2(d / (T + d));
below the empty context every byte costs 8 bits. The statistics are frozen after fitting, so
a text's exact code length is a sum over its bytes, and the language with the shortest code
is predicted. The score is the posterior probability under equal priors.

Since the statistics are frozen, the cost of a byte depends on the `order` bytes before it
only. The trees are laid out as tables over the byte strings that any language has seen, with
one column per language, and whole blocks of text are looked up at once.

Fitting reads `rows_per_language` labelled rows per language (the smallest hashes of doc_id, rows of
more than `longest` characters only where there are too few others, and of these that many
characters), a documented sample of bounded size: no label is left out, whatever its rows' length,
and rows with null ids take part. Counting runs on the executors, and the tables, bounded by the
sample, are broadcast.

Null text, and text without a letter: `und`, score 0. Nothing to learn from: `und` for all.
Ties go to the language first in code point order. Null doc_id hashes as the empty text. Repeated
rows count as often as they come. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import Recipe, record, send, shared_value, slices, texts, with_kept

UNDETERMINED = "und"
ORDER = 3
PAD = b"\n" * ORDER
BLOCK = 1 << 18
LETTER = regex.compile(r"\p{L}")


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null counts as the empty text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % modulus


@dataclass
class Trees:
    """Sorted byte strings of 2, 3, .. `order` + 1 bytes, and costs with a column per language."""

    languages: list[str]
    grams: list[np.ndarray]
    code: list[np.ndarray]  # by string: code length of its last byte after the others
    escape: list[np.ndarray]  # by string: what leaving it as a context costs


def learning_sample(docs: DataFrame, label: str, rows_per_language: int, longest: int) -> DataFrame:
    """label, text: short texts before longer ones, then by hash; of longer ones the first `longest` characters."""
    usable = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select(
        F.col("doc_id").alias("id"), F.col(label).cast("string").alias("label"), "text", F.xxhash64("text").alias("print"))
    order = Window.partitionBy("label").orderBy("long", "turn", "id", "print")
    ranked = usable.select("id", "label", "print", (F.length("text") > longest).alias("long"), F.xxhash64("id").alias("turn"))
    chosen = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows_per_language).select(
        F.col("id").alias("c_id"), F.col("print").alias("c_print"), F.col("label").alias("c_label")).distinct()
    same = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("print") == F.col("c_print")) & (F.col("label") == F.col("c_label"))
    return usable.join(chosen, same, "left_semi").select("label", F.substring("text", 1, longest).alias("text"))


def gram_counts(sample: DataFrame) -> DataFrame:
    """label, size, gram, n: how often every byte string of 1 .. order + 1 bytes occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by_label: dict[str, list[bytes]] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_label.setdefault(label, []).append(text.encode("utf-8", "replace"))
            for label, raws in by_label.items():
                found = [grams_of(raw) for raw in raws]
                for size in range(1, ORDER + 2):
                    grams, n = np.unique(np.concatenate([f[size - 1] for f in found]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(grams)), pa.array([size] * len(grams), pa.int32()),
                         pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["label", "size", "gram", "n"])

    counted = sample.mapInArrow(run, "label string, size int, gram bigint, n bigint")
    return counted.groupBy("label", "size", "gram").agg(F.sum("n").alias("n"))


def grams_of(raw: bytes) -> list[np.ndarray]:
    """By size, the strings that end at each byte of the text, as big-endian numbers."""
    data = np.frombuffer(PAD + raw, np.uint8).astype(np.int64)
    last = data[ORDER:]
    value, out = np.zeros(len(last), np.int64), []
    for back in range(ORDER + 1):
        value = value + (data[ORDER - back : len(data) - back] << (8 * back))
        out.append(value)
    return out


def fit(docs: DataFrame, label: str = "lang", rows_per_language: int = 400, longest: int = 20_000) -> Trees | None:
    """Trees from the labelled rows of `docs`; None when there are none."""
    counts = gram_counts(learning_sample(docs, label, rows_per_language, longest)).toPandas()
    return build(counts) if len(counts) else None


def build(counts) -> Trees:
    languages = sorted(counts["label"].unique(), key=lambda name: name.encode())
    column = counts["label"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    size, gram, n = (counts[c].to_numpy() for c in ("size", "gram", "n"))
    known = {s: np.unique(gram[size == s]) for s in range(2, ORDER + 2)}
    known[1] = np.arange(256)
    for s in range(ORDER + 1, 2, -1):  # every prefix and suffix of a known string is known
        known[s - 1] = np.unique(np.concatenate([known[s - 1], known[s] >> 8, known[s] & ((1 << 8 * (s - 1)) - 1)]))
    code, escape = [], []
    shorter = np.full((1, len(languages)), 8.0)
    for s in range(1, ORDER + 2):
        grams = known[s]
        seen = np.zeros((len(grams), len(languages)))
        mine = size == s
        seen[np.searchsorted(grams, gram[mine]), column[mine]] = n[mine]
        parents = np.searchsorted(known[s - 1], grams >> 8) if s > 1 else np.zeros(len(grams), int)
        suffix = np.searchsorted(known[s - 1], grams & ((1 << 8 * (s - 1)) - 1)) if s > 1 else np.zeros(len(grams), int)
        contexts = len(known[s - 1]) if s > 1 else 1
        total, different = np.zeros((2, contexts, len(languages)))
        np.add.at(total, parents, seen)
        np.add.at(different, parents, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(different / (total + different)), 0.0)
            here = -np.log2(seen / (total + different)[parents])
        costs = np.where(seen > 0, here, leave[parents] + shorter[suffix])
        escape.append(leave)  # of the strings one byte shorter
        code.append(costs)
        shorter = costs
    return Trees(languages, [known[s] for s in range(2, ORDER + 2)], code, escape)


class Coder:
    """Code lengths of whole texts; steps through the tables by string numbers, -1 for unknown."""

    def __init__(self, trees: Trees):
        self.width = len(trees.languages)
        self.code = [np.vstack([c, np.zeros((1, self.width))]).astype(np.float32) for c in trees.code]
        self.escape = [np.vstack([e, np.zeros((1, self.width))]).astype(np.float32) for e in trees.escape]
        self.steps = []
        parents = np.arange(256)
        for grams in trees.grams:
            step = np.full((len(parents) + 1, 256), -1, np.int32)  # the last row is the unknown's
            step[np.searchsorted(parents, grams >> 8), grams & 255] = np.arange(len(grams))
            self.steps.append(step)
            parents = grams

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Bits by byte and language for data[ORDER:]; the first bytes are context."""
        numbers = [data.astype(np.int32)]
        for step in self.steps:
            longer = np.full(len(data), -1, np.int32)
            longer[1:] = step[numbers[-1][:-1], data[1:]]
            numbers.append(longer)
        out = self.code[-1][numbers[-1][ORDER:]]
        open_ = np.flatnonzero(numbers[-1][ORDER:] < 0)
        for level in range(ORDER - 1, -1, -1):  # the others escape from level to level
            if not len(open_):
                break
            at = open_ + ORDER
            out[open_] += self.escape[level + 1][numbers[level][at - 1]]
            found = numbers[level][at]
            known = found >= 0
            out[open_[known]] += self.code[level][found[known]]
            open_ = open_[~known]
        return out

    def lengths(self, raws: list[bytes]) -> np.ndarray:
        """Total bits by text and language."""
        out = np.zeros((len(raws), self.width))
        group, size = [], 0
        for i, raw in enumerate(raws):
            if len(raw) > BLOCK:
                padded = PAD + raw
                for start in range(0, len(raw), BLOCK):
                    out[i] += self.costs(np.frombuffer(padded[start : start + BLOCK + ORDER], np.uint8)).sum(0, np.float64)
            elif raw:
                group.append(i)
                size += len(raw)
            if group and (size > BLOCK or i == len(raws) - 1):
                out[group] = self.grouped([raws[j] for j in group])
                group, size = [], 0
        if group:
            out[group] = self.grouped([raws[j] for j in group])
        return out

    def grouped(self, raws: list[bytes]) -> np.ndarray:
        costs = self.costs(np.frombuffer(b"".join([PAD + raw for raw in raws]), np.uint8))
        starts = np.cumsum([0, *(len(raw) + ORDER for raw in raws[:-1])])
        bounds = np.column_stack([starts, starts + [len(raw) for raw in raws]]).ravel()
        return np.add.reduceat(np.vstack([costs, np.zeros((1, self.width), np.float32)]), bounds, 0, np.float64)[::2]


def predict(docs: DataFrame, trees: Trees | None, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte (of the shortest code) for every row, from its text
    alone; then the columns to keep."""
    shared = send(docs.sparkSession, (trees, trees and Recipe(Coder, trees)))
    schema = with_kept(docs, keep, "doc_id bigint, lang_pred string, score double, bits_per_byte double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, coder = shared_value(shared)
        for batch in slices(batches):
            found = judged(batch.column("text").to_pylist(), coder and coder.get(), trees)
            yield record(schema, [batch.column("doc_id"), *found], batch, keep)

    return texts(docs, *(name for name in keep if name != "text")).mapInArrow(run, schema)


def judged(found: list[str | None], coder: Coder | None, trees: Trees | None) -> list[pa.Array]:
    spoken = [bool(text and LETTER.search(text)) and coder is not None for text in found]
    raws = [text.encode("utf-8", "replace") if ok else b"" for text, ok in zip(found, spoken, strict=True)]
    if coder is None:
        return [pa.array([UNDETERMINED] * len(found)), pa.array([0.0] * len(found)), pa.nulls(len(found), pa.float64())]
    bits = coder.lengths(raws)
    best = bits.argmin(1) if len(bits) else np.zeros(0, int)
    least = bits.min(1) if len(bits) else np.zeros(0)
    posterior = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
    none = ~np.array(spoken, bool)
    return [
        pa.array([UNDETERMINED if n else trees.languages[b] for n, b in zip(none, best, strict=True)], pa.string()),
        pa.array(np.where(none, 0.0, posterior)),
        pa.array(least / np.maximum([len(raw) for raw in raws], 1), mask=none),
    ]
