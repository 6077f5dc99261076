"""Substring deduplication by sliding sentence spans.

A sentence ends with a word that ends in ., ! or ?, or before a line break. Passages often start or
end inside a sentence, so long sentences are cut further into parts, at places that follow from
the REACH words on either side alone: after a word of lower rank than all of those, where words
before , ; or : rank first, then all by a hash. No sentence ends within that reach, so
sentences of up to REACH words stay whole, and a passage is cut alike whatever surrounds it.

A span starts at every part and takes consecutive parts until it has `run` of them and `least`
words. Its words (lower case A-Z) are hashed to 128 bits, and spans are grouped over all
documents. The first occurrence, by doc_id, then place in the text, stays; every part covered
by any other occurrence is removed. A repeat below `least` words is ordinary language and no
span; with parts of up to 12 words every repeat of 47 words holds a span of 25.

Hashes are counted with a partial aggregation. Places of spans that repeat are written down; those of
very frequent spans stay where they are, by a broadcast of these spans (at most HOT_SPANS,
which follows from how they are chosen). First places are the minima of what was written,
and a document's removals are its places without the first ones, so no span's places are
gathered. The text itself is shuffled once, to meet the removals of its document.

Null or empty text: no sentences, text kept as it is. Texts with fewer words than `least` or
fewer parts than `run` have no spans. Very long texts are cut by whole arrays, their spans
leave in slices. Rows that share doc_id and text are one document: both are treated
as the document is. Rows that share a doc_id only are ordered by the hash of their text. Null
doc_id comes first. An empty table gives an empty result; other columns stay behind.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices, texts
from larder.llm.likelihood import string_prints
from larder.session import settle

REACH = 3
HOT_SPANS = 200_000
LEAST_HOT = 1000
HELD_SPANS = 100_000
SEGMENT = 1 << 20
ENDS, PAUSES = b".!?", b",;:"


def word_ranks(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Ranks of the lower-case words data[start:stop]: those with a pause first, then by a hash."""
    found = np.zeros(len(start), np.int64)
    for part in np.split(np.arange(len(start)), np.unique(np.searchsorted(start, np.arange(SEGMENT, len(data), SEGMENT)))):
        if len(part):
            at, end = start[part[0]], stop[part[-1]]
            found[part] = (string_prints(data[at:end], start[part] - at, stop[part] - at) >> np.uint64(31)).astype(np.int64)
    return found + np.where(np.isin(data[stop - 1], np.frombuffer(PAUSES, np.uint8)), 1, 1 << 33)


@dataclass
class Cut:
    """A text as words and parts: part i has the words first[i] .. first[i + 1] - 1."""

    raw: bytes
    start: np.ndarray  # byte where each word starts
    length: np.ndarray
    first: np.ndarray
    sentences: int

    @property
    def parts(self) -> int:
        return len(self.first) - 1

    def spans(self, run: int, least: int) -> np.ndarray:
        """For the parts that start a span, in order: the part after the span's last."""
        stop = np.searchsorted(self.first, self.first[:-1] + least)
        stop = np.maximum(stop, np.arange(self.parts) + run)
        return stop[stop <= self.parts]

    def hashes(self, stops: np.ndarray) -> bytes:
        plain = b" ".join(self.raw.lower().split())
        place = np.zeros(len(self.length) + 1, np.int64)
        np.cumsum(self.length + 1, out=place[1:])  # where each word starts in `plain`
        begin, end = place[self.first[: len(stops)]].tolist(), (place[self.first[stops]] - 1).tolist()
        return b"".join([xxhash.xxh3_128_digest(plain[a:b]) for a, b in zip(begin, end, strict=True)])

    def without(self, gone: np.ndarray) -> str:
        """The text without the marked parts; white space goes with the part before it."""
        at = [0, *self.start[self.first[1:-1]].tolist(), len(self.raw)]
        return b"".join([self.raw[a:b] for a, b, out in zip(at, at[1:], gone.tolist(), strict=False) if not out]).decode("utf-8", "replace")


def cuts(found: Iterable[str | None]) -> Iterator[Cut]:
    """Every text cut, some SEGMENT bytes at a time."""
    raws, size = [], 0
    for text in found:
        raws.append((text or "").encode("utf-8", "replace"))
        size += len(raws[-1])
        if size >= SEGMENT:
            yield from cut(raws)
            raws, size = [], 0
    if raws:
        yield from cut(raws)


def cut(raws: list[bytes]) -> Iterator[Cut]:
    data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)  # a line break ends each text
    begin = np.cumsum([0, *(len(raw) + 1 for raw in raws)])
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edge = edge if blank[0] else np.concatenate([[0], edge])
    start, stop = edge[::2], edge[1::2]
    lines = np.flatnonzero(data == 10)
    last = np.isin(data[stop - 1], np.frombuffer(ENDS, np.uint8))
    last[:-1] |= np.searchsorted(lines, start[1:]) > np.searchsorted(lines, stop[:-1])
    last[-1:] = True
    small = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    rank = np.where(last, 0, word_ranks(small, start, stop))
    padded = np.concatenate([np.zeros(REACH, np.int64), rank, np.zeros(REACH, np.int64)])
    lowest = rank > 0
    for k in range(1, REACH + 1):
        lowest &= (rank < padded[REACH - k : len(padded) - REACH - k]) & (rank <= padded[REACH + k : len(padded) - REACH + k])
    ends = np.flatnonzero(last | lowest) + 1
    words = np.searchsorted(start, begin)
    parts = np.searchsorted(ends, words, "right")
    for i, raw in enumerate(raws):
        a, b = words[i], words[i + 1]
        first = np.zeros(parts[i + 1] - parts[i] + 1, np.int64)
        first[1:] = ends[parts[i] : parts[i + 1]] - a
        yield Cut(raw, start[a:b] - begin[i], stop[a:b] - start[a:b], first, int(last[a:b].sum()))


def spans(keyed: DataFrame, run: int, least: int) -> DataFrame:
    """span (two halves), doc_id, place (tag of the text, then part): a row per span."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held, size = [], 0
            every = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag")), cuts(batch.column("text").to_pylist()), strict=True)
            for doc_id, tag, document in every:
                found = np.frombuffer(document.hashes(document.spans(run, least)), np.int64).reshape(-1, 2)
                if len(found):
                    held.append((found, doc_id, (tag << 32) + np.arange(len(found))))
                    size += len(found)
                if size >= HELD_SPANS:
                    yield from packed(held)
                    held, size = [], 0
            if held:
                yield from packed(held)

    return keyed.mapInArrow(each, "span_a bigint, span_b bigint, doc_id bigint, place bigint")


def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    found = np.concatenate([f for f, _, _ in held])
    ids = pa.array([doc_id for _, doc_id, _ in held], pa.int64()).take(
        pa.array(np.repeat(np.arange(len(held)), [len(f) for f, _, _ in held])))
    yield from slices([pa.RecordBatch.from_arrays(
        [pa.array(found[:, 0]), pa.array(found[:, 1]), ids, pa.array(np.concatenate([p for _, _, p in held]))],
        names=["span_a", "span_b", "doc_id", "place"])], HELD_SPANS)


def places_of_repeated(every: DataFrame) -> DataFrame:
    """The rows of `every` whose span occurs more than once.

    A span with more places than a HOT_SPANS-th of all that repeat is hot. There are at most HOT_SPANS
    of these: they are broadcast, and their rows stay spread. All others meet their count by a join.
    """
    several = settle(every.groupBy("span_a", "span_b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "spans")
    bound = several.agg(F.sum("n")).first()[0]
    hot = several.where(F.col("n") > max(LEAST_HOT, (bound or 0) // HOT_SPANS)).select(
        F.col("span_a").alias("hot_a"), F.col("span_b").alias("hot_b"))
    marked = every.join(F.broadcast(hot), (F.col("span_a") == F.col("hot_a")) & (F.col("span_b") == F.col("hot_b")), "left")
    known = F.col("hot_a").isNotNull()
    # rows of hot spans need no partner: they go by their place instead
    key = F.when(known, F.xxhash64("doc_id", "place")).otherwise(F.col("span_a"))
    cold = several.select(F.col("span_a").alias("key"), F.col("span_b").alias("cold_b"), F.col("n"))
    met = marked.withColumn("at", key).join(cold, (F.col("at") == F.col("key")) & (F.col("span_b") == F.col("cold_b")), "left")
    return settle(met.where(known | F.col("n").isNotNull()).select("span_a", "span_b", "doc_id", "place"), "spans")


def remove_repeated_spans(docs: DataFrame, run: int = 3, least: int = 25) -> DataFrame:
    """doc_id, n_sentences, n_parts, n_removed (parts), kept_text for every row."""
    keyed = texts(docs).withColumn("tag", F.pmod(F.xxhash64("text"), F.lit((1 << 31) - 1)))
    places = places_of_repeated(spans(keyed, run, least))
    first = places.groupBy("span_a", "span_b").agg(F.min(F.struct("doc_id", "place")).alias("first")).select(
        "first.doc_id", "first.place", F.lit(True).alias("stays"))
    part = F.col("place").bitwiseAND((1 << 32) - 1)
    removals = places.select("doc_id", "place", F.lit(False).alias("stays")).unionByName(first).groupBy(
        "doc_id", F.shiftright("place", 32).alias("tag")).agg(F.array_except(
            F.collect_set(F.when(~F.col("stays"), part)), F.collect_set(F.when(F.col("stays"), part))).alias("removed"))
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.tag") == F.col("r.tag"))
    joined = keyed.alias("d").join(removals.alias("r"), same, "left").select("d.doc_id", "d.text", "r.removed")

    def remain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = batch.column("text").to_pylist()
            out = [without(document, text, removed, run, least)
                   for document, text, removed in zip(cuts(found), found, batch.column("removed").to_pylist(), strict=True)]
            sentences, parts, gone, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in (sentences, parts, gone)), pa.array(kept, pa.string())],
                names=["doc_id", "n_sentences", "n_parts", "n_removed", "kept_text"])

    return joined.mapInArrow(remain, "doc_id bigint, n_sentences bigint, n_parts bigint, n_removed bigint, kept_text string")


def without(document: Cut, text: str | None, removed: list[int] | None, run: int, least: int) -> tuple[int, int, int, str | None]:
    if not removed:
        return document.sentences, document.parts, 0, text
    at = np.array(removed, np.int64)
    change = np.zeros(document.parts + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, document.spans(run, least)[at], -1)
    gone = np.cumsum(change)[:-1] > 0
    return document.sentences, document.parts, int(gone.sum()), document.without(gone)
