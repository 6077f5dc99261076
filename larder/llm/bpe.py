"""Byte-level BPE with a hierarchical-bitmap rank queue.

A piece of text is a linked list of tokens. Every adjacent pair whose join has a rank waits
in the bucket of that rank; a two-level bitmap over the buckets yields the smallest rank
in use by find-first-set. Pairs that a merge has changed are left in their buckets and
skipped when they come up. A merge costs a constant number of queue steps, so a piece of
millions of bytes takes n log n time and not n squared.

Null text is the empty text: no ids, empty decoded bytes. Null doc_id and repeated rows pass
through row by row. Of equal pairs the leftmost merges first. Very long texts are cut by the pattern
one piece at a time. An empty table gives an empty result. Other columns are dropped, whatever
they are called.
"""

from __future__ import annotations

import array
import base64
import gc
import re
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from larder.llm.common import Recipe, record, send, shared_value, slices, texts, with_kept

# Code points that the installed `regex` counts as letters or numbers and
# tiktoken's older Unicode tables don't. To the pattern they are neither.
NEWER = (
    "՘ ֋-֌ ࢏ ౜ ೜ ₏ ₝-₟ ꟎-꟏ ꟒ ꟔ ꟝ ꟢ ꟱ "
    "꭬-꭭ \U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a "
    "\U00011db0-\U00011ddb \U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 "
    "\U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda "
    "\U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 "
    "\U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff "
    "\U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 "
    "\U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 "
    "\U0003d000-\U0003fc3f"
).replace(" ", "")
UNASSIGNED = "͸"

CACHED = 400_000  # entries of a generation; a cache has two, each entry some 200 bytes
CACHED_BYTES = 64
LONG_TEXT = 1 << 20
LOOSE_SPACE = re.compile(r" (?:\s|$)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class RankQueue:
    """Positions in buckets by rank: `low` has a bit per rank in words of 64, `top` a bit per
    word in use, so two find-first-sets lead to the smallest rank. A bucket yields its smallest
    position first. The queue is empty again when a piece is done."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (ranks // 64 + 1)
        self.bits = [1 << i for i in range(max(64, len(self.low)))]


class Encoder:
    """Ids of single pieces; holds the queue and bounded caches of short pieces and words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED):
        self.ranks, self.cached = ranks, cached
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.newer = regex.compile(f"[{NEWER}]")
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.cache, self.old_cache = {}, {}
        self.spaced, self.old_spaced = {}, {}

    def merge(self, piece: bytes) -> list[int]:
        """The queue's steps stand here in line: a call for each would double the time."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        size, rank_of = len(piece), ranks.get
        buckets, low, bits, top = self.queue.buckets, self.queue.low, self.queue.bits, 0
        waiting = buckets.get
        end = list(range(1, size + 1))  # of the token that starts here
        before = list(range(-1, size - 1))
        # rank of the token here joined with the next
        pair = [rank_of(piece[i : i + 2]) for i in range(size - 1)]
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                if (bucket := waiting(rank)) is None:
                    buckets[rank] = [i]
                    low[word := rank >> 6] |= bits[rank & 63]
                    top |= bits[word]
                else:
                    bucket.append(i)  # positions rise, so the list is a heap
        while top:
            word = (top & -top).bit_length() - 1
            used = low[word]
            first = used & -used
            rank = (word << 6) + first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                left = heappop(bucket)
            else:
                left = bucket[0]
                del buckets[rank]
                if used == first:
                    low[word] = 0
                    top &= top - 1
                else:
                    low[word] = used - first
            if pair[left] != rank:
                continue  # stale
            right = end[left]
            stop = end[left] = end[right]
            pair[right] = None
            if stop < size:
                before[stop] = left
                pair[left] = new = rank_of(piece[left : end[stop]])
                if new is not None:
                    if (bucket := waiting(new)) is None:
                        buckets[new] = [left]
                        low[word := new >> 6] |= bits[new & 63]
                        top |= bits[word]
                    else:
                        heappush(bucket, left)
            else:
                pair[left] = None
            if (previous := before[left]) >= 0:
                pair[previous] = new = rank_of(piece[previous:stop])
                if new is not None:
                    if (bucket := waiting(new)) is None:
                        buckets[new] = [previous]
                        low[word := new >> 6] |= bits[new & 63]
                        top |= bits[word]
                    else:
                        heappush(bucket, previous)
        ids, i = [], 0
        while i < size:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def piece(self, piece: str) -> bytes:
        """Ids as packed 32-bit integers."""
        found = self.cache.get(piece) or self.old_cache.get(piece)
        if found is None:
            found = array.array("i", self.merge(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= CACHED_BYTES:
            if len(self.cache) >= self.cached:
                self.cache, self.old_cache = {}, self.cache
            self.cache[piece] = found
        return found

    def after_space(self, word: str) -> bytes:
        """The same for a word and the space in front of it, by its pieces."""
        found = self.old_spaced.get(word) or self.joined(" " + word)
        if len(word) <= CACHED_BYTES:
            if len(self.spaced) >= self.cached:
                self.spaced, self.old_spaced = {}, self.spaced
            self.spaced[word] = found
        return found

    def joined(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def split(self, text: str) -> Iterable[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer.search(text):
                hidden = self.newer.sub(UNASSIGNED, text)
                return (text[m.start() : m.end()] for m in self.pieces.finditer(hidden))
        if len(text) > LONG_TEXT:
            return (m.group() for m in self.pieces.finditer(text))
        return self.pieces.findall(text)

    def encode(self, text: str | None, by_word: bool = True) -> bytes:
        """`by_word`: the pattern starts a piece at every space with a non-space behind it, so
        that words can be looked up whole; texts with other spaces go through the pattern."""
        if not text:
            return b""
        if not by_word or len(text) > LONG_TEXT or LOOSE_SPACE.search(text):
            return self.joined(text)
        first, *rest = text.split(" ")
        after_space = self.after_space
        found = [self.joined(first)] if first else []
        for start in range(0, len(rest), 4096):  # the dictionary may be replaced in between
            get = self.spaced.get
            found += [get(word) or after_space(word) for word in rest[start : start + 4096]]
        return b"".join(found)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, keep: Sequence[str] = (), cached: int = CACHED) -> DataFrame:
    """doc_id, ids array<int>, decoded binary (what the ids stand for) of every whole text; then
    the columns to keep.

    `cached` bounds what a worker remembers of words and pieces: time against memory, never
    the result. The vocabulary, a file of fixed size, travels to the tasks as one broadcast value.
    """
    shared = send(docs.sparkSession, Recipe(Encoder, read_ranks(vocabulary), pattern, cached))
    schema = with_kept(docs, keep, "doc_id bigint, ids array<int>, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 50, 100)  # the caches hold no cycles and would be searched for them again and again
        encoder = shared_value(shared).get()
        for batch in slices(batches):
            packed = [encoder.encode(text) for text in batch.column("text").to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(ids) // 4 for ids in packed], out=offsets[1:])
            decoded = [encoder.decode(memoryview(ids).cast("i")) for ids in packed]
            flat = np.frombuffer(b"".join(packed), np.int32)
            yield record(schema, [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat),
                                  pa.array(decoded, pa.binary())], batch, keep)

    return texts(docs, *(name for name in keep if name != "text")).mapInArrow(run, schema)
