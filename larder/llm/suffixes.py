"""Removing repeated long byte strings with a logarithmic family of suffix arrays.

Strings of `LENGTH` bytes are judged. In every window of that length the `GRAM`-byte string with
the smallest hash is its anchor, so equal windows have equal anchors at equal places, and
consecutive windows with one anchor form a run. The suffix array is a sparse one: it holds
the runs, about one per 38 bytes, ordered by the fingerprint of the anchor's string, then
of the whole run.

1. Scanning. Runs that an earlier run of the same Arrow batch equals are settled at once, so
   a passage that a third of all documents share reaches the index a few times per task. The
   others are dealt out by anchor.
2. Index family, one per partition. Rows arrive in document order and form batches; each
   becomes a sorted array and is merge-scanned against the levels, which hold the distinct
   runs seen so far. A run found there repeats as a whole. Then the array joins the levels:
   while the last two have about equal size they merge, so a run is merged a logarithmic number of times.
3. Distinct runs around one anchor string can still share windows (at the ends of copied
   passages). Only these runs are cut from their texts, brought together by anchor and
   compared window by window. Anchors with more than `hot` distinct runs are dealt out
   by window instead, so no task gets an unbounded group.
4. The intervals found meet their documents, whose texts travel compressed.

Windows, anchors and runs never cross documents. Fingerprints are 64 bits of the anchor plus
64 bits of the run or window.

Null and empty text: nothing to remove, kept is empty. Documents are ordered by doc_id, null
first. Rows that share doc_id and text are one document and get the same result; rows that
share only doc_id are ordered by a hash of their text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import mixed, record, slices, texts, with_kept
from larder.session import settle

LENGTH = 100
GRAM = 24
REACH = LENGTH - GRAM + 1  # anchors a window can have
BLOCK = 1 << 18
HOT = 100_000
BATCH_ROWS = 1 << 16

NO_ID = -(1 << 63)
RESOLVED = (127 << 7) | 127
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))
POWERS = np.cumprod(np.r_[U64(1), np.full(1 << 21, BASE)], dtype=U64)

KEYED = "to bigint, run bigint, doc bigint, place bigint"
FOUND = "doc bigint, tag int, start bigint, stop bigint, gram bigint, hot boolean"
COVER = "doc bigint, tag int, start bigint, stop bigint"


def running_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = h[i-1] * BASE + value, wrapped: built from sums of value * BASE^-i."""
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    down = np.cumprod(np.r_[U64(1), np.full(len(data), inverse)], dtype=U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(VALUES[data] * down[:-1], out=total[1:], dtype=U64)
    return total


def hashes(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of [start, stop); equal strings have equal ones wherever they are."""
    return mixed((total[stop] - total[start]) * powers(start) + (stop - start).astype(U64))


def powers(at: np.ndarray) -> np.ndarray:
    return POWERS[at]


def grams(data: np.ndarray) -> np.ndarray:
    """A fingerprint of the GRAM bytes at every position."""
    n = len(data) - GRAM + 1
    words = [np.ndarray((n,), "<u8", data, offset=8 * i, strides=(1,)) for i in range(GRAM // 8)]
    out = words[0] * U64(0xA0761D6478BD642F)
    for word, factor in zip(words[1:], (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3), strict=True):
        out = mixed(out) + word * U64(factor)
    return mixed(out)


def runs_of(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """first window, last window, anchor, anchor's fingerprint of every run in a block.

    `valid` marks the starts of windows that lie within one document."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    marks = grams(data)
    bits = U64(BLOCK * 2 - 1)
    low = (marks & ~bits) | np.arange(len(marks), dtype=U64)  # ties go to the leftmost
    width = 1
    while 2 * width <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    least = np.minimum(low[: len(data) - LENGTH + 1], low[REACH - width : REACH - width + len(data) - LENGTH + 1])
    at = np.flatnonzero(valid[: len(least)])
    anchor = (least[at] & bits).astype(np.int64)
    new = np.r_[True, (np.diff(anchor) != 0) | (np.diff(at) != 1)] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1 if len(first) else first
    return at[first], at[last], anchor[first], marks[anchor[first]]


def blocks_of(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, valid window starts, and for each piece its document and place there."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for i, raw in enumerate(raws):
        for start in range(0, max(len(raw) - LENGTH + 1, 0), BLOCK):
            piece = raw[start : start + BLOCK + LENGTH - 1]
            if size + len(piece) > 2 * BLOCK - 1:
                yield block(group)
                group, size = [], 0
            group.append((i, start, piece))
            size += len(piece)
    if group:
        yield block(group)


def block(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(piece) for _, _, piece in group])
    begins = np.cumsum(lengths) - lengths
    valid = np.ones(lengths.sum(), bool)
    for begin, length in zip(begins, lengths, strict=True):
        valid[begin + length - LENGTH + 1 : begin + length] = False
    owner = np.array([i for i, _, _ in group])
    data = np.frombuffer(b"".join([piece for _, _, piece in group]), np.uint8)
    return data, valid, begins, np.stack([owner, np.array([s for _, s, _ in group])])


def pack(tag: np.ndarray, low: np.ndarray, anchor: np.ndarray | int, last: np.ndarray | int) -> np.ndarray:
    return (tag.astype(np.int64) << 45) | (low.astype(np.int64) << 14) | (anchor << 7) | last


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return place >> 45, (place >> 14) & ((1 << 31) - 1), (place >> 7) & 127, place & 127


def first_of_equals(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """In sorted order: whether a row differs from the one before in any column."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return new


def split_repeats(gram, run, doc, place):
    """Places of the rows to keep (first of equal runs, by document) and of those that repeat one.

    The same run given twice (from a repeated row) is neither."""
    order = np.lexsort((place, doc, run, gram))
    new = first_of_equals(order, gram, run)
    twice = ~first_of_equals(order, gram, run, doc, place)
    return order[new], order[~new & ~twice]


def scanned(docs: DataFrame) -> DataFrame:
    """Runs that have to be looked up, and (marked RESOLVED, with the end in `run`) settled ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            raws = [(text or "").encode("utf-8", "replace") for text in batch.column("text").to_pylist()]
            ids, tags = np.asarray(batch.column("doc")), np.asarray(batch.column("tag"))
            parts = []
            for data, valid, begins, owners in blocks_of(raws):
                low, high, anchor, mark = runs_of(data, valid)
                piece = np.searchsorted(begins, low, "right") - 1
                content = hashes(running_hash(data), low, high + LENGTH) ^ mixed((anchor - low).astype(U64))
                owner, shift = owners[:, piece]
                place = pack(tags[owner], low - begins[piece] + shift, anchor - low, high - low)
                parts.append((mark.astype(np.int64), content.astype(np.int64), ids[owner], place))
            if not parts:
                continue
            gram, run, doc, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            kept, repeats = split_repeats(gram, run, doc, place)
            doc_r, tag_r, start, stop = joined_covers(doc[repeats], *covers_of(place[repeats]))
            to = np.r_[gram[kept], mixed(doc_r.astype(U64) * BASE + start.astype(U64)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(np.r_[run[kept], stop]), pa.array(np.r_[doc[kept], doc_r]),
                 pa.array(np.r_[place[kept], pack(tag_r, start, 127, 127)])], names=["to", "run", "doc", "place"])

    return docs.mapInArrow(scan, KEYED)


def covers_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tag, low, _, last = unpack(place)
    return tag, low, low + last + LENGTH


def joined_covers(doc, tag, start, stop):
    """Overlapping or touching intervals of a document made one."""
    if not len(doc):
        return doc, tag, start, stop
    order = np.lexsort((start, tag, doc))
    doc, tag, start, stop = doc[order], tag[order], start[order], stop[order]
    other = np.r_[True, (np.diff(doc) != 0) | (np.diff(tag) != 0)]
    # the furthest end so far, kept apart by document
    number = np.cumsum(other) - 1
    far = np.maximum.accumulate(stop + (number << 32)) - (number << 32)
    new = other.copy()
    new[1:] |= start[1:] > far[:-1]
    first = np.flatnonzero(new)
    return doc[first], tag[first], start[first], far[np.r_[first[1:], len(doc)] - 1]


class Family:
    """Levels of distinct runs (gram, run, doc, place), each sorted by gram and run."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> np.ndarray:
        """Scans a batch of rows in document order against all levels; gives the places that repeat."""
        kept, repeats = split_repeats(*batch)
        array, found = batch[:, kept], [batch[:, repeats]]
        for level in self.levels:
            both = np.concatenate([level, array], 1)
            order = np.lexsort((np.arange(both.shape[1]), both[1], both[0]))
            known = ~first_of_equals(order, both[0], both[1])
            same = ~first_of_equals(order, *both)
            mine = order >= level.shape[1]
            found.append(both[:, order[known & ~same & mine]])
            array = both[:, order[mine & ~known]]
        if array.shape[1]:
            self.levels.append(array)
        while len(self.levels) > 1 and 2 * self.levels[-1].shape[1] > self.levels[-2].shape[1]:
            self.merge()
        return np.concatenate(found, 1)

    def merge(self) -> None:
        both = np.concatenate(self.levels[-2:], 1)
        self.levels[-2:] = [both[:, np.lexsort((both[1], both[0]))]]

    def whole(self) -> np.ndarray:
        while len(self.levels) > 1:
            self.merge()
        return self.levels[0] if self.levels else np.zeros((4, 0), np.int64)


def looked_up(keyed: DataFrame, batch_rows: int, hot: int) -> DataFrame:
    """Whole runs that repeat, and the distinct runs that share an anchor with others (`gram` set)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, size = Family(), [], 0
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c)) for c in ("to", "run", "doc", "place")])
            settled = (rows[3] & RESOLVED) == RESOLVED
            if settled.any():
                tag, start, _, _ = unpack(rows[3, settled])
                yield found_batch(rows[2, settled], tag, start, rows[1, settled])
            held.append(rows[:, ~settled])
            size += held[-1].shape[1]
            if size >= batch_rows:
                yield repeated(family.add(np.concatenate(held, 1)))
                held, size = [], 0
        if size:
            yield repeated(family.add(np.concatenate(held, 1)))
        rest = family.whole()
        new = first_of_equals(np.arange(rest.shape[1]), rest[0])
        count = np.bincount(np.cumsum(new) - 1, minlength=1)[np.cumsum(new) - 1] if rest.shape[1] else np.zeros(0, int)
        for start in range(0, rest.shape[1], batch_rows):
            part = slice(start, start + batch_rows)
            several = count[part] > 1
            gram, _, doc, place = rest[:, part][:, several]
            tag, low, _, last = unpack(place)
            yield found_batch(doc, tag, low, low + last, gram, count[part][several] > hot)

    return keyed.mapInArrow(scan, FOUND)


def repeated(rows: np.ndarray) -> pa.RecordBatch:
    return found_batch(*joined_covers(rows[2], *covers_of(rows[3])))


def found_batch(doc, tag, start, stop, gram=None, hot=None) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(tag.astype(np.int32)), pa.array(start, pa.int64()), pa.array(stop, pa.int64()),
         pa.nulls(n, pa.int64()) if gram is None else pa.array(gram, pa.int64()),
         pa.nulls(n, pa.bool_()) if hot is None else pa.array(hot, pa.bool_())],
        names=["doc", "tag", "start", "stop", "gram", "hot"])


def cut_out(asked: DataFrame) -> DataFrame:
    """key, check, doc, place, run_text: the runs to compare; those of hot anchors window by window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for doc, tag, packed, runs in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "packed", "runs")), strict=True):
                raw = unpacker.decompress(packed)
                for run in runs:
                    low, high = run["start"], run["stop"]
                    if not run["hot"]:
                        rows.append((run["gram"], 0, doc, tag, low, high - low, raw[low : high + LENGTH]))
                        continue
                    data = np.frombuffer(raw[low : high + LENGTH], np.uint8)
                    starts = np.arange(high - low + 1)
                    prints = hashes(running_hash(data), starts, starts + LENGTH)
                    keys = mixed(prints ^ U64(run["gram"] & (1 << 64) - 1))
                    rows += [(key, check, doc, tag, low + i, 0, b"") for i, (key, check) in enumerate(
                        zip(keys.astype(np.int64).tolist(), prints.astype(np.int64).tolist(), strict=True))]
                if len(rows) > 20_000:
                    yield cut_batch(rows)
                    rows = []
            if rows:
                yield cut_batch(rows)

    return asked.mapInArrow(cut, "key bigint, check bigint, doc bigint, place bigint, run_text binary")


def cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    key, check, doc, tag, low, last, text = zip(*rows, strict=True)
    place = pack(np.array(tag), np.array(low), 0, np.array(last))
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(check, pa.int64()), pa.array(doc, pa.int64()), pa.array(place), pa.array(text, pa.binary())],
        names=["key", "check", "doc", "place", "run_text"])


def compared(runs: DataFrame) -> DataFrame:
    """Intervals of windows that an earlier run with the same key holds too. Rows come by key, then document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            keys = np.asarray(held["key"])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            if whole >= 10_000:
                yield from windows_seen(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield from windows_seen(held)

    dealt = runs.repartition("key").sortWithinPartitions("key", "doc", "place")
    return dealt.mapInArrow(scan, COVER)


def windows_seen(table: pa.Table) -> Iterator[pa.RecordBatch]:
    keys = np.asarray(table["key"])
    starts = np.r_[np.flatnonzero(first_of_equals(np.arange(len(keys)), keys)), len(keys)]
    begin = 0
    while begin < len(starts) - 1:  # some whole groups at a time
        end = int(np.searchsorted(starts, starts[begin] + 10_000, "right")) - 1
        end = max(end, begin + 1)
        yield group_windows(table.slice(starts[begin], starts[end] - starts[begin]))
        begin = end


def group_windows(table: pa.Table) -> pa.RecordBatch:
    key, check, doc, place = (np.asarray(table[c]) for c in ("key", "check", "doc", "place"))
    once = first_of_equals(np.arange(len(key)), key, check, doc, place)
    found = table["run_text"].to_pylist()
    tag, low, _, last = unpack(place)
    empty = np.array([not text for text in found])
    print_of: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    shift: list[np.ndarray] = []
    rows = np.flatnonzero(~empty & once)
    for start in range(0, len(rows), 5_000):
        some = rows[start : start + 5_000]
        data = np.frombuffer(b"".join([found[i] for i in some]), np.uint8)
        begins = np.cumsum([0, *(len(found[i]) for i in some[:-1])])
        many = last[some] + 1
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(begins, many) + step
        print_of.append(hashes(running_hash(data), at, at + LENGTH))
        owner.append(np.repeat(some, many))
        shift.append(step)
    single = np.flatnonzero(empty & once)
    owner.append(single)
    shift.append(np.zeros(len(single), np.int64))
    print_of.append(check[single].astype(U64))
    owners, shifts, prints = (np.concatenate(x) for x in (owner, shift, print_of))
    order = np.argsort(owners, kind="stable")
    owners, shifts, prints = owners[order], shifts[order], prints[order]
    # a window's text fixes its place beside the anchor, so key and window decide
    order = np.lexsort((owners, prints, key[owners]))
    new = first_of_equals(order, key[owners], prints)
    again = np.sort(order[~new])
    rows_again, start = owners[again], low[owners[again]] + shifts[again]
    return cover_batch(*joined_covers(doc[rows_again], tag[rows_again], start, start + LENGTH))


def cover_batch(doc, tag, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(tag.astype(np.int32)), pa.array(start, pa.int64()), pa.array(stop, pa.int64())],
        names=["doc", "tag", "start", "stop"])


def compressed(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    schema = with_kept(docs, keep, "doc_id bigint, doc bigint, tag int, packed binary")

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            packed = [packer.compress((text or "").encode("utf-8", "replace")) for text in batch.column("text").to_pylist()]
            yield record(schema, [batch.column(c) for c in ("doc_id", "doc", "tag")] + [pa.array(packed, pa.binary())], batch, keep)

    return docs.mapInArrow(pack_texts, schema)


def keyed_documents(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    tag: Column = F.pmod(F.xxhash64("text"), F.lit((1 << 18) - 1)).cast("int")
    return texts(docs, *keep).select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), tag.alias("tag"), *keep)


def remove_repeats(docs: DataFrame, batch_rows: int = BATCH_ROWS, hot: int = HOT, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row; then the columns to keep."""
    keyed = keyed_documents(docs, keep)
    dealt = scanned(keyed.select("text", "doc", "tag")).repartition("to").sortWithinPartitions("doc", "place")
    found = settle(looked_up(dealt, batch_rows, hot), "suffixes")
    packed = compressed(keyed, keep)
    asks = found.where(F.col("gram").isNotNull()).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("start", "stop", "gram", "hot")).alias("runs"))
    parts = compared(cut_out(compressed(keyed, ()).drop("doc_id").join(asks, ["doc", "tag"])))
    covers = found.where(F.col("gram").isNull()).select("doc", "tag", "start", "stop").unionByName(parts)
    by_document = covers.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("covers"))
    joined = packed.join(by_document, ["doc", "tag"], "left").select("doc_id", "packed", "covers", *keep)
    schema = with_kept(docs, keep, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            rows = [remaining(unpacker.decompress(packed), covers or ())
                    for packed, covers in zip(batch.column("packed").to_pylist(), batch.column("covers").to_pylist(), strict=True)]
            size, removed, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield record(schema, [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (size, removed, spans)),
                                  pa.array(kept, pa.binary())], batch, keep)

    return joined.mapInArrow(rest, schema)


def remaining(raw: bytes, covers: list[dict]) -> tuple[int, int, int, bytes]:
    spans: list[list[int]] = []
    for start, stop in sorted((c["start"], c["stop"]) for c in covers):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    kept, at = [], 0
    for start, stop in spans:
        kept.append(raw[at:start])
        at = stop
    kept.append(raw[at:])
    return len(raw), sum(b - a for a, b in spans), len(spans), b"".join(kept)
