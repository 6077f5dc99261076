"""Similarity join on word n-grams by T-occurrence search (DivideSkip).

A document is the set of fingerprints of its distinct n-word shingles. Two documents link when
`percent` * union <= 100 * intersection, so both sizes lie within that ratio and, with
k = (100 - percent) / (100 + percent), they differ in at most k * (size + size) shingles.

1. Equal sets become one class, represented by the smallest doc_id.
2. Where to search. Sizes fall into classes such that links join equal or neighbouring ones.
   For each class the shingles are dealt into groups of three parts, more groups than half the
   shingles that linked sets can differ in. So in some group at most one part differs, and two agree:
   the fingerprint of every two parts of a group is a signature. (Only if as many groups have
   two empty parts as must agree can all that agree be empty. Such a set deals anew with
   another seed, and so on; at the last level empty parts count as well.) Signatures travel packed, by
   ranges of their values. Sets that share one are tied to the smallest of them, so linked sets are
   tied to a common one.
3. Ruling out. Among the sets that are tied to one, the parities of the shingles' numbers by hash differ in no
   more places than the sets do in shingles. Pairs that differ in more than linked ones can are no
   links; the components of the others hold all links. So chance ties, whose number
   grows faster than the table, cost the bits of a set and not its text.
4. Search. In each component, or pair of blocks of a large one (by documents or shingles), an inverted file lists
   the documents of every shingle. A query must reach overlap T; its L longest lists are set
   aside, the short ones are merged, documents met at least T - L times are candidates, and
   the long lists are probed for those by binary search. Candidates that are joined to the
   query already need no probe. Each block gives a spanning forest of the links it finds.
5. Components of the links.

Documents without words link with nothing and are their own component. Rows that share a doc_id
are one node: the links of either hold for both. Rows with null doc_id link with nothing and
have a null component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import mixed, slices, texts, words
from larder.llm.graph import components
from larder.session import settle

BLOCK_DOCUMENTS = 2048
BLOCK_SHINGLES = 1_000_000
BLOCK_PARITIES = 16_000_000  # shingles as well: their parities take a quarter of a byte each at most
CHUNK = 100_000
SIGNED = 1 << 20  # signatures that a task packs at a time
RANGED = 1 << 19  # of a range of values, about
LEVELS = 6
CLASS_BITS = 8  # size classes of sets of up to 10^11 shingles at 0.9
CACHED_WORDS = 150_000
U64 = np.uint64


class WordPrints(dict):
    """63-bit fingerprints of words, kept up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word) >> 1
        if len(word) <= 64:
            self[word] = found
        return found


def shingle_sets(texts_: list[list[bytes]], n: int, prints: WordPrints) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by document, then fingerprint: number of the document and distinct shingles."""
    counts = np.array([len(ws) for ws in texts_], np.int64)
    flat = np.array([prints[w] for ws in texts_ for w in ws], np.int64).astype(U64)
    begins = np.cumsum(counts) - counts
    value = np.zeros(len(flat), U64)
    size = np.maximum(counts - n + 1, np.minimum(counts, 1))  # shingles of each document
    owner = np.repeat(np.arange(len(counts)), size)
    at = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(size.sum())
    value = np.full(len(at), 0, U64)
    width = np.minimum(counts, n)[owner]
    for i in range(n):
        on = width > i
        value[on] = mixed(value[on] + U64(0x9E3779B97F4A7C15)) * U64(0xA24BAED4963EE407) + flat[at[on] + i]
    value = mixed(value + width.astype(U64))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (np.diff(owner) != 0) | (value[1:] != value[:-1])
    return owner[new], value[new]


def size_classes(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each class, how many groups its sets are dealt into, and in how many of them
    linked sets agree in two parts at least."""
    first, groups, agree = [], [], []
    low = 1
    while True:
        high = low * 100 // percent
        half = 2 * high * (100 - percent) // (100 + percent) // 2
        first.append(low)
        groups.append(half + 2 + half // 8)
        agree.append(groups[-1] - half)
        if low > largest:
            return np.array(first), np.array(groups), np.array(agree)
        low = high + 1


def signatures(owner: np.ndarray, value: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the document and signature, for its own size class and the next; the class is
    the signature's last CLASS_BITS bits."""
    first, groups, agree = size_classes(int(sizes.max(initial=1)) + 1, percent)
    mine = np.searchsorted(first, sizes, "right") - 1
    out = [(np.zeros(0, np.int64), np.zeros(0, U64))]
    weight = mixed(value ^ U64(0x5851F42D4C957F2D))
    for step in (0, 1):
        scheme = np.minimum(mine + step, len(groups) - 1)
        active = sizes > 0
        for level in range(LEVELS):
            use = active[owner]
            own, many = owner[use], np.where(active, groups[scheme], 0)
            if not len(own):
                break
            begin = np.cumsum(many) - many
            spread = mixed(value[use] + U64((level + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) >> U64(32)
            part = 3 * begin[own] + ((spread * (3 * many[own]).astype(U64)) >> U64(32)).astype(np.int64)
            total = np.zeros(3 * many.sum(), U64)
            np.add.at(total, part, weight[use])
            count = np.bincount(part, minlength=len(total)).reshape(-1, 3)
            total = mixed(total).reshape(-1, 3)
            holder = np.repeat(np.arange(len(sizes)), many)
            place = np.arange(len(holder)) - begin[holder]
            label = mixed(scheme[holder].astype(U64) * U64(1 << 40) + place.astype(U64) * U64(16) + U64(level))
            weak = np.zeros(len(holder), bool)
            for one, other in ((0, 1), (0, 2), (1, 2)):
                both = count[:, one] + count[:, other]
                sign = mixed(total[:, one] * U64(3) + total[:, other] * U64(5) + mixed(label + U64(3 * one + other)))
                kept = (both > 0) | (level == LEVELS - 1)
                weak |= both == 0
                out.append((holder[kept], (sign[kept] >> U64(CLASS_BITS) << U64(CLASS_BITS)) | scheme[holder[kept]].astype(U64)))
            active &= np.bincount(holder[weak], minlength=len(sizes)) >= agree[scheme]
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def parities(owner: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For every set a bit per place of its shingles' hashes: whether an odd number falls there. The places
    are a power of two, from the set's size and 64 on, so that halves folded together are those of half as many."""
    places = np.where(sizes > 0, 64, 0)
    while (short := places < sizes).any():
        places[short] *= 2
    ends = np.cumsum(places)
    at = (ends - places)[owner] + ((value >> U64(20)).astype(np.int64) & (places[owner] - 1))
    bits = np.packbits((np.bincount(at, minlength=places.sum()) & 1).astype(bool))
    return [bits[end - many : end].tobytes() for many, end in zip((places // 8).tolist(), (ends // 8).tolist(), strict=True)]


def folded(bits: bytes, places: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(bits, U64).reshape(-1, places // 64), axis=0)


def not_ruled_out(sizes: np.ndarray, side: np.ndarray, bits: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a block (or, where `side` holds both 0 and 1, of those between
    the sides) whose parities differ in no more places than linked sets can in shingles."""
    turn = np.argsort(sizes, kind="stable")
    sizes, side, bits = sizes[turn], side[turn], [bits[i] for i in turn]
    label, found, mixed_sides = np.arange(len(sizes)), [], side.min(initial=0) != side.max(initial=0)
    last = np.searchsorted(sizes, sizes * 100 // percent, "right")  # larger ones that links reach
    begin = np.searchsorted(sizes, 1)
    while begin < len(sizes):
        places = 8 * len(bits[begin])
        end = np.searchsorted(sizes, places, "right")
        table = np.stack([folded(bits[i], places) for i in range(begin, last[end - 1])])
        for i in range(begin, end):
            others = slice(i + 1, last[i])
            differ = np.bitwise_count(table[i - begin] ^ table[i + 1 - begin : last[i] - begin]).sum(1, dtype=np.int64)
            near = (100 + percent) * differ <= (100 - percent) * (sizes[i] + sizes[others])
            near &= label[others] != label[i]
            if mixed_sides:
                near &= side[others] != side[i]
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    found.append((int(turn[i]), int(turn[j])))
        begin = end
    return found


def chunks(found: Iterable[str | None]) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Texts in groups of about CHUNK words, with the places of the first and of the one after the last."""
    group, size, start, stop = [], 0, 0, 0
    for stop, text in enumerate(found, 1):
        group.append(words(text))
        size += len(group[-1])
        if size >= CHUNK:
            yield start, stop, group
            group, size, start = [], 0, stop
    if group:
        yield start, stop, group


def described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, print_a, print_b (of the whole set), parities for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = WordPrints()
        for batch in slices(batches):
            for start, stop, group in chunks(batch.column("text").to_pylist()):
                owner, value = shingle_sets(group, n, prints)
                sizes = np.bincount(owner, minlength=len(group))
                halves = []
                for salt in (1, 2):
                    total = np.zeros(len(group), U64)
                    np.add.at(total, owner, mixed(value * U64(2 * salt + 1) + U64(salt)))
                    halves.append(mixed(total + sizes.astype(U64)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(sizes.astype(np.int64)), pa.array(halves[0]),
                     pa.array(halves[1]), pa.array(parities(owner, value, sizes), pa.binary())],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "parities"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, print_a bigint, print_b bigint, parities binary")


def signed(docs: DataFrame, n: int, percent: int, ranges: int) -> DataFrame:
    """part, found: the signatures of documents (doc_id, packed) by range of their values. Each is cut to
    48 bits; should two agree, sets are compared in vain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, unpacker = WordPrints(), zstandard.ZstdDecompressor()
        held, size = [], 0
        for batch in slices(batches):
            for start, _, group in chunks(unpacker.decompress(packed).decode() for packed in batch.column("packed").to_pylist()):
                owner, value = shingle_sets(group, n, prints)
                holder, sign = signatures(owner, value, np.bincount(owner, minlength=len(group)), percent)
                held.append((sign >> U64(16), batch.column("doc_id").to_numpy(zero_copy_only=False)[holder + start]))
                size += len(holder)
                if size >= SIGNED:
                    yield packed_signatures(held, ranges)
                    held, size = [], 0
        if size:
            yield packed_signatures(held, ranges)

    return docs.mapInArrow(run, "part bigint, found binary")


def packed_signatures(held: list[tuple[np.ndarray, np.ndarray]], ranges: int) -> pa.RecordBatch:
    """A row per range: how far each value is from the one before, then the doc_ids, both by planes of
    bytes, so that those which hardly vary take no room."""
    sign, ids = (np.concatenate(column) for column in zip(*held, strict=True))
    order = np.argsort(sign, kind="stable")
    sign, ids = sign[order], ids[order]
    parts, begins = np.unique((sign >> U64(16)) * U64(ranges) >> U64(32), return_index=True)
    packer, rows = zstandard.ZstdCompressor(level=1), []
    for begin, end in zip(begins, [*begins[1:], len(sign)], strict=True):
        steps = np.diff(sign[begin:end], prepend=U64(0))
        planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T for x in (steps, ids[begin:end])]
        rows.append(packer.compress(planes[0][:6].tobytes() + planes[1].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int64)), pa.array(rows, pa.binary())], names=["part", "found"])


def unpacked_signatures(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(found, np.uint8).reshape(14, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes[:6].T
    return np.cumsum(steps.view(U64).ravel()), np.ascontiguousarray(planes[6:].T).view(np.int64).ravel()


def ties(signs: DataFrame) -> DataFrame:
    """doc_id, hub: documents and the smallest one that shares a signature; rows come sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, part, held = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for number, found in zip(batch.column("part").to_pylist(), batch.column("found").to_pylist(), strict=True):
                if number != part:
                    if held:
                        yield found_ties(held)
                    part, held = number, []
                held.append(unpacked_signatures(unpacker.decompress(found)))
        if held:
            yield found_ties(held)

    return signs.mapInArrow(run, "doc_id bigint, hub bigint")


def found_ties(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sign, ids = (np.concatenate(column) for column in zip(*held, strict=True))
    order = np.argsort(sign, kind="stable")
    sign, ids = sign[order], ids[order]
    begins = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
    hub = np.repeat(np.minimum.reduceat(ids, begins), np.diff(np.r_[begins, len(sign)]))
    tied = np.unique(np.stack([ids, hub], 1)[ids != hub], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in tied.T], names=["doc_id", "hub"])


class Forest:
    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)


def search_links(owner: np.ndarray, value: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the documents of a block (or, where `side` holds
    both 0 and 1, of those between the sides)."""
    size = len(side)
    counts = np.bincount(owner, minlength=size)
    turn = np.argsort(counts, kind="stable")  # smaller sets first; places in this order from here on
    place = np.empty(size, np.int64)
    place[turn] = np.arange(size)
    sizes, sides = counts[turn], side[turn]
    shingles, lists = np.unique(value, return_inverse=True)
    entries = np.sort(lists.astype(np.int64) * size + place[owner])  # the inverted file: list, then document
    begins = np.searchsorted(entries, np.arange(len(shingles) + 1) * size)
    by_document = np.argsort(place[owner], kind="stable")
    own_lists, document_begins = lists[by_document], np.r_[0, np.cumsum(sizes)]
    forest, found, mixed_sides = Forest(size), [], side.min(initial=0) != side.max(initial=0)
    for query in range(size):
        own = own_lists[document_begins[query] : document_begins[query + 1]]
        lowest = np.searchsorted(sizes, -(-percent * len(own) // 100))
        if not len(own) or lowest >= query:
            continue
        least = -(-percent * len(own) // 100)  # T: what any partner of at most this size shares
        aside = least - max(1, -(-least // 16))  # L
        lengths = begins[own + 1] - begins[own]
        by_length = own[np.argsort(lengths, kind="stable")]
        short, long = by_length[: len(own) - aside], by_length[len(own) - aside :]
        start = np.searchsorted(entries, short * size + lowest)
        stop = np.searchsorted(entries, short * size + query)
        run = stop - start
        merged = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run) + np.repeat(start, run)
        partner, met = np.unique(entries[merged] % size, return_counts=True)
        enough = met >= least - aside
        if mixed_sides:
            enough &= sides[partner] != sides[query]
        partner, met = partner[enough], met[enough]
        order = np.argsort(-met, kind="stable")
        partner, met = partner[order], met[order]
        at_once = 1
        while len(partner):
            roots = np.array([forest.root(p) for p in partner])
            apart = roots != forest.root(query)
            partner, met, roots = partner[apart], met[apart], roots[apart]
            if not len(partner):
                break
            by_root = np.argsort(roots, kind="stable")
            first = np.r_[True, np.diff(roots[by_root]) != 0]
            rank = np.arange(len(roots)) - np.maximum.accumulate(np.where(first, np.arange(len(roots)), 0))
            probe = by_root[rank < at_once]  # the best few of every component
            keys = long[:, None] * size + partner[probe][None, :]
            spot = np.minimum(np.searchsorted(entries, keys.ravel()), len(entries) - 1).reshape(keys.shape)
            shared = met[probe] + (entries[spot] == keys).sum(0)
            union = len(own) + sizes[partner[probe]] - shared
            for p in partner[probe][100 * shared >= percent * union]:
                if forest.root(p) != forest.root(query):
                    forest.join(query, p)
                    found.append((int(turn[query]), int(turn[p])))
            rest = np.ones(len(partner), bool)
            rest[probe] = False
            partner, met = partner[rest], met[rest]
            at_once *= 2
    return found


def by_block(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """(side, doc_id, other columns) of every block of two rows or more; rows come sorted by block."""
    block, held = None, []
    for batch in batches:
        found = [batch.column(c).to_pylist() for c in ("component", "low", "high", "own", "doc_id", *columns)]
        for component, low, high, own, *row in zip(*found, strict=True):
            if (component, low, high) != block:
                if len(held) > 1:
                    yield held
                block, held = (component, low, high), []
            held.append((int(own != low), *row))
    if len(held) > 1:
        yield held


def pairs_of(ids: tuple, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ids[pair[i]] for pair in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def possible_in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of every block that may be links; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_block(batches, "n_shingles", "parities"):
            sides, ids, sizes, bits = zip(*held, strict=True)
            yield pairs_of(ids, not_ruled_out(np.array(sizes), np.array(sides), list(bits), percent))

    return members.mapInArrow(run, "a bigint, b bigint")


def links_in_blocks(members: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: links found in every block; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, unpacker = WordPrints(), zstandard.ZstdDecompressor()
        for held in by_block(batches, "packed"):
            sides, ids, packed = zip(*held, strict=True)
            found = [words(unpacker.decompress(text).decode("utf-8", "replace")) for text in packed]
            owner, value = shingle_sets(found, n, prints)
            yield pairs_of(ids, search_links(owner, value, np.array(sides), percent))

    return members.mapInArrow(run, "a bigint, b bigint")


def packed_texts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            packed = [packer.compress((text or "").encode("utf-8", "replace")) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id bigint, packed binary")


def in_blocks(groups: DataFrame, sizes: DataFrame, rows: DataFrame, most_documents: int, most_shingles: int) -> DataFrame:
    """The rows of the documents of `groups` (component, doc_id) by component and, where one is large, pair of its blocks."""
    needed = F.greatest(F.count(F.lit(1)) / most_documents, F.sum("n_shingles") / most_shingles)
    blocks = groups.join(sizes, "doc_id").groupBy("component").agg(F.ceil(needed).alias("blocks"))
    members = groups.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    members = members.select("component", "doc_id", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    members = members.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")
    # merged at every size: the members are a share of all documents, so no side stays small
    met = rows.join(members.hint("merge"), "doc_id")
    return met.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "doc_id")


def link_documents(docs: DataFrame, n: int = 3, percent: int = 90, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    docs = texts(docs)
    rows = settle(described(docs, n), "jaccard")
    linked = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("first"))
    # only one document of each class is signed: copies neither travel nor meet
    firsts = classes.select(F.col("first").alias("doc_id")).distinct()
    sizes = linked.join(classes.select("print_a", "print_b", F.col("first").alias("doc_id")), ["print_a", "print_b", "doc_id"], "left_semi").select(
        "doc_id", "n_shingles").distinct()
    shingles = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    signs = signed(packed_texts(docs).join(firsts, "doc_id", "left_semi"), n, percent, shingles // RANGED + 1)
    tied = settle(ties(signs.repartition("part").sortWithinPartitions("part")).distinct(), "jaccard")
    stars = tied.select(F.col("hub").alias("component"), "doc_id").unionByName(
        tied.select(F.col("hub").alias("component"), F.col("hub").alias("doc_id")).distinct())
    sketches = linked.select("doc_id", "n_shingles", "parities").distinct()
    possible = components(possible_in_blocks(in_blocks(stars, sizes, sketches, block_documents, BLOCK_PARITIES), percent))
    groups = possible.select("component", F.col("node").alias("doc_id"))
    searched = in_blocks(groups, sizes, packed_texts(docs), block_documents, BLOCK_SHINGLES)
    # classes with a common doc_id are one node
    same_id = classes_of_ids(linked, classes)
    found = components(links_in_blocks(searched, n, percent).unionByName(same_id))
    named = rows.join(classes, ["print_a", "print_b"], "left").join(
        found, F.col("first") == F.col("node"), "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "first")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def classes_of_ids(linked: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: ties between the classes of rows that share a doc_id."""
    several = linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    rows = linked.join(several, "doc_id").select("doc_id", "print_a", "print_b").join(classes, ["print_a", "print_b"])
    return rows.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
