"""Counting the tokens of a unigram vocabulary by Viterbi, without building the tokens.

White space is written as the vocabulary writes it (one mark per space, one in front of a
text). No piece holds a mark behind another character, so the lattice of a text falls apart
before every mark that follows a non-mark: each such segment is solved alone, short ones
once per task. An Aho-Corasick automaton lists the pieces that end at each character; the
dynamic programme carries the best score and its number of pieces only.

Tie rules are those of the unigram tokenizer: a later candidate must be strictly better, and
candidates come in order of their start, so the longest last piece wins. A character no piece
covers costs the lowest score less 10 and is replaced by its bytes' pieces (or counts as one
unknown piece together with its unknown neighbours when the vocabulary has no byte pieces).

Null or empty text: no pieces, score 0. Repeated rows and null doc_id pass through. Very long texts
are solved segment by segment, a segment of any length in memory in proportion to it. An empty
table gives an empty result; other columns stay behind, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from larder.llm.common import Recipe, send, shared_value, texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_SEGMENTS = 300_000
CACHED_CHARS = 64
SEGMENT = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = (i for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in usual]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


class Lattice:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.cache: dict[str, tuple[int, float, int]] = {}

    def solve(self, segment: str) -> tuple[int, float, int]:
        """Number of pieces, best score, number of unknown characters."""
        size = len(segment)
        starts: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, (length, score) in self.automaton.iter(segment):
            starts[end + 1 - length].append((end + 1, score))
        best: list[float | None] = [None] * (size + 1)
        best[0] = 0.0
        count, unknown, in_unknown = [0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for start in range(size):
            here, single = best[start], False
            for end, score in starts[start]:
                single |= end == start + 1
                if best[end] is None or here + score > best[end]:
                    best[end], count[end] = here + score, count[start] + 1
                    unknown[end], in_unknown[end] = unknown[start], False
            if not single and (best[start + 1] is None or here + self.unknown > best[start + 1]):
                end = start + 1
                best[end], unknown[end], in_unknown[end] = here + self.unknown, unknown[start] + 1, True
                if self.byte_fallback:
                    count[end] = count[start] + len(segment[start].encode("utf-8", "replace"))
                else:
                    count[end] = count[start] + (not in_unknown[start])
        return count[size], best[size], unknown[size]

    def segment(self, segment: str) -> tuple[int, float, int]:
        found = self.cache.get(segment)
        if found is None:
            found = self.solve(segment)
            if len(segment) <= CACHED_CHARS:
                if len(self.cache) >= CACHED_SEGMENTS:
                    self.cache.clear()
                self.cache[segment] = found
        return found

    def text(self, text: str | None) -> tuple[int, float, int]:
        if not text:
            return 0, 0.0, 0
        if "  " not in text and MARK not in text and text[-1] != " ":
            segments = [MARK + word for word in text.split(" ")]
            if text[0] == " ":
                segments[:2] = [MARK + segments[1]]
        else:
            segments = SEGMENT.findall(marked(text))
        get, solve = self.cache.get, self.segment
        found = [get(s) or solve(s) for s in segments]
        return sum([x[0] for x in found]), sum([x[1] for x in found]), sum([x[2] for x in found])


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_pieces, score (of the best segmentation), n_unknown (characters) per text.

    The vocabulary is a file of fixed size and travels as one broadcast value.
    """
    shared = send(docs.sparkSession, Recipe(Lattice, pieces, byte_fallback))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared_value(shared).get()
        for batch in batches:
            found = [lattice.text(text) for text in batch.column("text").to_pylist()]
            n, score, unknown = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(score, float)),
                 pa.array(unknown, pa.int64())],
                names=["doc_id", "n_pieces", "score", "n_unknown"],
            )

    return texts(docs).mapInArrow(run, "doc_id bigint, n_pieces bigint, score double, n_unknown bigint")
