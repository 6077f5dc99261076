"""Five stages from raw documents to encoded training text.

1. language: documents without a letter in any language (predicted `und`) go.
2. near copies: one document of each group of linked documents stays, the smallest doc_id. Two
   link at a similarity of 0.8 or more by runs of five words (op2 is registered with a stricter rule).
3. repeated passages: every byte of a 100-byte string that starts earlier is removed; a
   character cut in two goes whole. Documents with nothing left go; the rest keep their text.
4. mixing: every document is there as often as the mix takes it, the one at a source's
   border if at least half of it is taken. Documents without words are never taken.
5. encoding: ids of every text, and whether they decode to it.

Each stage reads the whole of what the one before kept. All but the last return the columns of
documents. Rows with null doc_id stay out of groups; null texts are empty and go in stage 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.bpe import encode_decode
from larder.llm.common import slices, table
from larder.llm.jaccard import link_documents
from larder.llm.language import UNDETERMINED, fit, predict, remainder
from larder.llm.mixing import measured, mix
from larder.llm.registry import MIX
from larder.llm.suffixes import remove_repeats
from larder.session import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def same_row(*names: str):
    condition = F.lit(True)
    for name in names:
        condition &= F.col(f"d.{name}").eqNullSafe(F.col(f"r.{name}"))
    return condition


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = fit(docs.where(remainder(3) != 1))
    if trees is None:  # no labelled row to learn from: only the letters decide
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    return predict(docs.select(*COLUMNS), trees, keep=COLUMNS[1:]).where(F.col("lang_pred") != UNDETERMINED).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = link_documents(docs, n=5, percent=80)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.select(*COLUMNS)
    first = named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return first.unionByName(named.where("doc_id IS NULL")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs.select(*COLUMNS), keep=COLUMNS[2:]).where("n_bytes = 0 OR n_removed < n_bytes")

    def readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = [raw.decode("utf-8", "ignore") for raw in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(text, pa.string()), batch.column("lang"), batch.column("source"),
                 pa.array([len(t) for t in text], pa.int64())], names=list(COLUMNS))

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return cut.select("doc_id", "kept", "lang", "source").mapInArrow(readable, schema).where("text <> ''")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = measured(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    taken = mix(sized, **MIX).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size") + 0.5)
    # rows that agree in all three are interchangeable and get the mean of their copies
    copies = taken.groupBy("doc_id", "source", "size").agg(F.round(F.avg(whole)).cast("int").alias("copies"))
    joined = sized.alias("d").join(copies.alias("r"), same_row("doc_id", "source", "size"))
    repeated = joined.select("d.*", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return repeated.select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # workers still hold what the stages before left: a smaller cache
    coded = encode_decode(docs, path, public_tokenizers.PATTERN, keep=("lang", "source", "text"), cached=80_000)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("encoded", encoded),
]

# Byte-wise removal and encoding are beyond SQL: tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
