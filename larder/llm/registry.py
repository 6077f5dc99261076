"""The operators applied to whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import scans
from larder.llm.annuli import exact_top
from larder.llm.audit import audit, failures
from larder.llm.bpe import encode_decode
from larder.llm.common import table
from larder.llm.jaccard import link_documents
from larder.llm.language import fit, predict, remainder
from larder.llm.licenses import scan, summary
from larder.llm.likelihood import score_documents
from larder.llm.mixing import measured, mix
from larder.llm.permutation import approximate_neighbours
from larder.llm.pieces import read_pieces, token_counts
from larder.llm.quantiser import digest, quantise, with_group_error
from larder.llm.spans import remove_repeated_spans
from larder.llm.suffixes import remove_repeats

MIX = {"weights": (3, 1, 2), "share": 1.5, "most": 2.0}


def op1_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(table(spark, sf_dir, "documents"), pieces)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(measured(table(spark, sf_dir, "documents")), **MIX)


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return score_documents(table(spark, sf_dir, "documents"), pieces)


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_parts", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = fit(docs.where(remainder(3) != 1))
    return predict(docs, trees).withColumn("held_out", remainder(3) == 1).select("doc_id", "held_out", "lang_pred", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
    )
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantise(table(spark, sf_dir, "embeddings"), parts=4, entries=256, scale=1024, rounds=4, keep=("label",))
    code = F.concat(*(F.lpad(F.lower(F.hex(F.col("indexes")[p])), 2, "0") for p in range(4)))
    return with_group_error(coded, "label").select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scan(table(spark, sf_dir, "documents"), keep=("doc_id",)), "doc_id")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_suffix_arrays": op1_suffix_arrays,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_counts": op3_token_counts,
    "op4_neighbours": op4_neighbours,
    "op5_mixing": op5_mixing,
    "op6_top_products": op6_top_products,
    "op7_lattice_likelihood": op7_lattice_likelihood,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_language": op9_language,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_licenses": op12_licenses,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_suffix_arrays": """
        WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        windows AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w
            FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM docs)
        ), repeats AS (
            SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, p) > 1
        ), numbered AS (
            SELECT doc_id, p, sum(gap) OVER (PARTITION BY doc_id ORDER BY p) AS span
            FROM (SELECT *, CAST(coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, TRUE) AS INTEGER) AS gap FROM repeats)
        ), spans AS (
            SELECT doc_id, min(p) AS start, max(p) + 100 AS stop FROM numbered GROUP BY doc_id, span
        ), pieces AS (
            SELECT doc_id, start, stop, substr(h, 2 * before + 1, 2 * (start - before)) AS piece
            FROM (SELECT s.*, h, coalesce(lag(stop) OVER (PARTITION BY s.doc_id ORDER BY start), 0) AS before
                  FROM spans s JOIN docs d ON d.doc_id = s.doc_id)
        ), cut AS (
            SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS last,
                   string_agg(piece, '' ORDER BY start) AS front
            FROM pieces GROUP BY doc_id
        )
        SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM docs d LEFT JOIN cut c ON c.doc_id = d.doc_id
    """,
    "op2_ngram_jaccard": """
        WITH RECURSIVE sequences AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)])
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
            FROM sequences
        ), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a
            JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
            GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
        ), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reached(doc_id, first) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT b, first FROM reached JOIN links ON a = doc_id
        )
        SELECT doc_id, len(s) AS n_shingles, component_id
        FROM sets JOIN (SELECT doc_id, min(first) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
    """,
    "op5_mixing": """
        WITH sized AS (
            SELECT doc_id, source, coalesce('=' || source, '~') AS key,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CASE WHEN coalesce(text, '') = '' THEN 1.0 ELSE greatest(0.05,
                       strlen(regexp_replace(text, '[0-9#$%&*+/<=>@\\[\\]\\\\^_`{|}~]', '', 'g'))::DOUBLE / strlen(text)) END AS quality
            FROM documents
        ), sources AS (
            SELECT key, sum(size)::DOUBLE AS words, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY key) - 1) % 3]::DOUBLE AS weight
            FROM sized GROUP BY key
        ), levels AS (
            SELECT *, (1.5::DOUBLE * sum(words) OVER () - coalesce(sum(2 * words) OVER lower, 0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0)) AS level
            FROM sources
            WINDOW lower AS (ORDER BY 2 * words / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), goals AS (
            SELECT key, words, CASE WHEN 2 * words / weight <= level THEN 2 * words ELSE least(2 * words, weight *
                       max(CASE WHEN 2 * words / weight > level THEN level END) OVER ()) END AS target
            FROM levels
        ), whole AS (
            SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS epochs FROM goals
        ), queued AS (
            SELECT *, coalesce(sum(size) OVER (PARTITION BY key
                       ORDER BY -ln((('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / quality, doc_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM sized
        )
        SELECT doc_id, source, size, words::BIGINT AS source_size, target,
               CAST(epochs * size + least(size, greatest(0, round(target) - epochs * words - ahead)) AS BIGINT) AS taken
        FROM queued JOIN whole USING (key)
    """,
    "op6_top_products": """
        WITH usable AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scored
        QUALIFY rank <= 5
    """,
    "op11_vector_codes": scans.vector_codes(rounds=4),
    "op12_licenses": scans.licenses(),
    "op13_filter_audit": scans.FILTER_AUDIT,
}
