"""SQL counterparts that are too long for the registry."""

from __future__ import annotations

from larder.llm.licenses import BASE, licence_rules

SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def vector_codes(rounds: int) -> str:
    """Every part against every entry, round by round."""

    def nearest(book: str) -> str:
        return f"""SELECT vec_id, p, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 256 + e) AS best
            FROM parts JOIN {book} USING (p) GROUP BY vec_id, p"""

    steps = []
    for i in range(rounds):
        steps.append(f"""near{i} AS MATERIALIZED ({nearest(f"book{i}")}), mean{i} AS (
            SELECT p, e, list(floor(total / n) ORDER BY pos) AS c FROM (
                SELECT p, e, pos, sum(x) AS total, count(*) AS n FROM (
                    SELECT p, best::BIGINT % 256 AS e, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM near{i} JOIN parts USING (vec_id, p))
                GROUP BY p, e, pos)
            GROUP BY p, e
        ), book{i + 1} AS MATERIALIZED (
            SELECT p, e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m USING (p, e))""")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), parts AS MATERIALIZED (
            SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, unnest([0, 1, 2, 3]) AS u(p)
        ), book0 AS MATERIALIZED (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 256
        ), {", ".join(steps)}, last AS ({nearest(f"book{rounds}")}), coded AS (
            SELECT vec_id, string_agg(printf('%02x', best::BIGINT % 256), '' ORDER BY p) AS code, sum(best::BIGINT // 256)::BIGINT AS error
            FROM last GROUP BY vec_id
        ), digest AS (
            SELECT sha256(string_agg(array_to_string([y::BIGINT FOR y IN c], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id), digest
    """


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses() -> str:
    """Every rule tried at every word of the documents that hold its keyword."""

    def at_start(pattern: str) -> str:
        return quoted("( [0-9]+:" + pattern.replace(" ?", "(?: )?").replace(" ", " [0-9]+:") + ") ")

    rules = licence_rules()
    reach = max(rule.most_words for rule in rules)
    listed = ", ".join(f"({r.rank}, {quoted(r.label)}, {r.weight}::DOUBLE, {list(r.keywords)}, {at_start(r.pattern)})" for r in rules)
    phrases = ", ".join(f"({quoted(label)}, {at_start(phrase)})" for phrase, label in BASE.items())
    return f"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), rules(rank, label, weight, keywords, pattern) AS (VALUES {listed}
        ), phrases(label, pattern) AS (VALUES {phrases}
        ), held AS (
            SELECT doc_id, w, [concat(i - 1, ':', w[i]) FOR i IN range(1, len(w) + 1)] AS numbered
            FROM docs WHERE list_has_any(w, ['license', '2', 'nc']) OR list_has_any(w, (SELECT flatten(list(keywords)) FROM rules))
        ), whole AS (
            SELECT doc_id, w, concat(' ', array_to_string(numbered, ' '), ' ') AS s FROM held
        ), suffixes AS MATERIALIZED (
            SELECT doc_id, start, concat(' ', array_to_string(numbered[start + 1 : start + {reach + 1}], ' '), ' ') AS s
            FROM (SELECT *, unnest(range(len(w))) AS start FROM held)
        ), spoken AS MATERIALIZED (
            SELECT doc_id, label, '^' || pattern AS pattern FROM whole, phrases WHERE regexp_matches(s, pattern)
        ), tried AS MATERIALIZED (
            SELECT doc_id, rank, label, weight, '^' || pattern AS pattern
            FROM whole JOIN rules ON list_has_any(w, keywords) WHERE regexp_matches(s, pattern)
        ), base AS (
            SELECT doc_id, start, label FROM suffixes JOIN spoken USING (doc_id) WHERE regexp_matches(s, pattern)
        ), hits AS MATERIALIZED (
            SELECT doc_id, start, CAST(split_part(string_split(regexp_extract(s, pattern, 1), ' ')[-1], ':', 1) AS BIGINT) AS stop,
                   rank, label, weight
            FROM suffixes JOIN tried USING (doc_id) WHERE regexp_matches(s, pattern)
        ), longest AS (
            SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY stop DESC, rank, label) = 1
        ), ranked AS (
            SELECT * FROM longest d WHERE NOT EXISTS (
                SELECT 1 FROM longest e WHERE e.doc_id = d.doc_id AND e.rank < d.rank AND (
                    e.start < d.start AND d.start <= e.stop AND e.stop < d.stop OR d.start < e.start AND e.start <= d.stop AND d.stop < e.stop))
        ), outermost AS (
            SELECT * FROM ranked d WHERE NOT EXISTS (
                SELECT 1 FROM ranked e WHERE e.doc_id = d.doc_id AND e.start < d.start AND d.stop <= e.stop)
        ), named AS (
            SELECT doc_id, start, label, 0.95::DOUBLE AS weight, TRUE AS base FROM base
            UNION ALL SELECT doc_id, start, label, weight, FALSE FROM outermost
        ), summed AS (
            SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score
            FROM named GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score
        FROM docs LEFT JOIN summed USING (doc_id)
    """


FILTER_AUDIT = """
    WITH texts AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), tested AS (
        SELECT t.doc_id, part, coalesce(quality = 1, FALSE) AS good, coalesce(toxic = 1, FALSE) AS harmful, list_concat(
            CASE WHEN len(w) < 100 THEN ['A'] ELSE [] END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN ['B'] ELSE [] END,
            CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN ['C'] ELSE [] END,
            CASE WHEN regexp_matches(t, '[#$%&*|]') THEN ['D'] ELSE [] END,
            CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY t) THEN ['E'] ELSE [] END) AS fails
        FROM texts t LEFT JOIN labels l ON l.doc_id = t.doc_id
    ), masks AS (
        SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (harmful) AS harmful FROM tested GROUP BY part, fails
    ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
    ), orders AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
    ), ranked AS (
        SELECT m.*, filter_order, list_min([instr(filter_order, f) FOR f IN fails]) AS gone FROM masks m, orders
    ), cells AS (
        SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
               coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (gone < step AND list_contains(fails, substr(filter_order, step, 1))), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (fails = [substr(filter_order, step, 1)]), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost,
               coalesce(sum(harmful) FILTER (gone = step), 0)::BIGINT AS toxic_lost
        FROM ranked, unnest([1, 2, 3, 4, 5]) AS s(step) GROUP BY part, filter_order, step
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM cells
"""
