"""DuckDB SQL for the training-data queries that SQL can state; the others are tested against brute force."""

ORACLES: dict[str, str] = {
    "op11_lexical_search": r"""
WITH words AS (
    SELECT row_number() OVER () AS doc, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sizes AS (
    SELECT doc, doc_id, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0
), corpus AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes
), counts AS (
    SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM words) GROUP BY doc, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs::DOUBLE + 2) / (2 * count(*)::DOUBLE + 1)))::BIGINT AS w
    FROM counts, corpus GROUP BY term, docs
), impacts AS (
    SELECT doc, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)) AS x
    FROM counts JOIN sizes USING (doc), corpus
), items AS (
    SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
), scores AS (
    SELECT item_id, text, doc, doc_id, sum(w * x)::BIGINT AS score
    FROM items JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, text, doc, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS place
    FROM scores WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
""",
}
