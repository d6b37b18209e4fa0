"""SQL (DuckDB) for the results of the operators that it can express."""

from __future__ import annotations

from logweir.llm.common import LOWER, UPPER
from logweir.llm.quality_rules import RULES, SYMBOLS

_WORD = r"'[^\x20\x09-\x0D]+'"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP11_FILTER_AUDIT = rf"""
WITH RECURSIVE base AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS content,
        regexp_extract_all(coalesce(text, ''), {_WORD}) AS words
    FROM documents
), firsts AS (
    SELECT content, min(doc_id) AS first_id FROM base GROUP BY content
), flags AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masks AS (
    SELECT b.part, coalesce(f.good, 0) AS good, coalesce(f.toxic, 0) AS toxic,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * len(regexp_extract_all(b.content, '[A-Z]')) > 2 * length(b.content) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(b.content, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN b.doc_id > firsts.first_id THEN 16 ELSE 0 END AS mask
    FROM base b JOIN firsts ON b.content = firsts.content LEFT JOIN flags f ON f.doc_id = b.doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), prefixes AS (
    SELECT '' AS prefix, 0 AS step, 0 AS before, 0 AS bit, '' AS letter
    UNION ALL
    SELECT p.prefix || l.letter, p.step + 1, p.before | p.bit, l.bit, l.letter
    FROM prefixes p JOIN letters l ON (p.before | p.bit) & l.bit = 0
), metrics AS (
    SELECT part, prefix, step, letter,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM prefixes JOIN cells ON true WHERE step > 0 GROUP BY part, prefix, step, letter
), steps AS (
    SELECT m.*, o.prefix AS filter_order FROM metrics m JOIN (SELECT prefix FROM prefixes WHERE step = 5) o ON starts_with(o.prefix, m.prefix)
), shapley AS (
    SELECT part, letter, sum(removed) AS shapley FROM steps GROUP BY part, letter
)
SELECT s.part, s.filter_order, s.step::INTEGER AS step, s.kept::BIGINT AS kept, s.removed::BIGINT AS removed, s.redundant::BIGINT AS redundant,
    s.unique_fails::BIGINT AS unique_fails, s.good_lost::BIGINT AS good_lost, s.toxic_lost::BIGINT AS toxic_lost, h.shapley::BIGINT AS shapley
FROM steps s JOIN shapley h ON h.part = s.part AND h.letter = s.letter
"""

OP12_QUALITY_RULES = rf"""
WITH base AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS content FROM documents
), counted AS (
    SELECT *, regexp_extract_all(content, {_WORD}) AS words,
        list_filter(string_split(content, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
    FROM base
), judged AS (
    SELECT *, list_filter(list_distinct(lines), lambda line:
            regexp_matches(line, {_text(RULES.sentence_end)}) AND NOT regexp_matches(line, {_text(RULES.shouting)})
            AND {RULES.per_symbol} * len(regexp_extract_all(line, '{SYMBOLS}')) <= length(line)
            AND NOT regexp_matches(line, {_text(RULES.separated)}) AND NOT regexp_matches(line, {_text(RULES.menu_entry)})
            AND NOT (length(line) <= {RULES.notice_chars} AND regexp_matches(line, {_text(RULES.notice)}))) AS good
    FROM counted
), placed AS (
    SELECT row_id, unnest(words) AS w0, unnest(range(1, len(words) + 1)) AS place FROM counted
), windows AS (
    SELECT *, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2, lead(w0, 3) OVER o AS w3, lead(w0, 4) OVER o AS w4
    FROM placed WINDOW o AS (PARTITION BY row_id ORDER BY place)
), keyed AS (
    SELECT row_id, place, count(*) OVER (PARTITION BY row_id, w0, w1, w2, w3, w4) AS times FROM windows WHERE w4 IS NOT NULL
), spaced AS (
    SELECT row_id, least(5, coalesce(lead(place) OVER (PARTITION BY row_id ORDER BY place) - place, 5)) AS covered FROM keyed WHERE times > 1
), repeated AS (
    SELECT row_id, sum(covered)::BIGINT AS n_repeat_words FROM spaced GROUP BY row_id
), figures AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(content, '{SYMBOLS}'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(lines)::BIGINT AS n_lines, len(good)::BIGINT AS n_lines_kept,
        length(array_to_string(lines, ''))::BIGINT AS chars, length(array_to_string(good, ''))::BIGINT AS chars_kept
    FROM judged LEFT JOIN repeated USING (row_id)
), failing AS (
    SELECT *, n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.most_repeated} * n_words AS base_failed FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 100 * (chars - chars_kept) <= {RULES.most_lost} * chars AS kept, n_lines, n_lines_kept, chars, chars_kept
FROM failing
"""

OP13_HARD_NEGATIVES = """
WITH valid AS (
    SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, list_dot_product(a.vector, c.vector)::BIGINT AS score
    FROM valid a JOIN valid c ON a.id <> c.id WHERE a.id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id))::INTEGER AS rank,
    s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""

OP3_EXACT_DEDUP = f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS content FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY content)
"""

ORACLES: dict[str, str] = {
    "op3_exact_dedup": OP3_EXACT_DEDUP,
    "op11_filter_audit": OP11_FILTER_AUDIT,
    "op12_quality_rules": OP12_QUALITY_RULES,
    "op13_hard_negatives": OP13_HARD_NEGATIVES,
}
