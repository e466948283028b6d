"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from factweave.functions.session import ship
from factweave.llm import decontaminate, html, packing, pii, quality, simhash, substring, tokencounts, tokenfiles, toxicity

_QUERIES = {
    "op1_packing": packing.query,
    "op2_substring_dedup": substring.query,
    "op3_token_counts": tokencounts.query,
    "op4_simhash_components": simhash.query,
    "op5_token_files": tokenfiles.query,
    "op6_pii": pii.query,
    "op7_toxicity": toxicity.query,
    "op8_quality_rules": quality.query,
    "op9_html_text": html.query,
    "op10_decontamination": decontaminate.query,
}


def _with_package(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {name: _with_package(f) for name, f in _QUERIES.items()}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: The stop words and bounds of the threshold table, as the query's rules have them.
_FORMS = ", ".join("'" + f.replace("'", "''") + "'" for f in sorted({f for w in quality.STOP_WORDS for f in (w, w.capitalize(), f"{w},", f"{w}.")}))

SQL = {
    "op8_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM d WHERE len(w) >= 3),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win),
places AS (SELECT DISTINCT rid, i + k AS p FROM rep, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2),
r AS (SELECT rid, count(*) AS n_repeat FROM places GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, len(list_filter(w, lambda x: x IN ({_FORMS}))) AS n_stop,
             length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capital, length(t) - length(replace(t, '!', '')) AS n_exclaim
      FROM d LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.06 AND word_chars / n_words BETWEEN 1.5 AND 14.0
       AND n_capital / word_chars <= 0.4 AND n_exclaim / n_words <= 0.3 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM f""",
    "op10_decontamination": r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS k, s FROM (SELECT item_id, w, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM dw, ks WHERE len(w) >= k),
h AS (SELECT rid, i, dwin.k, item_id FROM dwin JOIN win USING (k, s)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)""",
}
