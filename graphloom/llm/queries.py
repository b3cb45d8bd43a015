"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from graphloom.llm import bpe, decontam, langid, license_scan, lm, pii, quality_model, quality_rules, secrets, simhash

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_language_model": lm.query,
    "op3_decontamination": decontam.query,
    "op4_pii": pii.query,
    "op5_quality_model": quality_model.query,
    "op6_language_id": langid.query,
    "op7_license_scan": license_scan.query,
    "op8_secrets": secrets.query,
    "op9_bpe": bpe.query,
    "op10_quality_rules": quality_rules.query,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM b2)),
sizes AS (SELECT DISTINCT size FROM win),
place AS (SELECT row_, size, i, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT row_, p.size, i, item FROM place p JOIN win USING (size, k)),
n AS (SELECT row_, count(DISTINCT x) AS n_hit FROM (SELECT row_, unnest(generate_series(i, i + size - 1)) AS x FROM (SELECT DISTINCT row_, size, i FROM hit)) GROUP BY row_),
o AS (SELECT row_, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY row_)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row_) LEFT JOIN o USING (row_)
"""


def _secrets_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT row_, {rank} AS rank, {quoted(kind)} AS kind, {quoted(test)} AS test, string_split_regex(t, {quoted(pattern)}) AS p, "
        f"regexp_extract_all(t, {quoted(pattern)}) AS x FROM d WHERE regexp_matches(t, {quoted(pattern)})"
        for rank, (kind, pattern, test) in enumerate(secrets.RULES)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
u AS (SELECT *, unnest(generate_series(1, len(x))) AS i FROM m),
s AS (SELECT row_, rank, kind, test, x[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda y: length(y)))
  + coalesce(list_sum(list_transform(x[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS start FROM u),
f AS (SELECT row_, rank, kind, start, concat(kind, ':', start, ':', start + length(v)) AS span FROM s WHERE test = '' OR regexp_matches(v, test))
SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(secrets.BASE)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN f USING (row_) GROUP BY row_, doc_id
"""


#: The others cannot be said in SQL: their tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op3_decontamination": _DECONTAMINATION, "op8_secrets": _secrets_sql()}
