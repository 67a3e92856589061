"""DuckDB SQL of the corpus queries that SQL can express on whole tables.

Surrogates, subwords, shard hashes and alignments aren't expressed here, and byte windows are too slow in SQL on whole
tables; those queries are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_WS}'), lambda x: x <> '')"


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(h) >= 100 AND first <> page_id THEN first END AS refers_to FROM f"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM d, unnest(generate_series(1, greatest(1, len(w) - 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id"""

_FOLDED = f"regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[!-/:-@\\[-`{{-~]', ' ', 'g')"
DECONTAMINATION = f"""
WITH q AS (SELECT DISTINCT item_id, {_words(_FOLDED)} AS w FROM benchmark),
qg AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s FROM q, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM qg GROUP BY item_id),
d AS (SELECT doc_id, {_words(_FOLDED)} AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM qg) ks, unnest(generate_series(1, len(w) - k + 1)) AS u(i)),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM dg JOIN qg ON dg.k = qg.k AND dg.s = qg.s GROUP BY 1, 2)
SELECT doc_id, c.item_id, n_item, n_common FROM c JOIN n ON n.item_id = c.item_id WHERE 5 * n_common >= 4 * n_item"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g FROM d, unnest(generate_series(1, len(ws) - 7)) AS u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, unnest(generate_series(0, 7)) AS v(j) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    strlen(regexp_replace(t, '{_WS}', '', 'g')) AS solid, strlen(t) - strlen(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals, len(regexp_extract_all(t, '!!+')) AS cries,
    len(regexp_extract_all(t, '(?m)^[\x20\x09]*[*\x{{2022}}\x{{2023}}\x{{25E6}}-][\x20\x09]')) AS bullets, len(regexp_extract_all(t, '(?m)(?:\.\.\.|\x{{2026}})[\x20\x09]*$')) AS ellipses, strlen(t) - strlen(regexp_replace(t, '\p{{L}}+', '', 'g')) AS letters FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols * 10 > n_words * 3 OR capitals * 2 > solid OR cries * 10 > n_words * 3 OR solid > n_words * 24 OR solid < n_words * 2 OR n_dup_lines * 10 > n_lines * 4
    OR n_lines >= 5 AND bullets * 10 > n_lines * 9 OR n_lines >= 5 AND ellipses * 10 > n_lines * 3 OR letters < n_words AS rejected FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM v"""

_DISTANCE = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"


def _round(n: int) -> str:
    """CTEs of one round of clustering: a{n} assigns by c{n}, c{n+1} has the new centroids."""
    return f"""a{n} AS (SELECT v.r, any_value(v.x) AS x, min({{'d': {_DISTANCE}, 'c': c.c}}).c AS c FROM v, c{n} c GROUP BY v.r),
s{n} AS (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{n}, unnest(generate_series(1, 64)) AS u(i) GROUP BY c, i),
m{n} AS (SELECT c, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS x FROM s{n} GROUP BY c),
c{n + 1} AS (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN m{n} m ON m.c = o.c)"""


CLUSTERING = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS c, x FROM v QUALIFY c < 16),
{_round(0)},
{_round(1)},
{_round(2)},
f AS (SELECT v.r, any_value(v.vec_id) AS vec_id, min({{'d': {_DISTANCE}, 'c': c.c}}) AS b FROM v, c3 c GROUP BY v.r)
SELECT vec_id, b.c AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256 FROM f JOIN c3 ON c3.c = f.b.c"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC, "op2_ngram_jaccard_join": NGRAM_JOIN, "op3_decontamination": DECONTAMINATION, "op9_quality_rules": QUALITY, "op11_centroid_clustering": CLUSTERING}
