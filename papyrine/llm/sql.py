"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

_CRC32 = """
crc_step AS (
  SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
  FROM range(256) AS t(b)
), crc_table AS (SELECT list(v ORDER BY b) AS steps FROM crc_step)
"""

ORACLE_SQL["op2_sharding"] = f"""
WITH {_CRC32.strip()}, sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size, coalesce(text, '') AS text FROM documents
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized
), dealt AS (
  SELECT *, CAST(least(23, before * 24 // total) AS INTEGER) AS shard, hex(encode(text)) AS digits FROM placed
)
SELECT doc_id, size,
       CAST(xor(4294967295::UBIGINT, list_reduce(
         list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(text)),
           lambda i: CAST(instr('0123456789ABCDEF', digits[2 * i + 1]) * 16 + instr('0123456789ABCDEF', digits[2 * i + 2]) - 17 AS UBIGINT))),
         lambda c, x: xor(c >> 8, steps[CAST(xor(c & 255, x) AS BIGINT) + 1]))) AS BIGINT) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt, crc_table
"""

ORACLE_SQL["op5_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.l AS line FROM documents,
    LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i) u
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND r.keeper <> k.doc_id AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def jaccard_sql(k: int, num: int, den: int) -> str:
    """Components of documents whose k-word shingle sets link, by comparing all pairs that share a shingle."""
    pieces = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), listed AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: {pieces})) END AS s FROM worded
), shingles AS (SELECT doc_id, unnest(s) AS g FROM listed),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN listed x ON x.doc_id = a JOIN listed y ON y.doc_id = b
  WHERE {den} * shared >= {num} * (len(x.s) + len(y.s) - shared)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(node, seen) AS (
  SELECT doc_id, doc_id FROM listed UNION SELECT b, seen FROM reached JOIN sides ON node = a WHERE seen <= node OR seen <= b
)
SELECT l.doc_id, CAST(len(l.s) AS BIGINT) AS n_shingles, r.component_id
FROM listed l JOIN (SELECT node, min(seen) AS component_id FROM reached GROUP BY node) r ON r.node = l.doc_id
"""


ORACLE_SQL["op7_ngram_jaccard"] = jaccard_sql(4, 85, 100)


def _shingles_sql(table: str, key: str, k: int) -> str:
    pieces = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""(SELECT {key}, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: {pieces})) END AS s
    FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}))"""


def containment_sql(k: int, num: int, den: int) -> str:
    """Items whose shingles lie in a document to num/den, by joining all shingles."""
    return f"""
WITH d AS (SELECT doc_id, unnest(s) AS g FROM {_shingles_sql("documents", "doc_id", k)}),
i AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM {_shingles_sql("benchmark", "item_id", k)})
SELECT item_id, doc_id, CAST(n AS BIGINT) AS item_shingles, count(*) AS shared, count(*) / n AS containment
FROM i JOIN d USING (g) GROUP BY item_id, doc_id, n HAVING {den} * count(*) >= {num} * n
"""


ORACLE_SQL["op10_decontamination"] = containment_sql(5, 80, 100)

ORACLE_SQL["op11_warc"] = r"""
WITH captured AS (
  SELECT page_id, coalesce(html, '') AS payload, coalesce(url, '') AS url,
         regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') AS absolute,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages
), sized AS (
  SELECT *, strlen(payload) AS n, min(page_id) OVER (PARTITION BY payload) AS first, CASE WHEN coalesce(absolute, false) THEN
    array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END ELSE url END AS url_key FROM captured
)
SELECT page_id, n AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to,
       url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture_no, true AS intact
FROM sized
"""
