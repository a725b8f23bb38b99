"""SQL for those queries that SQL can express over whole tables."""

from __future__ import annotations

from . import licenses


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _normalised(line: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({line}), {_quoted(licenses.COPYRIGHT_LINE)}, ''), {_quoted(licenses.NOT_WORD)}, ' ', 'g'))"
    for a, b in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return out


def op4_licenses() -> str:
    known = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.KNOWN)
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) k(license, text)),
known_lines AS (SELECT license, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM known),
known_norm AS (SELECT license, text, i, {_normalised("line")} AS line FROM known_lines),
digests AS (
  SELECT digest, min(license) AS license FROM (
    SELECT license, md5(string_agg(line, ' ' ORDER BY i)) AS digest FROM known_norm WHERE line <> '' GROUP BY license, text) GROUP BY digest),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
norm AS (SELECT doc_id, i, {_normalised("raw")} AS line FROM lines),
whole AS (SELECT doc_id, md5(string_agg(line, ' ' ORDER BY i)) AS digest FROM norm WHERE line <> '' GROUP BY doc_id),
notices AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
  FROM norm JOIN digests ON md5(norm.line) = digests.digest WHERE norm.line <> '' GROUP BY doc_id)
SELECT d.doc_id, g.license, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM documents d LEFT JOIN whole w ON w.doc_id = d.doc_id LEFT JOIN digests g ON g.digest = w.digest LEFT JOIN notices n ON n.doc_id = d.doc_id
"""


def op9_ngram_join() -> str:
    return """
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1),
worded AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
grams AS (
  SELECT DISTINCT first_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT first_id, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 5)
  UNION ALL
  SELECT first_id, array_to_string(w, ' ') || ' (' || len(w) || ')' FROM worded WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT first_id, count(*) AS n FROM grams GROUP BY 1),
common AS (
  SELECT a.first_id AS x, b.first_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.first_id <> b.first_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes sx ON sx.first_id = x JOIN sizes sy ON sy.first_id = y
  WHERE 5 * c >= 4 * (sx.n + sy.n - c)),
reach(node, root) AS (
  SELECT first_id, first_id FROM texts
  UNION
  SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node WHERE r.root < l.y),
classes AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
counts AS (SELECT x, sum(t.copies) AS n FROM links JOIN texts t ON t.first_id = y GROUP BY x)
SELECT d.doc_id, c.class_id, CAST(coalesce(n.n, 0) + t.copies - 1 AS BIGINT) AS n_links, t.first_id AS copy_of
FROM documents d JOIN texts t ON coalesce(d.text, '') = t.text JOIN classes c ON c.node = t.first_id LEFT JOIN counts n ON n.x = t.first_id
"""


def op1_sharding() -> str:
    """Prefix sums by a window over the whole table, and the checksum byte by byte from its polynomial."""
    return """
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
sums AS (
  SELECT text, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), steps),
sized AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS whole FROM sized),
sharded AS (SELECT *, least(7, ((2 * upto - size) * 8) // (2 * whole))::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM sharded JOIN sums USING (text)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": op1_sharding(), "op4_licenses": op4_licenses(), "op9_ngram_join": op9_ngram_join()}
