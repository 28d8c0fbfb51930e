"""DuckDB SQL of those corpus queries that SQL expresses fast enough on whole tables; the others have brute-force tests."""

from __future__ import annotations

_TOP = """
WITH {names}v AS (
  SELECT vec_id, {component} AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0{more}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {score} AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}
"""

#: The letters of base 32, five bits each.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE_HEX = "CAST(concat('0x', h[g * 5 + 1:g * 5 + 5]) AS INTEGER)"
_FOUR = " || ".join(f"substr('{_BASE32}', (({_FIVE_HEX} >> {n}) & 31) + 1, 1)" for n in (15, 10, 5, 0))

SQL = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda g: {_FOUR}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
""",
    "op7_exact_top_k": _TOP.format(
        names="",
        component="list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT))",
        more="",
        score="CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT)",
        every=50,
        k=5,
    ),
}
