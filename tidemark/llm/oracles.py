"""SQL of the corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[25:32])::BIGINT AS h4, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d
), c AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u
), p AS (
  SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid, array_to_string(lines[b + 1:], '') AS suf FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN regexp_extract(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 1) || regexp_extract(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 3) || regexp_extract(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 2)
    ELSE regexp_extract(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 2) || regexp_extract(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 3) || regexp_extract(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 1) END) AS restored_sha256
FROM o
"""

_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = f"""
WITH s AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, {_KEY} AS key FROM s
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, f.first IS NOT NULL AND f.first <> doc_id AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def _op13(rounds: int = 4, entries: int = 256, width: int = 16) -> str:
    steps = [
        f"""k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, part, q[part * {width} + 1:(part + 1) * {width}] AS v FROM k, (SELECT unnest(range(4)) AS part)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, part, any_value(label) AS label, any_value(p.v) AS v, arg_min(e, row(d, e)) AS e, min(d) AS d FROM (
    SELECT p.*, b.e, list_inner_product(p.v, p.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(p.v, b.v) AS d FROM p JOIN b{i} b USING (part)
  ) p GROUP BY vec_id, part
)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(m.v, b{i}.v) AS v FROM b{i} LEFT JOIN (
    SELECT part, e, list(x ORDER BY pos) AS v FROM (
      SELECT part, e, pos, (sum(v[pos])::BIGINT - ((sum(v[pos])::BIGINT % count(*)) + count(*)) % count(*)) / count(*)::DOUBLE AS x
      FROM a{i}, (SELECT unnest(range(1, {width + 1})) AS pos) GROUP BY part, e, pos
    ) GROUP BY part, e
  ) m USING (part, e)
)""")
    last = f"""r AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(v[pos]::BIGINT::VARCHAR, ',' ORDER BY part, e, pos)) FROM b{rounds}, (SELECT unnest(range(1, {width + 1})) AS pos)) AS codebooks_sha256 FROM r
"""
    return "WITH " + ",\n".join(steps) + ",\n" + last


#: Dimension 64: parts of 16.
OP13 = _op13()
