"""DuckDB twins of the queries that SQL can express.  The others (tokenizers,
fingerprints and components, hashed models, trained classifiers, templates) are
held against brute-force versions in tests/llm."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op6_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS g,
             first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS k FROM d)
SELECT doc_id, k AS keep_id, g AS group_size, doc_id IS NOT DISTINCT FROM k AS kept, h AS text_sha256 FROM r
"""

SQL["op3_temperature_mixing"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % 256 AS INTEGER) AS block
  FROM documents),
tok AS (SELECT source, CAST(SUM(n_tokens) AS BIGINT) AS tokens FROM t GROUP BY source),
p AS (SELECT source, tokens, tokens / (SELECT SUM(tokens) FROM tok)::DOUBLE AS p FROM tok WHERE tokens > 0),
m AS (SELECT MIN(p) AS lo, MAX(p) AS hi, CAST(SUM(tokens) AS DOUBLE) AS total FROM p),
b AS (SELECT -1 AS low, 1048576 AS high
      UNION ALL
      SELECT CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
      FROM (SELECT low, high, (low + high) // 2 AS mid,
                   pow(m.lo, ((low + high) // 2) / 1048576.0 - 1) / pow(m.hi, ((low + high) // 2) / 1048576.0 - 1) <= 2.0 AS ok
            FROM b, m WHERE high - low > 1)),
a AS (SELECT MIN(high) / 1048576.0 AS a FROM b),
w AS (SELECT source, tokens, p, pow(p, a.a) / SUM(pow(p, a.a)) OVER () AS weight FROM p, a),
q AS (SELECT source, tokens, weight,
             CAST(floor(weight * (SELECT total FROM m) * (SELECT MAX(p / weight) FROM w) + 1e-6 * tokens) AS BIGINT) AS quota FROM w),
s AS (SELECT source, block, CAST(SUM(n_tokens) AS BIGINT) AS b_tokens FROM t GROUP BY source, block),
j AS (SELECT s.source, s.block, b_tokens, weight, quota // tokens AS epochs, quota - (quota // tokens) * tokens AS rest
      FROM s LEFT JOIN q ON s.source IS NOT DISTINCT FROM q.source),
r AS (SELECT *, ('0x' || substr(md5('mix:' || coalesce(CAST(epochs AS VARCHAR), '') || ':' || coalesce(source, '') || ':'
                                    || CAST(block AS VARCHAR)), 1, 8))::BIGINT AS rank FROM j),
c AS (SELECT source, block, weight, epochs, rest, SUM(b_tokens) OVER (PARTITION BY source ORDER BY rank, block
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sofar FROM r)
SELECT t.doc_id, t.source, t.n_tokens, t.block, round(coalesce(c.weight, 0.0), 9) AS weight,
       CAST(CASE WHEN c.weight IS NULL THEN 1 ELSE epochs + CASE WHEN sofar <= rest THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM t JOIN c ON t.source IS NOT DISTINCT FROM c.source AND t.block = c.block
"""

SQL["op11_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

SQL["op12_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
      FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
          || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
          || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
          || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
          || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, 1, step - 1) AS before, substr(filter_order, step, 1) AS f
      FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
g AS (SELECT *, contains(fails, f) AS hit, length(translate(fails, before, '')) < length(fails) AS gone FROM c, s),
r AS (SELECT part, filter_order, step, any_value(f) AS f,
             coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
             coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0) AS good_lost,
             coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0) AS toxic_lost
      FROM g GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""

SQL["op13_fill_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u,
             ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(list_aggregate(u[1:a], 'string_agg', ''), '') AS pre, coalesce(list_aggregate(u[a + 1:b], 'string_agg', ''), '') AS mid,
             coalesce(list_aggregate(u[b + 1:n], 'string_agg', ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
