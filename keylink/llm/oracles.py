"""DuckDB statements of queries that SQL can express at length."""

from __future__ import annotations


def clusters(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Every distance in full, round by round."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (
    SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT rid, min({{'d': CAST({distance} AS BIGINT), 'c': c.c}}) AS best
  FROM v, c{i} c GROUP BY rid)"""
        )
        if i == rounds:
            break
        steps.append(
            f"""m{i} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS x FROM (
    SELECT best.c AS c, p, CAST(sum(x[p]) AS BIGINT) AS s, count(*) AS n
    FROM a{i} JOIN v USING (rid), unnest(range(1, {dims} + 1)) AS t(p) GROUP BY ALL)
  GROUP BY c)"""
        )
        steps.append(
            f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))"""
        )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS "cluster", best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(e.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} e ON e.c = best.c"""


def ranked(top: int = 10) -> str:
    """The score of every document that shares a term with an item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = (
        f"regexp_extract_all(translate(text, '{upper}', '{lower}'), "
        r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    )
    return f"""WITH
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {terms} AS t FROM documents),
q AS MATERIALIZED (
  SELECT iid, item_id, term, count(*) AS mult FROM (
    SELECT iid, item_id, unnest(t) AS term FROM (
      SELECT row_number() OVER () AS iid, item_id, {terms} AS t FROM benchmark))
  GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
f AS MATERIALIZED (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), total),
m AS (SELECT rid, doc_id, 100 - 75 + ((75 * len(t) * n_docs) // n_terms) AS m FROM d, total WHERE len(t) > 0),
s AS (
  SELECT iid, item_id, rid, doc_id,
    CAST(sum(mult * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s WHERE score > 0)
WHERE rank <= {top}"""
