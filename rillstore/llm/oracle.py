"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, HEX, KINDS, MAX_OWNERS, MAX_REPOS, MIXED


def _kind(rank: int, pattern: str, group: int, least: int) -> str:
    """Matches of one kind with their places: summed lengths of the gaps and matches before them."""
    p = pattern.replace("'", "''")
    return f"""
SELECT rid, {rank} AS rank, list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in h[1:i-1]]), 0) AS start, length(h[i]) AS size, v[i] AS value
FROM (SELECT rid, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(h) + 1)) AS u(i)
WHERE length(v[i]) >= {least}"""


OP1 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, coalesce(source, '') AS repo FROM documents),
base AS (SELECT rid, rank, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop, value FROM ({_kind(0, ASSIGN, 2, 6)} UNION ALL {_kind(1, ACCESS, 0, 1)} UNION ALL {_kind(2, HEX, 0, 1)})),
tokens AS (SELECT rid, rank, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop, value FROM ({_kind(3, MIXED, 0, 1)}) WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9].*[0-9].*[0-9]')),
mixed AS (SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = t.rid AND b.start < t.stop AND t.start < b.stop)),
every AS (SELECT s.*, d.repo, split_part(d.repo, '/', 1) AS owner FROM (SELECT * FROM base UNION ALL SELECT * FROM mixed) s JOIN d USING (rid)),
owners AS (SELECT value, count(DISTINCT owner) AS n, count(DISTINCT repo) AS m FROM every GROUP BY value),
judged AS (SELECT e.*, CASE rank {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END || ':' || start || ':' || stop AS said, o.n <= {MAX_OWNERS} AND o.m <= {MAX_REPOS} AS owned, o.n, o.m FROM every e JOIN owners o USING (value)),
by_row AS (SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '') AS base,
  coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE rank < 3 OR owned), '') AS spans,
  count(*) FILTER (WHERE owned) AS n_owned, count(*) FILTER (WHERE NOT owned) AS n_copied, max(n) AS most_owners, max(m) AS most_repos FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN by_row USING (rid)"""
