"""SQL pieces several checks share."""

from __future__ import annotations

PAIRS_SQL = """
one AS (SELECT DISTINCT ON (chrom, qname) chrom, qname, flag, pos, mpos, sample FROM aln ORDER BY chrom, qname, rid),
pairs AS (SELECT chrom, qname,
  CASE WHEN (flag & 4) <> 0 THEN CASE WHEN (flag & 32) = 0 THEN mpos END WHEN (flag & 16) = 0 THEN pos ELSE mpos END AS p_start,
  CASE WHEN (flag & 4) <> 0 THEN CASE WHEN (flag & 32) <> 0 THEN mpos END WHEN (flag & 16) = 0 THEN mpos ELSE pos END AS m_start,
  CASE WHEN (flag & 4) = 0 THEN ((flag & 16) <> 0) = ((flag & 32) <> 0) END AS discordant FROM one)"""

SOFT_CLIP_SQL = """
ops AS (SELECT rid, cigar, pos, chrom, sample, seq, flag, regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1) AS op,
     list_transform(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1), lambda x: CAST(x AS BIGINT)) AS len FROM aln),
tup AS (SELECT *, len(list_filter(op, lambda x: x = 'S')) AS ns, list_position(op, 'S') AS s1,
     CAST(coalesce(list_sum(list_filter(list_transform(op, lambda x, i: CASE WHEN x IN ('M', '=', 'X') THEN len[i] END), lambda y: y IS NOT NULL)), 0) AS BIGINT) AS n_match,
     CAST(coalesce(list_sum(list_filter(list_transform(op, lambda x, i: CASE WHEN x = 'D' THEN len[i] END), lambda y: y IS NOT NULL)), 0) AS BIGINT) AS n_del
   FROM ops),
clip AS (SELECT *, s1 = 1 OR (s1 = 2 AND op[1] = 'H') AS lead,
     len(op) - list_position(list_reverse(op), 'S') + 1 AS s2 FROM tup),
soft AS (SELECT rid, pos, chrom, sample, seq, flag, n_match,
     CAST(CASE WHEN ns = 2 OR (ns = 1 AND lead) THEN len[s1] ELSE 0 END AS INT) AS n_left,
     CAST(CASE WHEN ns = 2 OR (ns = 1 AND NOT lead) THEN len[s2] ELSE 0 END AS INT) AS n_right,
     CASE WHEN ns = 2 OR (ns = 1 AND NOT lead) THEN n_match + n_del END AS to_right FROM clip)"""

CLUSTERS_SQL = SOFT_CLIP_SQL + """,
ends AS (SELECT sample, chrom, 'L' AS side, pos AS position, n_left AS nb, reverse(substr(seq, 1, n_left)) AS clip FROM soft WHERE (flag & 1540) = 0 AND n_left > 0
  UNION ALL SELECT sample, chrom, 'R', pos + to_right, n_right, right(seq, n_right) FROM soft WHERE (flag & 1540) = 0 AND n_right > 0),
sup AS (SELECT sample, chrom, side, position, count(*) AS nreads, CAST(sum(nb) AS BIGINT) AS nbases FROM ends GROUP BY ALL HAVING count(*) >= 3 AND sum(nb) >= 30),
cols AS (SELECT sample, chrom, side, position, i, substr(clip, i, 1) AS base FROM (SELECT e.*, unnest(range(1, len(clip) + 1)) AS i FROM ends e JOIN sup USING (sample, chrom, side, position))),
cnt AS (SELECT sample, chrom, side, position, i, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g,
  count(*) FILTER (base = 'T') AS t, count(*) FILTER (base NOT IN ('A', 'C', 'G', 'T')) AS n FROM cols GROUP BY ALL),
best AS (SELECT *, greatest(a, c, g, t, n) AS top, a + c + g + t + n AS obs FROM cnt),
cons AS (SELECT sample, chrom, side, position,
  string_agg(CASE top WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' WHEN t THEN 'T' ELSE 'N' END, '' ORDER BY i) AS outward,
  CAST(sum(obs - top) FILTER (obs >= 2) AS DOUBLE) / CAST(sum(obs) FILTER (obs >= 2) AS DOUBLE) AS mismatch FROM best GROUP BY ALL),
allclust AS (SELECT s.*, CASE WHEN side = 'L' THEN reverse(outward) ELSE outward END AS consensus, mismatch FROM sup s JOIN cons USING (sample, chrom, side, position)),
clusters AS (SELECT * FROM allclust WHERE mismatch < 0.05e0)"""

# every CIGAR operation (number i) with the read bases (q) and reference bases (r) before it
WALK_SQL = """
parsed AS (SELECT rid, sample, chrom, pos, seq, flag, regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1) AS ops,
     list_transform(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1), lambda x: CAST(x AS BIGINT)) AS lens FROM aln),
walk AS (SELECT rid, sample, chrom, pos, seq, flag, i, ops[i] AS op, lens[i] AS len,
     CAST(coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN ops[j] IN ('M', 'I', 'S', '=', 'X') THEN lens[j] ELSE 0 END)), 0) AS BIGINT) AS q,
     CAST(coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN ops[j] IN ('M', 'D', 'N', '=', 'X') THEN lens[j] ELSE 0 END)), 0) AS BIGINT) AS r
   FROM (SELECT *, unnest(range(1, len(ops) + 1)) AS i FROM parsed))"""
