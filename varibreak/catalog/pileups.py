"""Pileup and mismatch texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import pileup
from .registry import query
from .shared import WALK_SQL

PILEUP_SQL = WALK_SQL + """,
kept AS (SELECT * FROM walk WHERE (flag & 1796) = 0 AND pos > 0),
each AS (
  SELECT sample, chrom, pos + r + k AS position, 'M' AS kind, upper(substr(seq, q + k + 1, 1)) AS base, (flag & 16) <> 0 AS back
    FROM (SELECT *, unnest(range(0, len)) AS k FROM kept WHERE op IN ('M', '=', 'X'))
  UNION ALL SELECT sample, chrom, pos + r + k, op, NULL, NULL FROM (SELECT *, unnest(range(0, len)) AS k FROM kept WHERE op IN ('D', 'N'))
  UNION ALL SELECT sample, chrom, pos + r - 1, 'I', NULL, NULL FROM kept WHERE op = 'I' AND r > 0),
pile AS (SELECT sample, chrom, position, count(*) FILTER (kind = 'M') AS depth, count(*) FILTER (base = 'A') AS "A", count(*) FILTER (base = 'C') AS "C",
  count(*) FILTER (base = 'G') AS "G", count(*) FILTER (base = 'T') AS "T", count(*) FILTER (kind = 'M' AND base NOT IN ('A', 'C', 'G', 'T')) AS "N",
  count(*) FILTER (kind = 'D') AS deleted, count(*) FILTER (kind = 'N') AS skipped, count(*) FILTER (kind = 'M' AND back) AS reverse,
  count(*) FILTER (kind = 'I') AS inserted FROM each GROUP BY ALL)"""


@query("plp01_pileup", "aln", PILEUP_SQL + "\nSELECT * FROM pile")
def counts(spark, d):
    return pileup.pileup(views.aln(spark, d), ["sample", "chrom"])


@query("plp02_alleles", "aln", PILEUP_SQL + """
SELECT chrom, sample, position, depth, greatest("A", "C", "G", "T", "N") AS support,
  CASE greatest("A", "C", "G", "T", "N") WHEN "A" THEN 'A' WHEN "C" THEN 'C' WHEN "G" THEN 'G' WHEN "T" THEN 'T' ELSE 'N' END AS allele FROM pile WHERE depth >= 3""")
def alleles(spark, d):
    keys = ["sample", "chrom"]
    return pileup.allele_calls(pileup.pileup(views.aln(spark, d), keys), keys, 3)


@query("plp03_mismatch_tags", "aln genome", WALK_SQL + """,
mapped AS (SELECT * FROM walk WHERE (flag & 4) = 0 AND pos > 0),
m AS (SELECT rid, chrom, pos, seq, q, r, len, op, i, CAST(coalesce(sum(CASE WHEN op IN ('M', '=', 'X') THEN len ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS m0 FROM mapped),
letters AS (SELECT rid, chrom, i, op, m0, k, pos + r + k AS spot, upper(substr(seq, q + k + 1, 1)) AS base
  FROM (SELECT *, unnest(range(0, len)) AS k FROM m WHERE op IN ('M', '=', 'X', 'D'))),
seen AS (SELECT l.*, coalesce(substr(g.seq, CAST((l.spot - 1) % 32 + 1 AS BIGINT), 1), 'N') AS ref FROM letters l LEFT JOIN genome g ON g.chrom = l.chrom AND g.tile = (l.spot - 1) // 32),
ev AS (SELECT rid, m0 + k AS mm, i, ref AS text, 1 AS width FROM seen WHERE op <> 'D' AND base <> '=' AND (base <> ref OR ref = 'N')
  UNION ALL SELECT rid, m0, i, '^' || string_agg(ref, '' ORDER BY spot), 0 FROM seen WHERE op = 'D' GROUP BY rid, m0, i),
spaced AS (SELECT *, mm - coalesce(lag(mm + width) OVER (PARTITION BY rid ORDER BY mm, i), 0) AS gap FROM ev),
texts AS (SELECT rid, string_agg(CAST(gap AS VARCHAR) || text, '' ORDER BY mm, i) AS body, max(mm + width) AS upto, sum(CASE WHEN width = 0 THEN length(text) - 1 ELSE 1 END) AS changes FROM spaced GROUP BY rid),
sizes AS (SELECT rid, sum(CASE WHEN op IN ('M', '=', 'X') THEN len ELSE 0 END) AS total, sum(CASE WHEN op = 'I' THEN len ELSE 0 END) AS ins FROM mapped GROUP BY rid)
SELECT rid, coalesce(body, '') || CAST(CAST(total - coalesce(upto, 0) AS BIGINT) AS VARCHAR) AS md, CAST(coalesce(changes, 0) + ins AS BIGINT) AS nm
FROM sizes LEFT JOIN texts USING (rid)""")
def mismatch_tags(spark, d):
    return pileup.mismatch_tags(views.aln(spark, d), views.genome_tiles(spark, d), views.TILE)
