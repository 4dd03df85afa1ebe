"""Region calls: merging, confirmation, genotyping, thresholds per bin."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from .. import views
from ..operators import calls, genotype, tracks
from ..operators.intervals import count_overlaps
from ..sinks import vcf
from .clips import clusters
from .registry import query
from .shared import CLUSTERS_SQL

BY = ["id", "chrom", "start", "end"]


def of(spark, d, *methods):
    return views.regions(spark, d).filter(F.col("method").isin(*methods)).select(*BY)


@query("ev10_priority_merge", "regions", """
s AS (SELECT * FROM regions WHERE method IN ('seqcbs', 'cvg', 'lcd')), c AS (SELECT * FROM regions WHERE method = 'sclip'),
b AS (SELECT * FROM regions WHERE method IN ('bigd', 'hax')), di AS (SELECT * FROM regions WHERE method IN ('disc', 'ldx')),
m AS (SELECT s.id, s.chrom, s.start, s."end",
  (SELECT min(c.id) FROM c WHERE c.chrom = s.chrom AND c.start <= s."end" AND c."end" >= s.start) AS hc,
  (SELECT min(b.id) FROM b WHERE b.chrom = s.chrom AND b.start <= s."end" AND b."end" >= s.start) AS hb,
  (SELECT min(di.id) FROM di WHERE di.chrom = s.chrom AND di.start <= s."end" AND di."end" >= s.start) AS hd FROM s)
SELECT id, chrom, start, "end" FROM m WHERE hc IS NULL AND hb IS NULL AND hd IS NULL
UNION ALL SELECT id, chrom, start, "end" FROM b WHERE id IN (SELECT hb FROM m WHERE hc IS NULL AND hb IS NOT NULL)
UNION ALL SELECT id, chrom, start, "end" FROM di WHERE id IN (SELECT hd FROM m WHERE hc IS NULL AND hb IS NULL AND hd IS NOT NULL)""")
def priority_merge(spark, d):
    return calls.priority_merge(of(spark, d, "seqcbs", "cvg", "lcd"), of(spark, d, "sclip"), of(spark, d, "bigd", "hax"), of(spark, d, "disc", "ldx"))


RANK = "list_position(['sclip', 'cigar', 'seqcbs', 'bigd', 'disc', 'lcd', 'ldx', 'hax', 'cvg'], method)"


def dedup_sql(keys: str) -> str:
    return f"""
o AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM regions),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start, "end", id) AS gid FROM o),
w AS (SELECT *, row_number() OVER (PARTITION BY {keys}, gid ORDER BY {RANK}, start, "end", id) AS rn FROM g)
SELECT id, chrom, start, "end", svtype, method FROM w WHERE rn = 1"""


@query("wn10_strict_dedup", "regions", dedup_sql("chrom, svtype"))
def strict_dedup(spark, d):
    return calls.deduplicate(views.regions(spark, d).select(*BY, "svtype", "method"))


@query("wn10_loose_dedup", "regions", dedup_sql("chrom"))
def loose_dedup(spark, d):
    return calls.deduplicate(views.regions(spark, d).select(*BY, "svtype", "method"), strict=False)


@query("ag23_accuracy", "regions", """
t AS (SELECT * FROM regions WHERE svtype = 'DEL'), c AS (SELECT * FROM regions WHERE svtype = 'INS'),
k AS (SELECT (SELECT count(*) FROM t WHERE EXISTS (SELECT 1 FROM c WHERE c.chrom = t.chrom AND c.start <= t."end" AND c."end" >= t.start)) AS hit,
  (SELECT count(*) FROM c) AS called, (SELECT count(*) FROM t) AS target),
p AS (SELECT *, floor(hit / CAST(called AS DOUBLE) * 1000e0) / 1000e0 AS precision, floor(hit / CAST(target AS DOUBLE) * 1000e0) / 1000e0 AS recall FROM k)
SELECT hit, called, target, precision, recall, floor(2e0 * precision * recall / (precision + recall) * 1000e0) / 1000e0 AS f1 FROM p""")
def accuracy(spark, d):
    r = views.regions(spark, d)
    return calls.accuracy(r.filter("svtype = 'DEL'").select(*BY), r.filter("svtype = 'INS'").select(*BY), ["chrom"])


@query("set01_evidence_union", "regions", """
SELECT method, svtype, count(*) AS n, min(start) AS first_start, max("end") AS last_end FROM regions GROUP BY method, svtype""")
def evidence_union(spark, d):
    """All kinds of evidence, each a table of its own, as one table of calls."""
    r = views.regions(spark, d)
    return calls.unite({m: r.filter(F.col("method") == m).drop("method") for m in C.METHOD_PRIORITY}).groupBy("method", "svtype").agg(
        F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query("set04_either_flag", "regions", "SELECT id FROM regions WHERE svtype = 'DEL' OR score >= 90")
def either_flag(spark, d):
    return views.regions(spark, d).filter((F.col("svtype") == "DEL") | (F.col("score") >= 90)).select("id")


@query("ev07_insert_alert", "aln regions", """
sp AS (SELECT chrom, pos AS s, pos + isize - 1 AS e FROM aln WHERE isize BETWEEN 1000 AND 10000)
SELECT id, EXISTS (SELECT 1 FROM sp WHERE sp.chrom = r.chrom AND sp.s <= r."end" AND sp.e >= r.start) AS alert FROM regions r""")
def insert_alert(spark, d):
    return calls.insert_alert(views.regions(spark, d).select(*BY), views.aln(spark, d), 1000, 10_000).select("id", "alert")


@query("ev08_relative_type", "aln regions", """
c AS (SELECT id, (SELECT count(*) FROM aln a WHERE a.sample = 'case' AND a.chrom = r.chrom AND a.pos <= r."end" AND a.pos + 99 >= r.start) AS n1,
  (SELECT count(*) FROM aln a WHERE a.sample = 'control' AND a.chrom = r.chrom AND a.pos <= r."end" AND a.pos + 99 >= r.start) AS n0 FROM regions r)
SELECT id, CASE WHEN n0 = 0 THEN 'INS' WHEN n1 / CAST(n0 AS DOUBLE) > 1.2e0 THEN 'DUP' WHEN n1 / CAST(n0 AS DOUBLE) < 0.8e0 THEN 'DEL' ELSE 'INS' END AS type FROM c""")
def relative_type(spark, d):
    reads = views.aln(spark, d).select("sample", "chrom", F.col("pos").alias("start"), (F.col("pos") + 99).alias("end"))
    r = views.regions(spark, d).select(*BY)
    for sample, name in (("case", "n1"), ("control", "n0")):
        r = count_overlaps(r, reads.filter(F.col("sample") == sample), ["chrom"], "start", "end", "start", "end", name)
    return r.select("id", tracks.relative_type(F.col("n1"), F.col("n0")).alias("type"))


@query("ev09_clip_confirmation", "aln regions", CLUSTERS_SQL + """,
k AS (SELECT DISTINCT chrom, side, position FROM clusters),
m AS (SELECT id, chrom, start, "end",
  (SELECT arg_min(position, (abs(position - r.start), position)) FROM k WHERE side = 'R' AND k.chrom = r.chrom AND abs(position - r.start) <= 500) AS st,
  (SELECT arg_min(position, (abs(position - r."end"), position)) FROM k WHERE side = 'L' AND k.chrom = r.chrom AND abs(position - r."end") <= 500) AS en FROM regions r WHERE svtype = 'DEL')
SELECT id, chrom, CASE WHEN st IS NOT NULL AND en IS NOT NULL THEN st ELSE start END AS start, CASE WHEN st IS NOT NULL AND en IS NOT NULL THEN en ELSE "end" END AS "end",
  NOT (st IS NOT NULL AND en IS NOT NULL) AS imprecise FROM m""")
def clip_confirmation(spark, d):
    r = views.regions(spark, d).filter("svtype = 'DEL'").select(*BY)
    return calls.confirm_with_clips(r, clusters(spark, d)).select("id", "chrom", "start", "end", "imprecise")


def contig_alignments(spark, d):
    """Assembled-contig alignments spelled from regions: one to three per region."""
    return views.regions(spark, d).selectExpr("id", "explode(sequence(0, CAST(id % 4 AS INT))) AS n").selectExpr(
        "id", "n", "IF(id % 3 = 0, 1, IF(id % 3 = 1, IF(n = 1, 2, 1), n)) AS node"
    ).selectExpr(
        "id", "concat('NODE_', node, '_length_', 300 + id % 50, '_cov_', 20 + (id * (node + 1)) % 17) AS qname",
        "CAST(n * 150 AS BIGINT) AS qst", "CAST(n * 150 + 150 + id % 20 AS BIGINT) AS qed",
        "CAST(n * 200 AS BIGINT) AS rst", "CAST(n * 200 + 160 + id % 60 AS BIGINT) AS red", "120 + id % 30 AS qal")


@query("gt01_genotypes", "regions", """
al0 AS (SELECT id, unnest(range(0, id % 4 + 1)) AS n FROM regions),
al AS (SELECT id, n, CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN CASE WHEN n = 1 THEN 2 ELSE 1 END ELSE n END AS nm FROM al0),
aa AS (SELECT id, n, nm, 20 + (id * (nm + 1)) % 17 AS cov,
  n * 150 AS qlo, n * 150 + 150 + id % 20 AS qhi, n * 200 AS lo, n * 200 + 160 + id % 60 AS hi FROM al),
k AS (SELECT id, count(*) AS k, count(DISTINCT nm) AS names,
  max(CASE WHEN n = 0 THEN hi END) AS h0, max(CASE WHEN n = 1 THEN lo END) AS l1, max(CASE WHEN n = 1 THEN hi END) AS h1, max(CASE WHEN n = 2 THEN lo END) AS l2,
  max(CASE WHEN n = 0 THEN qhi END) AS q0, max(CASE WHEN n = 1 THEN qlo END) AS q1,
  max(CASE WHEN n = 0 THEN cov END) AS c0, max(CASE WHEN n = 1 THEN cov END) AS c1, max(CASE WHEN n = 2 THEN cov END) AS c2 FROM aa GROUP BY id),
t AS (SELECT r.*, k.*, CASE
    WHEN svtype = 'DEL' AND k = 2 AND names = 1 AND abs(q0 - q1) <= 50 THEN 'a'
    WHEN svtype = 'DEL' AND k = 3 AND names = 2 AND abs(h0 - l1) <= 50 AND abs(h1 - l2) <= 50 THEN 'b'
    WHEN svtype = 'DEL' AND k = 3 AND names = 3 AND abs(h0 - l1) <= 50 AND abs(h1 - l2) <= 50 THEN 'c'
    WHEN svtype = 'INS' AND k = 2 AND names = 2 AND abs(h0 - l1) <= 100 THEN 'd' WHEN svtype = 'INS' AND k = 1 THEN 'e' END AS br FROM regions r JOIN k ON k.id = r.id)
SELECT id, CASE br WHEN 'b' THEN 'TRD' WHEN 'c' THEN CASE WHEN c1 / CAST(c0 AS DOUBLE) < 0.7e0 AND c1 / CAST(c2 AS DOUBLE) < 0.7e0 THEN 'DEL'
    WHEN c1 / CAST(c0 AS DOUBLE) > 1.3e0 AND c1 / CAST(c2 AS DOUBLE) > 1.3e0 THEN 'TDD' ELSE 'TRD' END ELSE svtype END AS gtype,
  CAST(CASE WHEN br = 'c' THEN c1 WHEN br IS NOT NULL THEN c0 END AS INT) AS dp,
  CASE WHEN br IN ('a', 'b', 'd') THEN '1/1' WHEN br IN ('c', 'e') THEN '0/1' ELSE '.' END AS gt,
  CAST(CASE WHEN br IN ('a', 'b', 'c') THEN start + h0 WHEN br = 'd' THEN round((2 * start + h0 + l1) / 2e0) ELSE start END AS BIGINT) AS "Lbr",
  CAST(CASE WHEN br = 'a' THEN start + l1 WHEN br IN ('b', 'c') THEN start + l2 WHEN br = 'd' THEN round((2 * start + h0 + l1) / 2e0) ELSE "end" END AS BIGINT) AS "Rbr" FROM t""")
def genotypes(spark, d):
    out = genotype.genotype_regions(views.regions(spark, d).select(*BY, "svtype"), contig_alignments(spark, d), 100)
    return out.select("id", "gtype", "dp", "gt", "Lbr", "Rbr")


@query("snk07_genotyped_records", "regions", """
SELECT chrom AS "CHROM", start + 3 AS "POS", "end" + 5 AS "END", CAST(id AS VARCHAR) AS "ID", 'SVTYPE=' || svtype || ';END=' || CAST("end" + 5 AS VARCHAR) || ';SVLEN=' || CAST("end" + 2 - start AS VARCHAR) || ';SOMATIC;' AS "INFO",
  CASE WHEN id % 2 = 0 THEN '0/1' ELSE '1/1' END || ':30:' || CAST(id % 40 AS VARCHAR) AS sp FROM regions""")
def genotyped_records(spark, d):
    r = views.regions(spark, d)
    rows = vcf.call_records(r.select("id", "chrom", "start", "end", "svtype"))
    gts = r.selectExpr("CAST(id AS STRING) AS ID", "IF(id % 2 = 0, '0/1', '1/1') AS gt", "'30' AS gq", "CAST(id % 40 AS INT) AS dp", "start + 3 AS Lbr", "end + 5 AS Rbr")
    return vcf.genotype_records(rows, gts, "sp").select("CHROM", "POS", "END", "ID", "INFO", "sp")


@query("jn16_bin_thresholds", "aln", """
b AS (SELECT chrom, (pos - 1) // 1000 AS bin, round(avg(mapq), 6) AS lcd FROM aln GROUP BY ALL)
SELECT DISTINCT a.chrom, (a.pos - 1) // 10 * 10 + 1 AS t, b.lcd FROM aln a LEFT JOIN b ON b.chrom = a.chrom AND b.bin = ((a.pos - 1) // 10 * 10) // 1000""")
def bin_thresholds(spark, d):
    reads = views.aln(spark, d)
    bins = reads.groupBy("chrom", F.floor((F.col("pos") - 1) / 1000.0).alias("bin")).agg(F.round(F.avg("mapq"), 6).alias("lcd"))
    windows = reads.select("chrom", (F.floor((F.col("pos") - 1) / 10.0) * 10 + 1).alias("t")).distinct()
    return calls.bin_thresholds(windows, bins, ["chrom"], 1000).select("chrom", "t", "lcd")
