"""Interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import intervals as iv
from ..operators.mates import map_positions
from .registry import query

READS = 'reads AS (SELECT rid, sample, chrom, pos AS start, pos + 99 AS "end", isize FROM aln)'


def read_spans(spark, d):
    return views.aln(spark, d).select("rid", "sample", "chrom", F.col("pos").alias("start"), (F.col("pos") + 99).alias("end"), "isize", "flag")


@query("jn02_point_in_interval", "aln regions", """
SELECT id, chrom, start, "end", (SELECT count(*) FROM aln a WHERE a.chrom = r.chrom AND a.pos BETWEEN r.start AND r."end") AS n FROM regions r""")
def points_in_regions(spark, d):
    reads = views.aln(spark, d).groupBy("chrom", "pos").agg(F.count("*").alias("n"))
    return iv.range_sums(views.regions(spark, d).select("id", "chrom", "start", "end"), reads, ["chrom"], "start", "end", "pos", ["n"])


@query("jn03_count_overlaps", "aln regions", READS + """
SELECT r.id, (SELECT count(*) FROM reads a WHERE a.chrom = r.chrom AND a.start <= r."end" AND a."end" >= r.start) AS n FROM regions r""")
def region_read_counts(spark, d):
    regions = views.regions(spark, d).select("id", "chrom", "start", "end")
    return iv.count_overlaps(regions, read_spans(spark, d), ["chrom"], "start", "end", "start", "end").select("id", "n")


@query("jn04_equal_ranges", "aln", READS + """
SELECT chrom, start, "end", count(*) AS n FROM reads GROUP BY chrom, start, "end" """)
def equal_ranges(spark, d):
    return read_spans(spark, d).groupBy("chrom", "start", "end").agg(F.count("*").alias("n"))


@query("flt10_repeated_ranges", "aln", READS + """
SELECT chrom, start, "end", count(*) AS n FROM reads GROUP BY chrom, start, "end" HAVING count(*) > 5""")
def repeated_ranges(spark, d):
    return read_spans(spark, d).groupBy("chrom", "start", "end").agg(F.count("*").alias("n")).filter("n > 5")


@query("jn09_gap_mask", "aln gaps", """
SELECT rid, chrom, pos FROM aln a WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.chrom = a.chrom AND a.pos BETWEEN g.start AND g."end")""")
def gap_mask(spark, d):
    return iv.points_in(views.aln(spark, d).select("rid", "chrom", "pos"), views.gaps(spark, d), ["chrom"], "pos", keep=False).select("rid", "chrom", "pos")


@query("flt06_gap_distance", "aln gaps", """
pts AS (SELECT DISTINCT chrom, pos FROM aln)
SELECT p.chrom, p.pos, (SELECT min(CASE WHEN p.pos BETWEEN g.start AND g."end" THEN 0 ELSE least(abs(g.start - p.pos), abs(g."end" - p.pos)) END)
  FROM gaps g WHERE g.chrom = p.chrom) AS gap_distance FROM pts p""")
def gap_distance(spark, d):
    points = views.aln(spark, d).select("chrom", "pos").distinct()
    return iv.distance_to(points, views.gaps(spark, d), ["chrom"], "pos")


@query("ag07_range_sums", "aln regions", """
SELECT r.id, (SELECT CAST(coalesce(sum(mapq), 0) AS BIGINT) FROM aln a WHERE a.chrom = r.chrom AND a.pos BETWEEN r.start AND r."end") AS mapq_sum FROM regions r""")
def range_sums(spark, d):
    weights = views.aln(spark, d).select("chrom", "pos", F.col("mapq").cast("long").alias("mapq_sum"))
    regions = views.regions(spark, d).select("id", "chrom", "start", "end")
    return iv.range_sums(regions, weights, ["chrom"], "start", "end", "pos", ["mapq_sum"]).select("id", "mapq_sum")


@query("ag21_depth_runs", "aln", READS + """,
ev AS (SELECT sample, chrom, p, sum(s) AS d FROM (SELECT sample, chrom, start AS p, 1 AS s FROM reads UNION ALL SELECT sample, chrom, "end" + 1, -1 FROM reads) GROUP BY ALL HAVING sum(s) <> 0),
runs AS (SELECT sample, chrom, p AS start, lead(p) OVER w - 1 AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY sample, chrom ORDER BY p))
SELECT sample, chrom, start, "end", depth FROM runs WHERE depth > 0""")
def depth_runs(spark, d):
    return iv.interval_runs(read_spans(spark, d), ["sample", "chrom"], "start", "end", {"depth": F.lit(1)}, merge=True, tile=4096)


@query("ag21_mean_depth", "aln", """
base AS (SELECT sample, chrom, unnest(range(pos, pos + 100)) AS p FROM aln), per AS (SELECT sample, chrom, p, count(*) AS d FROM base GROUP BY ALL)
SELECT sample, chrom, count(*) AS covered, round(CAST(sum(d) AS DOUBLE) / count(*), 6) AS mean_depth, max(d) AS max_depth FROM per GROUP BY sample, chrom""")
def mean_depth(spark, d):
    runs = iv.interval_runs(read_spans(spark, d), ["sample", "chrom"], "start", "end", {"depth": F.lit(1)})
    width = F.col("end") - F.col("start") + 1
    return runs.groupBy("sample", "chrom").agg(
        F.sum(width).alias("covered"), F.round(F.sum(width * F.col("depth")) / F.sum(width), 6).alias("mean_depth"), F.max("depth").alias("max_depth")
    )


@query("jn10_region_difference", "regions", """
SELECT id, chrom, start, "end" FROM regions a WHERE sample = 'case' AND NOT EXISTS (
  SELECT 1 FROM regions b WHERE b.sample = 'control' AND b.chrom = a.chrom AND b.start <= a."end" AND b."end" >= a.start)""")
def region_difference(spark, d):
    from ..operators.calls import region_difference as difference

    r = views.regions(spark, d).select("id", "sample", "chrom", "start", "end")
    return difference(r.filter("sample = 'case'"), r.filter("sample = 'control'"), ["chrom"]).select("id", "chrom", "start", "end")


@query("jn11_first_overlap", "regions", """
SELECT a.id, min(b.id) AS first_hit, count(b.id) AS n_hits FROM regions a LEFT JOIN regions b
  ON b.sample = 'control' AND b.chrom = a.chrom AND b.start <= a."end" AND b."end" >= a.start WHERE a.sample = 'case' GROUP BY a.id""")
def first_overlap(spark, d):
    from ..operators.calls import first_overlap as first

    r = views.regions(spark, d).select("id", "sample", "chrom", "start", "end")
    hit = first(r.filter("sample = 'case'"), r.filter("sample = 'control'"), ["chrom"], "id")
    return hit.select("id", "first_hit", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


@query("jn17_truth_overlap", "regions", """
SELECT id FROM regions a WHERE svtype = 'DEL' AND EXISTS (
  SELECT 1 FROM regions b WHERE b.svtype = 'DUP' AND b.chrom = a.chrom AND b.start <= a."end" AND b."end" >= a.start)""")
def truth_overlap(spark, d):
    r = views.regions(spark, d)
    return iv.overlapping(r.filter("svtype = 'DEL'"), r.filter("svtype = 'DUP'"), ["chrom"]).select("id")


@query("jn12_nearest_within", "aln regions", """
pts AS (SELECT DISTINCT chrom, pos FROM aln WHERE contains(cigar, 'S')), tgt AS (SELECT chrom, start, min(id) AS id FROM regions GROUP BY chrom, start),
c AS (SELECT p.chrom, p.pos, t.id, t.start - p.pos AS dist, row_number() OVER (PARTITION BY p.chrom, p.pos ORDER BY abs(t.start - p.pos), t.start) AS rn
  FROM pts p JOIN tgt t ON t.chrom = p.chrom AND t.start BETWEEN p.pos - 99 AND p.pos + 99)
SELECT chrom, pos, dist, id FROM c WHERE rn = 1""")
def nearest(spark, d):
    points = views.aln(spark, d).filter(F.col("cigar").contains("S")).select("chrom", "pos").distinct()
    targets = views.regions(spark, d).groupBy("chrom", F.col("start").alias("at")).agg(F.min("id").alias("id"))
    return iv.nearest_within(points, targets, ["chrom"], "pos", "at", 99, {"id": F.col("id")}, tile=4096).filter("dist IS NOT NULL").select("chrom", "pos", "dist", "id")


@query("wn05_merged_regions", "regions", """
o AS (SELECT *, max("end") OVER (PARTITION BY chrom, svtype ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM regions),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR start - prev > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, svtype ORDER BY start, "end", id) AS gid FROM o)
SELECT chrom, svtype, min(start) AS start, max("end") AS "end", count(*) AS n, max(score) AS top FROM g GROUP BY chrom, svtype, gid""")
def merged_regions(spark, d):
    return iv.islands(views.regions(spark, d), ["chrom", "svtype"], "start", "end", 10, {"n": ("sum", F.lit(1)), "top": ("max", F.col("score"))}, tile=2048)


@query("ag18_window_event_count", "aln", """
ends AS (SELECT chrom, max(pos) AS hi FROM aln GROUP BY chrom), wins AS (SELECT chrom, unnest(range(1, hi + 1, 200)) AS t FROM ends)
SELECT w.chrom, w.t, count(*) AS n FROM wins w JOIN aln a ON a.chrom = w.chrom AND a.pos >= w.t AND a.pos < w.t + 500 GROUP BY w.chrom, w.t""")
def window_event_count(spark, d):
    from ..operators.scan import window_counts

    reads = views.aln(spark, d).select("chrom", F.col("pos").alias("s"), F.col("pos").alias("e"))
    last = reads.groupBy("chrom").agg(F.max("s").alias("hi"))
    return window_counts(reads, ["chrom"], "s", "e", 500, 200).join(last, "chrom").filter("t <= hi").select("chrom", "t", "n")
