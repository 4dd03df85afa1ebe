"""Breakend tables and event types."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import breakends as be
from ..session import cut_lineage
from ..sinks import vcf
from .clips import breakend_rows, case_clusters
from .registry import query
from .shared import CLUSTERS_SQL

CANON = """
canon AS (SELECT * FROM (SELECT
  CASE WHEN keep THEN chr1 ELSE chr2 END AS chr1, CASE WHEN keep THEN pos1 ELSE pos2 END AS pos1, CASE WHEN keep THEN "goRight1" ELSE "goRight2" END AS "goRight1",
  CASE WHEN keep THEN chr2 ELSE chr1 END AS chr2, CASE WHEN keep THEN pos2 ELSE pos1 END AS pos2, CASE WHEN keep THEN "goRight2" ELSE "goRight1" END AS "goRight2",
  CASE WHEN keep THEN cid ELSE mcid END AS cid, CASE WHEN keep THEN mcid ELSE cid END AS mcid
  FROM (SELECT *, CASE WHEN chr1 = chr2 THEN pos2 > pos1 ELSE chr2 > chr1 END AS keep FROM bnd)))"""
COLS = 'chr1, pos1, "goRight1", chr2, pos2, "goRight2", cid, mcid'


def canon(spark, d):
    return be.canonical(views.breakends(spark, d))


@query("prj02_canonical_breakends", "aln bnd", CANON + f"\nSELECT {COLS} FROM canon")
def canonical(spark, d):
    return canon(spark, d)


@query("flt05_separated_breakends", "aln bnd", CANON + f"\nSELECT {COLS} FROM canon WHERE chr1 <> chr2 OR pos2 - pos1 >= 1100")
def separated(spark, d):
    return be.separated(canon(spark, d), 1100)


@query("flt07_target_chromosome", "aln bnd", CANON + f"\nSELECT {COLS} FROM canon WHERE chr1 = 'chr2' OR chr2 = 'chr2'")
def target_chromosome(spark, d):
    return be.on_chromosomes(canon(spark, d), ["chr2"])


@query("wn01_distance_to_next", "aln bnd", """
pts AS (SELECT DISTINCT chr1, pos1 FROM bnd)
SELECT chr1, pos1, lead(pos1) OVER (PARTITION BY chr1 ORDER BY pos1) - pos1 AS to_next FROM pts""")
def distance_to_next(spark, d):
    points = views.breakends(spark, d).select("chr1", "pos1").distinct().withColumn("_from", F.col("pos1") + 1)
    found = be.next_at_or_after(points, points, ["chr1"], "_from", "pos1", "_next", tile=4096)
    return found.select("chr1", "pos1", (F.col("_next") - F.col("pos1")).alias("to_next"))


@query("wn02_hotspots", "aln bnd", """
o AS (SELECT *, pos1 - lag(pos1) OVER (PARTITION BY chr1 ORDER BY pos1, cid) AS d FROM bnd),
g AS (SELECT *, sum(CASE WHEN d IS NULL OR d >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY chr1 ORDER BY pos1, cid) AS gid FROM o)
SELECT chr1, pos1, cid, count(*) OVER (PARTITION BY chr1, gid) > 5 AS hot FROM g""")
def hotspots(spark, d):
    return be.hotspots(views.breakends(spark, d).select("chr1", "pos1", "cid"), ["chr1"], "pos1", 20, 3).select("chr1", "pos1", "cid", "hot")


@query("wn09_near_duplicates", "aln bnd", CANON + f"""
SELECT {COLS} FROM canon j WHERE NOT EXISTS (SELECT 1 FROM canon i WHERE i.chr1 = j.chr1 AND i.chr2 = j.chr2 AND i."goRight1" = j."goRight1" AND i."goRight2" = j."goRight2"
  AND abs(i.pos1 - j.pos1) < 100 AND abs(i.pos2 - j.pos2) < 100 AND (i.pos1, i.pos2, i.cid, i.mcid) < (j.pos1, j.pos2, j.cid, j.mcid))""")
def near_duplicates(spark, d):
    return be.drop_near_duplicates(canon(spark, d), 100)


@query("flt06_away_from_gaps", "aln bnd gaps", f"""
SELECT {COLS} FROM bnd b WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE
  (g.chrom = b.chr1 AND b.pos1 > g.start - 300 AND b.pos1 < g."end" + 300) OR (g.chrom = b.chr2 AND b.pos2 > g.start - 300 AND b.pos2 < g."end" + 300))""")
def away_from_gaps(spark, d):
    return be.away_from_gaps(views.breakends(spark, d), views.gaps(spark, d), 300).select(*be.COLUMNS)


NUMBERED = CANON + """,
sep AS (SELECT * FROM canon WHERE chr1 <> chr2 OR pos2 - pos1 >= 25),
num AS (SELECT *, row_number() OVER (ORDER BY chr1, pos1, chr2, pos2, "goRight1", "goRight2", cid, mcid) AS row FROM sep),
e AS (SELECT row, 1 AS e, chr1 AS chrom, pos1 AS pos, "goRight1" AS rt FROM num UNION ALL SELECT row, 2, chr2, pos2, "goRight2" FROM num)"""


def numbered(spark, d):
    return cut_lineage(be.number_rows(be.separated(canon(spark, d))))


@query("jn14_adjacent_breakends", "aln bnd", NUMBERED + """
SELECT a.row AS i, CAST(a.e AS INT) AS ei, b.row AS j, CAST(b.e AS INT) AS ej FROM e a JOIN e b ON a.chrom = b.chrom AND a.row < b.row
WHERE (NOT a.rt AND b.rt AND b.pos - a.pos BETWEEN 0 AND 99) OR (a.rt AND NOT b.rt AND a.pos - b.pos BETWEEN 0 AND 99)""")
def adjacent_breakends(spark, d):
    return be.adjacent_pairs(numbered(spark, d), 100).select("i", "ei", "j", "ej")


def spans(spark, d, sample):
    return views.aln(spark, d).filter(f"sample = '{sample}'").selectExpr("chrom", "pos AS start", "pos + 99 AS end")


def _fold_sql(control: bool) -> str:
    n = lambda s, e, sample: f"(SELECT count(*) FROM aln a WHERE a.sample = '{sample}' AND a.chrom = r.chrom AND a.pos <= {e} AND a.pos + 99 >= {s})"
    mid1, mid2 = "st + CAST(floor((ed - st) / 2e0) AS BIGINT)", "st + CAST(ceil((ed - st) / 2e0) AS BIGINT)"
    event = lambda sample: f"{n('st', mid1, sample)} + {n(mid2, 'ed', sample)}"
    if control:
        return f"CAST({event('case')} AS DOUBLE) / ({event('control')} + 1e0)", f"{event('control')} + 1"
    around = f"{n('st - 10000', 'st', 'case')} + {n('ed', 'ed + 10000', 'case')}"
    return f"(CAST({event('case')} AS DOUBLE) / ({around} + 1e0)) / ((ed - st) / 20002e0)", f"{around} + 1"


def fold_regions(spark, d):
    return views.regions(spark, d).selectExpr("chrom", "start AS st", "end + 100 AS ed").distinct()


@query("ag16_fold_change_control", "aln regions", f"""
r AS (SELECT DISTINCT chrom, start AS st, "end" + 100 AS ed FROM regions)
SELECT chrom, st, ed, round({_fold_sql(True)[0]}, 6) AS fc, {_fold_sql(True)[1]} AS contrast FROM r""")
def fold_change_control(spark, d):
    out = be.fold_change(fold_regions(spark, d), spans(spark, d, "case"), spans(spark, d, "control"))
    return out.select("chrom", "st", "ed", F.round("fc", 6).alias("fc"), "contrast")


@query("ag16_fold_change_bracket", "aln regions", f"""
r AS (SELECT DISTINCT chrom, start AS st, "end" + 100 AS ed FROM regions)
SELECT chrom, st, ed, round({_fold_sql(False)[0]}, 6) AS fc, {_fold_sql(False)[1]} AS contrast FROM r""")
def fold_change_bracket(spark, d):
    out = be.fold_change(fold_regions(spark, d), spans(spark, d, "case"), None)
    return out.select("chrom", "st", "ed", F.round("fc", 6).alias("fc"), "contrast")


def events(spark, d, c=None):
    """Typed breakends of the whole clip pipeline on the case sample; ``c``: its clusters, made here if not given."""
    rows = cut_lineage(be.canonical(breakend_rows(spark, d, c).drop("rc")))
    kept = be.separated(be.drop_near_duplicates(rows, views.READ_LENGTH))
    return cut_lineage(be.classify(cut_lineage(be.number_rows(kept)), views.READ_LENGTH, spans(spark, d, "case"), spans(spark, d, "control")))


@query("ev01_event_types")
def event_types(spark, d):
    return events(spark, d).withColumn("FoldChange", F.round("FoldChange", 6))


@query("ev02_pair_events")
def pair_events(spark, d):
    """Classification of the discordant-pair breakends without coverage checks."""
    return be.classify(numbered(spark, d), 100, None)


@query("ev03_single_breakend_calls", "aln bnd", CANON + f"""
SELECT {COLS}, CASE WHEN chr1 <> chr2 THEN 'INTERCHROMOSOMAL' WHEN NOT "goRight1" AND "goRight2" AND pos2 - pos1 < 10000 THEN 'DEL'
  WHEN "goRight1" AND NOT "goRight2" AND pos2 - pos1 < 10000 THEN 'TANDEM.DUP' END AS event FROM canon""")
def single_breakend_calls(spark, d):
    """Types of breakends taken one by one (no adjacent partner, no coverage)."""
    return be.single_events(canon(spark, d))


@query("ev05_interchromosomal", "aln bnd", CANON + "\nSELECT chr1, chr2, count(*) AS n FROM canon WHERE chr1 <> chr2 GROUP BY chr1, chr2")
def interchromosomal(spark, d):
    return be.single_events(canon(spark, d)).filter("event = 'INTERCHROMOSOMAL'").groupBy("chr1", "chr2").agg(F.count("*").alias("n"))


PAIRED_CLIPS = CLUSTERS_SQL + """,
l AS (SELECT chrom, position, nreads FROM clusters WHERE sample = 'case' AND side = 'L'), r AS (SELECT chrom, position, nreads FROM clusters WHERE sample = 'case' AND side = 'R'),
c AS (SELECT l.chrom, l.position AS "Lclip", r.position AS "Rclip", l.nreads + r.nreads AS reads, r.position - l.position AS dist,
  row_number() OVER (PARTITION BY l.chrom, l.position ORDER BY abs(r.position - l.position), r.position) AS rn
  FROM l JOIN r ON r.chrom = l.chrom AND r.position - l.position BETWEEN -1 AND 100)"""


def clip_sides(spark, d):
    c = case_clusters(spark, d).withColumn("cid", F.concat_ws(":", "side", "chrom", F.col("position").cast("string")))
    pick = lambda s: c.filter(F.col("side") == s).select("chrom", "position", "nreads", "mismatch", "cid")
    return pick("L"), pick("R")


@query("jn13_clip_pairs", "aln", PAIRED_CLIPS + '\nSELECT chrom, "Lclip", "Rclip", reads, dist FROM c WHERE rn = 1')
def clip_pairs(spark, d):
    left, right = clip_sides(spark, d)
    paired = be.pair_clips(left, right.withColumnRenamed("position", "position_r"), views.READ_LENGTH).filter("Rclip IS NOT NULL")
    return paired.select("chrom", F.col("position").alias("Lclip"), "Rclip", (F.col("nreads") + F.col("Rreads")).alias("reads"), "dist")


@query("ev06_insertions", "aln", PAIRED_CLIPS + """,
nx AS (SELECT l.chrom, l.position, min(r.position) - l.position AS d FROM l JOIN r ON r.chrom = l.chrom AND r.position >= l.position - 1 GROUP BY l.chrom, l.position),
lim AS (SELECT least(25e0, greatest(quantile_cont(d, 0.1), 10e0)) AS g FROM nx)
SELECT chrom AS chr1, "Lclip" AS pos1, "Rclip" AS pos2, dist AS "Distance", reads FROM c, lim WHERE rn = 1 AND reads >= 6 AND dist <= g""")
def insertions(spark, d):
    left, right = clip_sides(spark, d)
    return be.call_insertions(left, right, views.READ_LENGTH, 6).select("chr1", "pos1", "pos2", "Distance", "reads")


@query("jn18_partner_rows")
def partner_rows(spark, d):
    """Each paired event with its partner row's ends."""
    e = be.classify(numbered(spark, d), 100, None)
    other = e.select(F.col("row").alias("Partner"), F.col("pos1").alias("partner_pos1"), F.col("pos2").alias("partner_pos2"))
    return e.filter("Partner IS NOT NULL").join(other, "Partner").select("row", "Partner", "EventType", "pos1", "pos2", "partner_pos1", "partner_pos2")


ALT = """
alt AS (SELECT *, CASE WHEN "goRight2" THEN '[' ELSE ']' END AS m2, CASE WHEN "goRight1" THEN '[' ELSE ']' END AS m1 FROM bnd)"""


@query("scf22_breakend_alt", "aln bnd", ALT + """
SELECT cid, CASE WHEN "goRight1" THEN m2 || chr2 || ':' || CAST(pos2 AS VARCHAR) || m2 || 'N' ELSE 'N' || m2 || chr2 || ':' || CAST(pos2 AS VARCHAR) || m2 END AS alt FROM alt""")
def breakend_alt(spark, d):
    from ..functions.records import breakend_alt as alt

    b = views.breakends(spark, d)
    return b.select("cid", alt(F.col("chr2"), F.col("pos2"), F.lit("N"), F.col("goRight1"), F.col("goRight2"), F.lit("")).alias("alt"))


@query("snk05_breakend_records", "aln bnd", ALT + """,
two AS (SELECT cid || '_1' AS "ID", cid || '_2' AS mate, chr1 AS "CHROM", pos1 AS "POS", "goRight1" AS own, m2 AS m, chr2 AS oc, pos2 AS op FROM alt
  UNION ALL SELECT cid || '_2', cid || '_1', chr2, pos2, "goRight2", m1, chr1, pos1 FROM alt)
SELECT "CHROM", "POS", "ID", 'N' AS "REF", CASE WHEN own THEN m || oc || ':' || CAST(op AS VARCHAR) || m || 'N' ELSE 'N' || m || oc || ':' || CAST(op AS VARCHAR) || m END AS "ALT",
  '.' AS "QUAL", 'PASS' AS "FILTER", 'SVTYPE=BND;MATEID=' || mate || ';SOMATIC' AS "INFO" FROM two""")
def breakend_records(spark, d):
    return vcf.breakend_records(views.breakends(spark, d).withColumn("id", F.col("cid")))


@query("snk06_event_records")
def event_records(spark, d):
    """VCF rows of the typed breakends, one per event."""
    c = case_clusters(spark, d)
    support = c.select(F.concat_ws(":", "side", "chrom", F.col("position").cast("string")).alias("cid"), "nreads")
    return vcf.event_records(events(spark, d, c), support)
