"""Anchor clustering and paired-event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import anchors as an
from ..operators.pairedscan import paired_event_scan
from .registry import query

LINE = """
off AS (SELECT chrom, coalesce(sum(length) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, (sum(length) OVER ())::BIGINT AS total FROM contigs),
offs AS (SELECT chrom, true AS fwd, b AS o FROM off UNION ALL SELECT chrom, false, b + total FROM off),
lin0 AS (SELECT a.sample, a.lst + l.o AS ls, a.led + l.o AS le, a.rst + r.o AS rs, a.red + r.o AS re FROM anchors a
  JOIN offs l ON l.chrom = a.lchr AND l.fwd = a.lfwd JOIN offs r ON r.chrom = a.rchr AND r.fwd = a.rfwd),
line AS (SELECT sample, CASE WHEN rs >= ls THEN ls ELSE rs END AS lst, CASE WHEN rs >= ls THEN le ELSE re END AS led,
  CASE WHEN rs >= ls THEN rs ELSE ls END AS rst, CASE WHEN rs >= ls THEN re ELSE le END AS red FROM lin0)"""


def sweep_sql(source: str, tag: str) -> str:
    """Parent pointers and their roots over the distinct anchors of ``source``."""
    return f"""
n{tag} AS (SELECT *, row_number() OVER (ORDER BY lst, led, rst, red) AS id FROM (SELECT DISTINCT lst, led, rst, red FROM {source})),
p{tag} AS (SELECT i.id, coalesce(min(j.id), i.id) AS parent FROM n{tag} i LEFT JOIN n{tag} j ON j.id < i.id AND j.led >= i.lst AND j.lst <= i.led
  AND j.red >= i.rst AND j.rst <= i.red AND j.red >= i.lst GROUP BY i.id),
r{tag} AS (SELECT id, parent AS root FROM p{tag} WHERE id = parent UNION ALL SELECT p.id, r.root FROM p{tag} p JOIN r{tag} r ON p.parent = r.id WHERE p.id <> p.parent)"""


def back_sql(source: str) -> str:
    side = lambda s, e: f"(SELECT arg_max({{}}, o) FROM offs WHERE o < c.{s})"
    f = lambda s, e, what: side(s, e).format(what)
    return f"""
SELECT {f('lst', 'led', 'fwd')} AS lfwd, {f('lst', 'led', 'chrom')} AS lchr, lst - {f('lst', 'led', 'o')} AS lst, led - {f('lst', 'led', 'o')} AS led,
  {f('rst', 'red', 'fwd')} AS rfwd, {f('rst', 'red', 'chrom')} AS rchr, rst - {f('rst', 'red', 'o')} AS rst, red - {f('rst', 'red', 'o')} AS red, sup FROM {source} c"""


def line(spark, d, sample=None):
    return an.to_line(views.anchors(spark, d, sample), an.strand_offsets(views.contigs(spark, d)))


@query("prj03_linear_coordinates", "aln anchors contigs", LINE + "\nSELECT lst, led, rst, red, count(*) AS n FROM line GROUP BY ALL")
def linear_coordinates(spark, d):
    return line(spark, d).groupBy(*an.KEY).agg(F.count("*").alias("n"))


@query("prj04_genome_coordinates", "aln anchors contigs", LINE + ", one AS (SELECT lst, led, rst, red, count(*) AS sup FROM line GROUP BY ALL)" + back_sql("one"))
def genome_coordinates(spark, d):
    return an.from_line(line(spark, d).groupBy(*an.KEY).agg(F.count("*").alias("sup")), an.strand_offsets(views.contigs(spark, d)))


@query("srt02_sweep_events", "aln anchors contigs", LINE + """,
ev AS (SELECT lst AS pos, lst || '-' || rst AS idx, true AS is_in FROM line UNION ALL SELECT red, lst || '-' || rst, false FROM line)
SELECT pos, idx, is_in FROM ev ORDER BY pos, idx, is_in DESC""")
def sweep_events(spark, d):
    named = line(spark, d).withColumn("idx", F.concat(F.col("lst").cast("string"), F.lit("-"), F.col("rst").cast("string")))
    return an.sweep_events(named, "idx").orderBy("pos", "idx", F.desc("is_in"))


@query("wn08_sweep_clusters", "aln anchors contigs", LINE + "," + sweep_sql("line", "a") + """
SELECT n.lst, n.led, n.rst, n.red, m.lst AS root_lst, m.led AS root_led, m.rst AS root_rst, m.red AS root_red FROM ra JOIN na n ON n.id = ra.id JOIN na m ON m.id = ra.root""", recursive=True)
def sweep_clusters(spark, d):
    found = an.sweep_clusters(line(spark, d))
    return found.select(*an.KEY, *[F.col(f"root.{c}").alias(f"root_{c}") for c in an.KEY])


@query("jn15_both_overlap", "aln anchors contigs", LINE + "," + sweep_sql("line", "a") + """
SELECT n.lst, n.led, n.rst, n.red, m.lst AS p_lst, m.led AS p_led, m.rst AS p_rst, m.red AS p_red FROM pa JOIN na n ON n.id = pa.id JOIN na m ON m.id = pa.parent WHERE pa.id <> pa.parent""", recursive=True)
def both_overlap(spark, d):
    """Each anchor with the first earlier anchor that overlaps it on both ends."""
    links = an.first_partners(line(spark, d))
    return links.select("node.*", *[F.col(f"parent.{c}").alias(f"p_{c}") for c in an.KEY])


def collapse_sql(source: str, tag: str, out: str) -> str:
    return f"""
{out} AS (SELECT min(w.lst) AS lst, max(w.led) AS led, min(w.rst) AS rst, max(w.red) AS red, CAST(sum(w.k) AS BIGINT) AS sup
  FROM (SELECT lst, led, rst, red, count(*) AS k FROM {source} GROUP BY ALL) w JOIN n{tag} n ON (n.lst, n.led, n.rst, n.red) = (w.lst, w.led, w.rst, w.red) JOIN r{tag} r ON r.id = n.id GROUP BY r.root)"""


@query("cl01_anchor_clusters", "aln anchors contigs", LINE + "," + sweep_sql("line", "a") + "," + collapse_sql("line", "a", "cl") + back_sql("cl"), recursive=True)
def anchor_clusters(spark, d):
    return an.cluster_anchors(views.anchors(spark, d), views.contigs(spark, d))


@query("ag14_cluster_collapse", "aln anchors contigs", LINE + "," + sweep_sql("line", "a") + "," + collapse_sql("line", "a", "cl") + "\nSELECT lst, led, rst, red, sup FROM cl", recursive=True)
def cluster_collapse(spark, d):
    on_line = line(spark, d)
    return an.collapse(on_line, an.sweep_clusters(on_line))


@query("cl02_contrast_clusters", "aln anchors contigs", LINE + """,
x AS (SELECT lst, led, rst, red FROM line WHERE sample = 'case'), y AS (SELECT lst, led, rst, red FROM line WHERE sample = 'control'),""" + sweep_sql("x", "x") + "," + sweep_sql("y", "y") + ","
    + collapse_sql("x", "x", "cx") + "," + collapse_sql("y", "y", "cy") + ", both_ AS (SELECT * FROM cx UNION ALL SELECT lst, led, rst, red, -sup FROM cy)," + sweep_sql("both_", "b") + """,
j AS (SELECT b.*, r.root FROM both_ b JOIN nb n ON (n.lst, n.led, n.rst, n.red) = (b.lst, b.led, b.rst, b.red) JOIN rb r ON r.id = n.id),
m AS (SELECT min(lst) FILTER (sup > 0) AS lst, max(led) FILTER (sup > 0) AS led, min(rst) FILTER (sup > 0) AS rst, max(red) FILTER (sup > 0) AS red,
  CAST(coalesce(sum(sup) FILTER (sup > 0), 0) AS BIGINT) AS sup, coalesce(-sum(sup) FILTER (sup < 0), 0) AS ctl FROM j GROUP BY root HAVING coalesce(sum(sup) FILTER (sup > 0), 0) >= 2 AND coalesce(-sum(sup) FILTER (sup < 0), 0) < 2)""" + back_sql("m"), recursive=True)
def contrast_clusters(spark, d):
    return an.contrast_clusters(views.anchors(spark, d, "case"), views.anchors(spark, d, "control"), views.contigs(spark, d), 2, 2)


@query("ag15_contrast_support", "aln anchors contigs", LINE + """,
x AS (SELECT lst, led, rst, red FROM line WHERE sample = 'case'), y AS (SELECT lst, led, rst, red FROM line WHERE sample = 'control'),""" + sweep_sql("x", "x") + "," + sweep_sql("y", "y") + ","
    + collapse_sql("x", "x", "cx") + "," + collapse_sql("y", "y", "cy") + ", both_ AS (SELECT * FROM cx UNION ALL SELECT lst, led, rst, red, -sup FROM cy)," + sweep_sql("both_", "b") + """,
j AS (SELECT b.*, r.root FROM both_ b JOIN nb n ON (n.lst, n.led, n.rst, n.red) = (b.lst, b.led, b.rst, b.red) JOIN rb r ON r.id = n.id)
SELECT min(lst) FILTER (sup > 0) AS lst, max(led) FILTER (sup > 0) AS led, min(rst) FILTER (sup > 0) AS rst, max(red) FILTER (sup > 0) AS red,
  CAST(coalesce(sum(sup) FILTER (sup > 0), 0) AS BIGINT) AS sup, CAST(coalesce(-sum(sup) FILTER (sup < 0), 0) AS BIGINT) AS control_sup FROM j GROUP BY root""", recursive=True)
def contrast_support(spark, d):
    """Case and control support of every joint cluster, before any limit."""
    return an.contrast_support(views.anchors(spark, d, "case"), views.anchors(spark, d, "control"), views.contigs(spark, d))


@query("wn07_paired_events")
def paired_events(spark, d):
    """Plus-strand hanging reads followed by minus-strand hanging reads."""
    hang = views.aln(spark, d).filter("(flag & 13) = 9")
    return paired_event_scan(hang.filter("strand = '+'"), hang.filter("strand = '-'"), ["chrom"], "pos", 250, 2, 2)


@query("ev07_big_deletions", "aln", """
big AS (SELECT sample, chrom, pos + 99 AS s, pos + isize - 100 AS e FROM aln WHERE isize >= 1000 AND mchrom = chrom),
o AS (SELECT *, max(e) OVER (PARTITION BY sample, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM big),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY s, e) AS gid FROM o)
SELECT sample, chrom, max(s) AS start, min(e) AS "end", count(*) AS support, 'DEL' AS svtype, 'bigd' AS method FROM g GROUP BY sample, chrom, gid
HAVING count(*) >= 5 AND max(s) < min(e) AND min(e) - max(s) <= 50000""")
def big_deletions(spark, d):
    from ..operators.calls import call_big_deletions

    pairs = views.aln(spark, d).filter("isize >= 1000 AND mchrom = chrom").selectExpr("sample", "chrom", "pos + 99 AS start", "pos + isize - 100 AS end")
    return call_big_deletions(pairs, ["sample", "chrom"], 5, 50_000)
