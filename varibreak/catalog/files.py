"""Variant text: parsing, importers and record output.

The lines are spelled from the region view, so they grow with it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..sinks import vcf
from ..sources import callers, tables
from .registry import query

VCF_LINES = """
lines AS (SELECT id, chrom || chr(9) || CAST(start AS VARCHAR) || chr(9) || 'v' || CAST(id AS VARCHAR) || chr(9) || CASE WHEN id % 7 = 0 THEN 'A' ELSE 'NN' END || chr(9)
   || CASE WHEN id % 7 = 0 THEN 'T' WHEN id % 11 = 0 THEN '<MSK>' ELSE '<' || svtype || '>' END || chr(9) || '100' || chr(9) || 'PASS' || chr(9)
   || 'SVTYPE=' || svtype || ';END=' || CAST("end" AS VARCHAR) || ';SVLEN=' || CAST("end" - start AS VARCHAR) || ';CIEND=-5,5;PURITY=0.' || CAST(id % 10 AS VARCHAR) AS value FROM regions)"""


def lines(spark, d):
    return views.regions(spark, d).selectExpr(
        "id", "concat_ws('\\t', chrom, start, concat('v', id), IF(id % 7 = 0, 'A', 'NN'),"
        " CASE WHEN id % 7 = 0 THEN 'T' WHEN id % 11 = 0 THEN '<MSK>' ELSE concat('<', svtype, '>') END, '100', 'PASS',"
        " concat('SVTYPE=', svtype, ';END=', end, ';SVLEN=', end - start, ';CIEND=-5,5;PURITY=0.', id % 10)) AS value",
    )


@query("src15_variant_reader", "regions", """
SELECT chrom, start, "end", "end" - start AS len, 'v' || CAST(id AS VARCHAR) AS id, svtype AS type, CAST('0.' || CAST(id % 10 AS VARCHAR) AS DOUBLE) AS purity FROM regions""")
def variant_reader(spark, d):
    return tables.parse_variants(lines(spark, d))


@query("scf12_info_values", "regions", VCF_LINES + """
SELECT id, regexp_extract(value, ';END=([0-9]+)', 1) AS end_text, CAST(regexp_extract(value, 'PURITY=([0-9.]+)', 1) AS DOUBLE) AS purity FROM lines""")
def info_values(spark, d):
    from ..functions.records import info_value, purity

    info = F.get(F.split("value", "\t"), F.lit(7))
    return lines(spark, d).select("id", info_value(info, "END").alias("end_text"), purity(info).alias("purity"))


@query("snk09_variant_bed", "regions", """
SELECT chrom, start, "end", CASE WHEN id % 7 = 0 THEN 'T' WHEN id % 11 = 0 THEN 'MSK' ELSE svtype END AS type, "end" - start AS size FROM regions""")
def variant_bed(spark, d):
    return tables.variant_bed(lines(spark, d))


@query("flt08_variant_filter", "regions", "SELECT id FROM regions WHERE NOT (id % 7 = 0) AND NOT (id % 11 = 0)")
def variant_filter(spark, d):
    return tables.drop_small_variants(lines(spark, d)).select("id")


@query("flt09_size_bounds", "regions", 'SELECT id FROM regions WHERE "end" - start BETWEEN 10 AND 30')
def size_bounds(spark, d):
    return views.regions(spark, d).filter(callers.size_between(F.col("end") - F.col("start"), 10, 30)).select("id")


@query("src21_variants_by_chromosome", "regions", "SELECT chrom, svtype AS type, count(*) AS n FROM regions WHERE svtype IN ('DEL', 'DUP') GROUP BY chrom, svtype")
def variants_by_chromosome(spark, d):
    return tables.parse_variants(lines(spark, d)).filter(F.col("type").isin("DEL", "DUP")).groupBy("chrom", "type").agg(F.count("*").alias("n"))


def spelled(spark, d, text: str):
    return views.regions(spark, d).selectExpr(f"{text} AS value")


@query("src16_cnvnator", "regions", """
SELECT replace(chrom, 'chr', '') AS chrom, start - 1 AS start, "end" - 1 AS "end", svtype, CAST("end" - start AS VARCHAR) AS size FROM regions""")
def import_cnvnator(spark, d):
    return callers.cnvnator(spelled(spark, d, "concat_ws('\\t', element_at(map('DEL', 'deletion', 'DUP', 'duplication', 'INS', 'insertion', 'INV', 'inversion'), svtype), concat(chrom, ':', start, '-', end), end - start)"))


@query("src16_breakdancer", "regions", """
t AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'CTX' WHEN id % 6 = 0 THEN 'ITX' ELSE svtype END AS k FROM regions)
SELECT chrom, start - 1 AS start, "end" - 1 AS "end", k AS svtype, CAST(score AS VARCHAR) AS size FROM t WHERE k NOT IN ('CTX', 'ITX')
UNION ALL SELECT chrom, start - 1, start, 'INS', CAST(score AS VARCHAR) FROM t WHERE k IN ('CTX', 'ITX')
UNION ALL SELECT CASE WHEN k = 'CTX' THEN 'chr9' ELSE chrom END, "end" - 2, "end" - 1, 'INS', CAST(score AS VARCHAR) FROM t WHERE k IN ('CTX', 'ITX')""")
def import_breakdancer(spark, d):
    return callers.breakdancer(spelled(spark, d, "concat_ws('\\t', chrom, start, '+', IF(id % 5 = 0, 'chr9', chrom), end, '-', CASE WHEN id % 5 = 0 THEN 'CTX' WHEN id % 6 = 0 THEN 'ITX' ELSE svtype END, score)"))


@query("src16_pindel", "regions", """
SELECT chrom, start, "end", svtype, CAST("end" - start AS VARCHAR) AS size FROM regions WHERE "end" - start BETWEEN 10 AND 30""")
def import_pindel(spark, d):
    return callers.pindel(spelled(spark, d, "concat_ws('\\t', id, concat(element_at(map('DEL', 'D', 'DUP', 'TD', 'INS', 'I', 'INV', 'INV'), svtype), ' ', end - start), 'NT', concat('ChrID ', chrom), concat('BP ', start), end)"), low=10, up=30)


@query("src16_delly", "regions", """
t AS (SELECT *, id % 5 = 0 AS tr FROM regions)
SELECT chrom, start - 1 AS start, "end" - 1 AS "end", svtype, CAST("end" AS VARCHAR) AS size FROM t WHERE NOT tr
UNION ALL SELECT chrom, start - 1, start, 'INS', CAST("end" AS VARCHAR) FROM t WHERE tr
UNION ALL SELECT 'chr9', "end" - 2, "end" - 1, 'INS', CAST("end" AS VARCHAR) FROM t WHERE tr""")
def import_delly(spark, d):
    return callers.delly(spelled(spark, d, "concat_ws('\\t', chrom, start, IF(id % 5 = 0, 'chr9', CAST(end AS STRING)), end, '10', '60', concat('>', IF(id % 5 = 0, 'Translocation', element_at(map('DEL', 'Deletion', 'DUP', 'Duplication', 'INS', 'Insertion', 'INV', 'Inversion'), svtype)), '_', id))"))


@query("src16_lumpy", "regions", """
t AS (SELECT *, id % 5 = 0 AS tr FROM regions)
SELECT chrom, start - 1 AS start, "end" - 1 AS "end", svtype, '0' AS size FROM t WHERE NOT tr
UNION ALL SELECT chrom, start - 1, start + 4, 'INS', '0' FROM t WHERE tr
UNION ALL SELECT 'chr9', "end", "end" + 1, 'INS', '0' FROM t WHERE tr""")
def import_lumpy(spark, d):
    return callers.lumpy(spelled(spark, d, "concat_ws('\\t', chrom, start, start + 3, IF(id % 5 = 0, 'chr9', chrom), end, end + 3, id, score, '+', '-', concat('TYPE:', IF(id % 5 = 0, 'INTERCHROM', element_at(map('DEL', 'DELETION', 'DUP', 'DUPLICATION', 'INS', 'INSERTION', 'INV', 'INVERSION'), svtype))))"))


@query("src16_own_bed", "regions", """
SELECT chrom, CASE WHEN svtype = 'INS' THEN start - 11 ELSE start - 1 END AS start,
  CASE WHEN svtype IN ('DEL', 'INV') THEN start - 1 + ("end" - start) ELSE CASE WHEN svtype = 'INS' THEN start - 1 ELSE start END END AS "end", svtype,
  CASE WHEN svtype IN ('DEL', 'INV') THEN CAST("end" - start AS VARCHAR) WHEN svtype = 'DUP' THEN '2' ELSE '20' END AS size FROM regions""")
def import_own_bed(spark, d):
    return callers.own_bed(spelled(spark, d, "concat_ws('\\t', chrom, start, end, id, 'N', svtype, '100', 'PASS', concat('A=1;B=2;C=3;D=4;SVLEN=', end - start))"), pad=10)


@query("src16_lumpy_vcf", "regions", """
SELECT chrom, CASE WHEN svtype = 'INS' THEN start - 11 ELSE start - 1 END AS start,
  CASE WHEN svtype IN ('DEL', 'INV') THEN start - 1 + ("end" - start) WHEN svtype = 'INS' THEN start - 1 ELSE start END AS "end",
  CASE WHEN svtype = 'INS' THEN 'UNK' WHEN svtype = 'DUP' THEN 'OTH' ELSE svtype END AS svtype,
  CASE WHEN svtype IN ('DEL', 'INV') THEN CAST("end" - start AS VARCHAR) WHEN svtype = 'INS' THEN '20' ELSE '0' END AS size FROM regions""")
def import_lumpy_vcf(spark, d):
    return callers.lumpy_vcf(spelled(spark, d, "concat_ws('\\t', chrom, start, id, 'N', '<X>', '.', '.', concat('SVTYPE=', IF(svtype = 'INS', 'BND', svtype), ';STRANDS=+-;SVLEN=', IF(svtype = 'DEL', start - end, end - start)))"), pad=10)


@query("src16_manta_vcf", "regions", """
SELECT chrom, CASE WHEN svtype = 'INS' THEN start - 11 ELSE start - 1 END AS start,
  CASE WHEN svtype <> 'INS' THEN start - 1 + ("end" - start) ELSE start - 1 END AS "end", svtype,
  CASE WHEN svtype <> 'INS' THEN CAST("end" - start AS VARCHAR) ELSE '20' END AS size FROM regions""")
def import_manta_vcf(spark, d):
    return callers.manta_vcf(spelled(spark, d, "concat_ws('\\t', chrom, start, id, 'N', '<X>', '.', '.', concat('END=', end, ';SVLEN=', IF(svtype = 'DEL', start - end, end - start), ';IMPRECISE;SVTYPE=', svtype))"), pad=10)


@query("snk04_call_records", "regions", """
SELECT chrom AS "CHROM", start AS "POS", CAST(id AS VARCHAR) AS "ID", '.' AS "REF", '<' || svtype || '>' AS "ALT", '100' AS "QUAL", 'PASS' AS "FILTER",
  CASE WHEN id % 2 = 0 THEN 'IMPRECISE;' ELSE '' END || 'SVTYPE=' || svtype || ';END=' || CAST("end" AS VARCHAR) || ';SVLEN=' || CAST("end" - start AS VARCHAR) || ';SOMATIC' AS "INFO" FROM regions""")
def call_records(spark, d):
    return vcf.call_records(views.regions(spark, d).select("id", "chrom", "start", "end", "svtype", (F.col("id") % 2 == 0).alias("imprecise")))


@query("snk08_variant_names", "regions", """
r AS (SELECT *, 'SVTYPE=' || svtype || ';END=' || CAST("end" AS VARCHAR) || ';SVLEN=' || CAST("end" - start AS VARCHAR) || ';SOMATIC' AS info FROM regions),
n AS (SELECT *, row_number() OVER (ORDER BY chrom, start, CAST(id AS VARCHAR), svtype, info) AS i FROM r)
SELECT chrom AS "CHROM", start AS "POS", 'case.' || chrom || '.' || CAST(i AS VARCHAR) || '.<' || svtype || '>.' || CAST(id AS VARCHAR) AS "ID" FROM n""")
def variant_names(spark, d):
    rows = vcf.call_records(views.regions(spark, d).select("id", "chrom", "start", "end", "svtype"))
    return vcf.name_records(rows, "case").select("CHROM", "POS", "ID")


@query("snk10_type_split", "regions", """
SELECT CASE svtype WHEN 'DEL' THEN 'del' WHEN 'DUP' THEN 'dup' WHEN 'INS' THEN 'ins' WHEN 'INV' THEN 'inv' ELSE 'oth' END AS kind, count(*) AS n FROM regions GROUP BY 1""")
def type_split(spark, d):
    return views.regions(spark, d).groupBy(vcf.type_folder(F.col("svtype")).alias("kind")).agg(F.count("*").alias("n"))
