"""Genotypes from assembled contigs aligned back to a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def genotype_regions(regions: DataFrame, alignments: DataFrame, read_length: float, slack_del: float | None = None,
                     slack_ins: float | None = None, low_cover: float = 0.7, high_cover: float = 1.3) -> DataFrame:
    """Genotype each region (``id, svtype, start, end``) from its contig alignments.

    ``alignments`` has ``id, qname, qst, qed, rst, red, qal``; contig names end
    in ``_length_<n>_cov_<x>``.  Only alignments longer than a read count.

    DEL: one contig aligned twice with touching query parts is homozygous; two
    contigs in the order 1-2-1 with touching references are a homozygous
    transposed deletion; three contigs are heterozygous, typed by the middle
    one's coverage.  INS: two touching contigs are homozygous, one is
    heterozygous.  Everything else stays untyped.
    """
    slack_del = read_length / 2 if slack_del is None else slack_del
    slack_ins = read_length if slack_ins is None else slack_ins
    cov = F.round(F.element_at(F.split("qname", "_"), 6).cast("double"))
    one = F.struct(
        F.least("rst", "red").alias("lo"), F.greatest("rst", "red").alias("hi"), F.least("qst", "qed").alias("qlo"),
        F.greatest("qst", "qed").alias("qhi"), F.col("qname").alias("name"), cov.alias("cov"),
    )
    # at most three alignments matter; a fourth already rules every genotype out
    held = alignments.filter(F.col("qal") > read_length).groupBy("id").agg(F.count("*").alias("n"))
    few = held.filter(F.col("n") <= 3).select("id")
    listed = alignments.filter(F.col("qal") > read_length).join(few, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("a"))
    got = regions.join(listed, "id", "left").withColumn("k", F.coalesce(F.size("a"), F.lit(0)))
    got = got.withColumn("names", F.size(F.array_distinct(F.transform("a", lambda x: x["name"]))))
    a = lambda i, f: F.get("a", F.lit(i))[f]
    start = F.col("start")
    near = lambda i, j, slack: F.abs(a(i, "hi") - a(j, "lo")) <= slack
    by_query = F.array_sort(F.transform("a", lambda x: F.struct(x["qlo"].alias("qlo"), x["qhi"].alias("qhi"))))
    query_touch = F.abs(F.get(by_query, F.lit(0))["qhi"] - F.get(by_query, F.lit(1))["qlo"]) <= slack_del
    is_del, is_ins = F.col("svtype") == "DEL", F.col("svtype") == "INS"
    two_hom = is_del & (F.col("k") == 2) & (F.col("names") == 1) & query_touch
    one_two_one = is_del & (F.col("k") == 3) & (F.col("names") == 2) & (a(0, "name") == a(2, "name")) & near(0, 1, slack_del) & near(1, 2, slack_del)
    three = is_del & (F.col("k") == 3) & (F.col("names") == 3) & near(0, 1, slack_del) & near(1, 2, slack_del)
    left, right = F.try_divide(a(1, "cov"), a(0, "cov")), F.try_divide(a(1, "cov"), a(2, "cov"))
    thin, thick = (left < low_cover) & (right < low_cover), (left > high_cover) & (right > high_cover)
    ins_hom = is_ins & (F.col("k") == 2) & (F.col("names") == 2) & near(0, 1, slack_ins)
    ins_het = is_ins & (F.col("k") == 1)
    row = lambda kind, dp, gt, gq, lo, hi: F.struct(kind.alias("type"), dp.cast("int").alias("dp"), F.lit(gt).alias("gt"), F.lit(gq).alias("gq"), lo.cast("long").alias("Lbr"), hi.cast("long").alias("Rbr"))
    mid = F.round((2 * start + a(0, "hi") + a(1, "lo")) / 2.0)
    typed: Column = (
        F.when(two_hom, row(F.lit("DEL"), a(0, "cov"), "1/1", "30", start + a(0, "hi"), start + a(1, "lo")))
        .when(one_two_one, row(F.lit("TRD"), a(0, "cov"), "1/1", "30", start + a(0, "hi"), start + a(2, "lo")))
        .when(three, row(F.when(thin, "DEL").when(thick, "TDD").otherwise("TRD"), a(1, "cov"), "0/1", "30", start + a(0, "hi"), start + a(2, "lo")))
        .when(ins_hom, row(F.lit("INS"), a(0, "cov"), "1/1", "30", mid, mid))
        .when(ins_het, row(F.lit("INS"), a(0, "cov"), "0/1", "20", start, F.col("end")))
        .otherwise(row(F.col("svtype"), F.lit(None), ".", "0", start, F.col("end")))
    )
    return got.withColumn("_t", typed).select(*regions.columns, F.col("_t.type").alias("gtype"), "_t.dp", "_t.gt", "_t.gq", "_t.Lbr", "_t.Rbr")
