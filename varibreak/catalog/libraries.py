"""Library statistics, mates and plain aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import views
from ..functions import cigar, moments
from ..functions.discrete import min_insertion_reads
from ..operators import libstats, mates
from ..operators.quantiles import grouped_quantiles
from .registry import query
from .shared import PAIRS_SQL

KEYS = ["sample", "lib"]


@query("ag01_library_stats", "aln", """
r AS (SELECT *, abs(isize) AS sz FROM aln WHERE (flag & 1536) = 0),
m AS (SELECT sample, lib, quantile_cont(sz, 0.5) AS med FROM r GROUP BY ALL),
dv AS (SELECT r.sample, r.lib, quantile_cont(abs(sz - med), 0.5) AS mad FROM r JOIN m USING (sample, lib) GROUP BY ALL)
SELECT r.sample, r.lib, round(avg(qwidth), 6) AS rl, round(avg(sz), 6) AS isize_mean, round(stddev_samp(sz), 6) AS isize_sd,
  round(any_value(med), 6) AS isize_med, round(any_value(mad) * 1.4826e0, 6) AS isize_mad,
  count(*) FILTER (strand = '+') AS n_plus, count(*) FILTER (strand = '-') AS n_minus
FROM r JOIN m USING (sample, lib) JOIN dv USING (sample, lib) GROUP BY r.sample, r.lib""")
def library_stats(spark, d):
    s = libstats.read_stats(views.aln(spark, d), KEYS)
    return s.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("rl", "isize_mean", "isize_sd", "isize_med", "isize_mad")], "n_plus", "n_minus")


@query("ag02_hang_clip_rates", "aln", """
SELECT sample, lib,
  round(count(*) FILTER ((flag & 13) = 9 AND strand = '+') / (count(*) FILTER (strand = '+') + 1e0), 6) AS p_left,
  round(count(*) FILTER ((flag & 13) = 9 AND strand = '-') / (count(*) FILTER (strand = '-') + 1e0), 6) AS p_right,
  round(count(*) FILTER (regexp_matches(cigar, '[0-9]+S$')) / (count(*) FILTER (strand = '+') + 1e0), 6) AS q_left,
  round(count(*) FILTER (regexp_matches(cigar, '^[0-9]+S')) / (count(*) FILTER (strand = '-') + 1e0), 6) AS q_right
FROM aln WHERE (flag & 1536) = 0 GROUP BY sample, lib""")
def hang_clip_rates(spark, d):
    s = libstats.read_stats(views.aln(spark, d), KEYS)
    return s.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("p_left", "p_right", "q_left", "q_right")])


@query("ag03_mean_coverage", "aln contigs", """
SELECT sample, lib, count(*) FILTER ((flag & 4) = 0) AS nreads,
  round(count(*) FILTER ((flag & 4) = 0) * avg(qwidth) FILTER ((flag & 1536) = 0) / (SELECT sum(length) FROM contigs), 6) AS cvg
FROM aln GROUP BY sample, lib""")
def mean_coverage(spark, d):
    s = libstats.mean_coverage(views.aln(spark, d), views.contigs(spark, d), KEYS)
    return s.select(*KEYS, "nreads", F.round("cvg", 6).alias("cvg"))


@query("ag03_chromosome_coverage", "aln contigs", """
SELECT sample, chrom, count(*) FILTER ((flag & 4) = 0) AS nreads,
  round(count(*) FILTER ((flag & 4) = 0) * avg(qwidth) FILTER ((flag & 1536) = 0) / any_value(length), 6) AS cvg
FROM aln JOIN contigs USING (chrom) GROUP BY sample, chrom""")
def chromosome_coverage(spark, d):
    s = libstats.mean_coverage(views.aln(spark, d), views.contigs(spark, d), ["sample"], by_chrom=True)
    return s.select("sample", "chrom", "nreads", F.round("cvg", 6).alias("cvg"))


@query("ag11_pair_accumulate", "aln", "SELECT chrom, mchrom, CAST(sum(abs(isize)) AS BIGINT) AS total FROM aln GROUP BY chrom, mchrom")
def pair_accumulate(spark, d):
    return views.aln(spark, d).groupBy("chrom", "mchrom").agg(F.sum(F.abs("isize")).cast("long").alias("total"))


@query("ag17_grid_count", "aln", """
SELECT sample, chrom, CASE WHEN (pos - 1) // 500 < 100 THEN (pos - 1) // 500 ELSE -1 END AS cell, count(*) AS n FROM aln GROUP BY ALL""")
def grid_count(spark, d):
    """Reads per 500-base cell of the first hundred cells; the rest is out of range."""
    cell = F.floor((F.col("pos") - 1) / 500.0)
    return views.aln(spark, d).groupBy("sample", "chrom", F.when(cell < 100, cell).otherwise(-1).alias("cell")).agg(F.count("*").alias("n"))


@query("ag19_shape", "aln", """
v AS (SELECT lib, CAST(abs(isize) AS DOUBLE) AS x FROM aln),
m AS (SELECT lib, avg(x) AS mu, stddev_samp(x) AS sd, count(*) AS n FROM v GROUP BY lib)
SELECT v.lib, round(sum(pow(x - mu, 4)) / any_value(n) / pow(any_value(sd), 4) - 3, 6) AS kurtosis,
  round(sum(pow(x - mu, 3)) / any_value(n) / pow(any_value(sd), 3), 6) AS skewness
FROM v JOIN m USING (lib) GROUP BY v.lib""")
def shape(spark, d):
    size = F.abs("isize").cast("double")
    return views.aln(spark, d).groupBy("lib").agg(F.round(moments.excess_kurtosis(size), 6).alias("kurtosis"), F.round(moments.sample_skewness(size), 6).alias("skewness"))


@query("ag19_entropy", "aln", """
c AS (SELECT lib, cigar, count(*) AS n FROM aln GROUP BY ALL), t AS (SELECT lib, sum(n) AS total FROM c GROUP BY lib)
SELECT c.lib, round(-sum(n / total * ln(n / total)), 6) AS entropy FROM c JOIN t USING (lib) GROUP BY c.lib""")
def entropy(spark, d):
    counts = views.aln(spark, d).groupBy("lib", "cigar").agg(F.count("*").alias("n"))
    total = counts.groupBy("lib").agg(F.sum("n").alias("total"))
    return counts.join(total, "lib").groupBy("lib").agg(F.round(F.sum(moments.entropy_term(F.col("n") / F.col("total"))), 6).alias("entropy"))


@query("ag20_quantiles", "aln", """
SELECT sample, round(quantile_cont(isize, 0.1), 6) AS q10, round(quantile_cont(isize, 0.5), 6) AS q50, round(quantile_cont(isize, 0.75), 6) AS q75 FROM aln GROUP BY sample""")
def quantiles(spark, d):
    q = grouped_quantiles(views.aln(spark, d), ["sample"], F.col("isize"), {"q10": 0.1, "q50": 0.5, "q75": 0.75})
    return q.select("sample", *[F.round(c, 6).alias(c) for c in ("q10", "q50", "q75")])


@query("jn07_map_positions", "aln", PAIRS_SQL + "\nSELECT chrom, qname, p_start, m_start, discordant FROM pairs")
def map_positions(spark, d):
    return mates.map_positions(views.aln(spark, d), ["rid"])


@query("ag24_null_inserts", "aln", PAIRS_SQL + """,
il AS (SELECT chrom, CAST(m_start - p_start AS DOUBLE) AS v FROM pairs),
md AS (SELECT chrom, quantile_cont(v, 0.5) * 10 AS up FROM il GROUP BY chrom),
cl AS (SELECT il.chrom, v, up, up / 2 AS delta, greatest(least(v, up), -100e0) AS c FROM il JOIN md USING (chrom))
SELECT chrom, round(avg(c) FILTER (c < delta AND c > -100), 6) AS mu, round(stddev_samp(c) FILTER (c < delta AND c > -100), 6) AS sigma,
  round(1e0 - count(*) FILTER (v < delta AND v > 0) / CAST(count(*) AS DOUBLE), 6) AS p, round(count(*) FILTER (v IS NULL) / CAST(count(*) AS DOUBLE), 6) AS p_na FROM cl GROUP BY chrom""")
def null_inserts(spark, d):
    pairs = mates.map_positions(views.aln(spark, d), ["rid"])
    s = libstats.null_insert_distribution(pairs, ["chrom"])
    return s.select("chrom", *[F.round(c, 6).alias(c) for c in ("mu", "sigma", "p", "p_na")])


@query("ag25_density_modes")
def density_modes(spark, d):
    return libstats.find_modes(libstats._positive_counts(views.aln(spark, d), KEYS), KEYS)


@query("ag25_histogram_modes")
def histogram_modes(spark, d):
    return libstats.find_modes(libstats._positive_counts(views.aln(spark, d), KEYS), KEYS, method=1)


@query("ag26_library_parameters")
def library_parameters(spark, d):
    return libstats.library_parameters(views.aln(spark, d), KEYS)


_MATES = """
own AS (SELECT DISTINCT ON (qname) qname, rid, cigar, isize FROM aln WHERE (flag & 13) = 9 AND strand = '+' ORDER BY qname, rid DESC),
num AS (SELECT qname, rid, cigar, isize,
  CAST(coalesce(nullif(regexp_extract(cigar, '^([0-9]+)S', 1), ''), '0') AS INT) AS head,
  CAST(coalesce(nullif(regexp_extract(cigar, '([0-9]+)S$', 1), ''), '0') AS INT) AS tail FROM aln WHERE strand = '-')"""


@query("jn06_mate_join", "aln", _MATES + """
SELECT num.qname, own.rid AS self_rid, num.rid AS mate_rid FROM num JOIN own USING (qname)""")
def mate_join(spark, d):
    reads = views.aln(spark, d)
    first = reads.filter("(flag & 13) = 9 AND strand = '+'")
    return mates.join_mates(first, reads.filter("strand = '-'"), "rid")


@query("scf15_imputed_isize", "aln", _MATES + """
SELECT num.qname, own.rid AS self_rid, num.rid AS mate_rid,
  own.isize + CAST(coalesce(nullif(regexp_extract(own.cigar, '^([0-9]+)S', 1), ''), '0') AS INT) + num.tail AS impute_isize
FROM num JOIN own USING (qname)""")
def imputed_isize(spark, d):
    reads = views.aln(spark, d)
    first = reads.filter("(flag & 13) = 9 AND strand = '+'")
    return mates.join_mates(first, reads.filter("strand = '-'"), "rid", left=True, self_side=True)


@query("scf19_min_insertion_reads")
def min_reads(spark, d):
    cvg = libstats.mean_coverage(views.aln(spark, d), views.contigs(spark, d), ["sample"], by_chrom=True)

    @F.pandas_udf("int")
    def needed(c: pd.Series) -> pd.Series:
        return c.map(min_insertion_reads)

    return cvg.select("sample", "chrom", needed("cvg").alias("min_reads"))


@query("ag22_type_breakdown", "regions", """
SELECT svtype, method, count(*) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM regions), 6) AS pct FROM regions GROUP BY svtype, method""")
def type_breakdown(spark, d):
    from ..operators.calls import type_breakdown as breakdown

    return breakdown(views.regions(spark, d)).withColumn("pct", F.round(F.col("pct").cast("double"), 6))
