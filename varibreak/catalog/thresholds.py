"""Significance thresholds on rates taken from the reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import thresholds as th
from ..operators import tracks
from .registry import query
from .scans import BINS_SQL, coverage_bins

GRID = {"alpha": 0.1, "n": 100_000.0, "w": 100.0, "r": 0.5, "mu": 300.0, "sd_right": 60.0, "sd_left": 60.0, "p_left": 0.05, "p_right": 0.06, "delta": 600.0, "read_length": 100.0}


@query("st09_kappa_bins", "aln", BINS_SQL + """,
k AS (SELECT sample, chrom, bin, sqrt(rm / 1000e0) AS kr FROM rm),
s AS (SELECT min(kr) AS lo, round(greatest(0.01e0, (max(kr) - min(kr)) / 5000e0), 2) AS step FROM k)
SELECT sample, chrom, bin, CAST(ceil((kr - lo) / step) AS BIGINT) AS k, round(lo + ceil((kr - lo) / step) * step, 6) AS kappa FROM k, s""")
def kappa_bins(spark, d):
    smooth = tracks.running_median3(coverage_bins(spark, d), ["sample", "chrom"], "bin", "n", "rm")
    return th.kappa_bins(smooth, "rm", 1000).select("sample", "chrom", "bin", "k", F.round("kappa", 6).alias("kappa"))


@query("st05_bin_threshold_table")
def bin_threshold_table(spark, d):
    smooth = tracks.running_median3(coverage_bins(spark, d), ["sample", "chrom"], "bin", "n", "rm")
    return th.bin_threshold_table(smooth, "rm", 1000, ["sample", "chrom"], **GRID)


@query("st07_scan_thresholds")
def scan_thresholds(spark, d):
    """Thresholds of every scan at each chromosome's mean pair rate."""
    rates = views.aln(spark, d).join(views.contigs(spark, d), "chrom").groupBy("chrom").agg(F.sqrt(F.count("*") / F.first("length")).alias("kappa"))
    keyed = rates.withColumn("k", F.expr("CAST(substring(chrom, 4) AS BIGINT)"))
    solved = th.threshold_grid(keyed, **GRID)
    return keyed.select("chrom", "k").join(solved, "k").select("chrom", "kappa", *th.THRESHOLD_COLUMNS)
