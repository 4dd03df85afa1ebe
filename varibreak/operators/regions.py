"""Reads of regions, and the stretches of chromosomes that a command scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import UNMAPPED
from ..functions.cigar import REFERENCE_LENGTH_CLASS, aligned_length
from ..functions.records import is_all_chromosomes
from .intervals import tile_of

WINDOW = 1 << 14


def last_base(pos: Column, cigar: Column, flag: Column) -> Column:
    """The last reference base of a read; an unmapped or unaligned one covers the base it is placed at."""
    length = F.when(flag.bitwiseAND(UNMAPPED) == 0, aligned_length(cigar, REFERENCE_LENGTH_CLASS))
    return pos + F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)) - 1


def reads_in_regions(aln: DataFrame, regions: DataFrame) -> DataFrame:
    """Every read that overlaps a region, once for each: the columns of ``aln`` with ``region_start, region_end``.

    Reads that begin before a region are found by the bases they cover.  Reads and regions meet in the windows of
    16,384 bases they touch, and a pair counts in the first window both touch only.  Equal regions count once.
    """
    asked = regions.select("chrom", F.col("start").alias("region_start"), F.col("end").alias("region_end")).distinct()
    first = lambda c: tile_of(F.col(c) - 1, WINDOW)
    asked = asked.withColumn("_w", F.explode(F.sequence(first("region_start"), first("region_end"))))
    reads = aln.withColumn("_last", last_base(F.col("pos"), F.col("cigar"), F.col("flag"))).filter(F.col("pos") > 0)
    reads = reads.withColumn("_w", F.explode(F.sequence(first("pos"), first("_last"))))
    met = reads.join(asked, ["chrom", "_w"]).filter(
        (F.col("pos") <= F.col("region_end")) & (F.col("_last") >= F.col("region_start")) & (F.col("_w") == F.greatest(first("pos"), first("region_start"))))
    return met.select(*aln.columns, "region_start", "region_end")


def scan_ranges(contigs: DataFrame, names: str, start: int = 1, end: int | None = None, first: int | None = None) -> DataFrame:
    """``chrom, scan_start, scan_end`` of the chromosomes a command goes through.

    "a" or "all" means every contig, or the ``first`` so many in header order (column ``place``); a comma list means
    those contigs; both are scanned whole.  A single name is scanned from ``start`` to ``end``, cut to the contig.
    Names the reference lacks give no rows.
    """
    whole = [F.lit(1).cast("long").alias("scan_start"), F.col("length").cast("long").alias("scan_end")]
    if is_all_chromosomes(names):
        chosen = contigs if first is None else contigs.orderBy("place").limit(first)
        return chosen.select("chrom", *whole)
    asked = [n.strip() for n in names.split(",") if n.strip()]
    chosen = contigs.filter(F.col("chrom").isin(*asked))
    if "," in names:
        return chosen.select("chrom", *whole)
    stop = F.col("length") if end is None else F.least(F.col("length"), F.lit(end))
    return chosen.select("chrom", F.lit(max(1, start)).cast("long").alias("scan_start"), stop.cast("long").alias("scan_end"))
