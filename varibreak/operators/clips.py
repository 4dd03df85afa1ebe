"""Soft-clip clusters and their consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import BASES, MAX_CLUSTER_MISMATCH, MIN_BASES_PER_CLUSTER, MIN_COLUMN_OBSERVATIONS, MIN_READS_PER_CLUSTER
from ..functions import flags
from ..session import cut_lineage
from ..functions.cigar import deletions, has_clip, insertions, soft_clip


def clipped_reads(aln: DataFrame, keys: list[str]) -> DataFrame:
    """One row per clipped end: ``keys, side, position, nbases, clip``.

    A left clip sits at the first matched base, a right clip at the first
    clipped base.  ``clip`` is the clipped sequence, read from the clip point
    outwards (left clips reversed), so column 1 always touches the breakpoint.
    """
    reads = aln.filter(flags.clip_usable(F.col("flag")) & has_clip(F.col("cigar"))).withColumn("_c", soft_clip(F.col("cigar")))
    n_left, n_right = F.col("_c.n_left"), F.col("_c.n_right")
    left = F.struct(F.lit("L").alias("side"), F.col("pos").cast("long").alias("position"), n_left.alias("nbases"),
                    F.reverse(F.col("seq").substr(F.lit(1), n_left)).alias("clip"))
    right = F.struct(F.lit("R").alias("side"), (F.col("pos") + F.col("_c.to_right")).cast("long").alias("position"), n_right.alias("nbases"),
                     F.expr("right(seq, _c.n_right)").alias("clip"))
    ends = F.filter(F.array(left, right), lambda e: e["nbases"] > 0)
    return reads.select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.side", "_e.position", "_e.nbases", "_e.clip")


def clip_counts(clips: DataFrame, keys: list[str]) -> DataFrame:
    """Reads and bases clipped at every position and side."""
    return clips.groupBy(*keys, "side", "position").agg(F.count("*").alias("nreads"), F.sum("nbases").alias("nbases"))


def consensus(clips: DataFrame, keys: list[str]) -> DataFrame:
    """Column-wise majority sequence and mismatch rate of weighted clips.

    ``clips`` has ``keys, clip, n``.  Ties go to the first of A, C, G, T, N; the
    mismatch rate counts columns seen at least twice.  The sequence comes back in
    clip-point-outwards order.  Identical clips are one weighted row, so deep
    clusters stay small.
    """
    letters = clips.select(*keys, "n", F.posexplode(F.split("clip", "")).alias("_col", "_base")).filter("_base <> ''")
    known = F.col("_base").isin(*BASES[:-1])
    count = lambda b: F.sum(F.when(F.col("_base") == b if b != "N" else ~known, F.col("n")).otherwise(0))
    columns = letters.groupBy(*keys, "_col").agg(*[count(b).alias(b) for b in BASES])
    top = F.greatest(*BASES)
    base: Column = F.lit(BASES[-1])
    for b in reversed(BASES[:-1]):
        base = F.when(F.col(b) == top, F.lit(b)).otherwise(base)
    total = sum((F.col(b) for b in BASES[1:]), F.col(BASES[0]))
    columns = columns.select(*keys, "_col", base.alias("_base"), top.alias("_top"), total.alias("_obs"))
    seen = F.col("_obs") >= MIN_COLUMN_OBSERVATIONS
    # one row per read column: at most a read length of them per cluster
    return columns.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_col", "_base"))), lambda x: x["_base"]), "").alias("consensus"),
        (F.sum(F.when(seen, F.col("_obs") - F.col("_top"))) / F.sum(F.when(seen, F.col("_obs")))).alias("mismatch"),
    )


def clip_clusters(aln: DataFrame, keys: list[str], min_reads: int = MIN_READS_PER_CLUSTER, min_bases: int = MIN_BASES_PER_CLUSTER,
                  max_mismatch: float | None = MAX_CLUSTER_MISMATCH) -> DataFrame:
    """``keys, side, position, nreads, nbases, consensus, mismatch`` of supported clip positions.

    ``keys`` usually are ``sample, chrom``.  ``max_mismatch=None`` keeps clusters
    of any mismatch rate.
    """
    at = [*keys, "side", "position"]
    # equal clips collapse on the map side before anything is shuffled; the result is read
    # twice below and is far smaller than the reads, so the reads are scanned once
    distinct = cut_lineage(clipped_reads(aln, keys).groupBy(*at, "clip").agg(F.count("*").alias("n"), F.sum("nbases").alias("bases")))
    support = distinct.groupBy(*at).agg(F.sum("n").alias("nreads"), F.sum("bases").alias("nbases")).filter(
        (F.col("nreads") >= min_reads) & (F.col("nbases") >= min_bases)
    )
    kept = distinct.join(support.select(*at), at, "left_semi")
    built = support.join(consensus(kept, at), at)
    outward = F.when(F.col("side") == "L", F.reverse("consensus")).otherwise(F.col("consensus"))
    built = built.withColumn("consensus", outward)
    return built if max_mismatch is None else built.filter(F.col("mismatch") < max_mismatch)


def summarize_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        "side", F.col("chrom").alias("Chrom"), F.col("position").alias("Position"), F.col("nreads").alias("nReads"),
        F.col("nbases").alias("nBases"), F.col("mismatch").alias("ProportionMismatch"), F.length("consensus").alias("ConsensusLength"),
    )


def remove_control(case: DataFrame, control: DataFrame) -> DataFrame:
    """Case clusters at positions where the control has no cluster of the same side."""
    at = ["chrom", "side", "position"]
    return case.join(control.select(*at).distinct(), at, "left_anti")


def deletion_counts(aln: DataFrame, keys: list[str]) -> DataFrame:
    """Reads per deleted (position, length)."""
    found = aln.select(*keys, "pos", F.explode(deletions(F.col("cigar"))).alias("_d"))
    return found.groupBy(*keys, (F.col("pos") + F.col("_d.offset")).alias("position"), F.col("_d.length").alias("length")).agg(F.count("*").alias("nreads"))


def insertion_reads(aln: DataFrame, keys: list[str]) -> DataFrame:
    """Every inserted stretch with its bases, which follow the read bases before it (soft clips counted)."""
    found = aln.select(*keys, "pos", "seq", F.explode(insertions(F.col("cigar"))).alias("_i"))
    return found.select(
        *keys, (F.col("pos") + F.col("_i.offset")).alias("position"), F.col("_i.length").alias("length"),
        F.col("seq").substr(F.col("_i.read_offset") + 1, F.col("_i.length")).alias("inserted"),
    )


def insertion_counts(aln: DataFrame, keys: list[str]) -> DataFrame:
    return insertion_reads(aln, keys).groupBy(*keys, "position").agg(F.count("*").alias("nreads"))


def indel_calls(aln: DataFrame, keys: list[str], min_reads: int) -> DataFrame:
    """Small deletions and insertions written in the CIGARs of enough reads (semantics chosen here)."""
    part = lambda found, kind: aln.select(*keys, "pos", F.explode(found).alias("_x")).select(
        *keys, (F.col("pos") + F.col("_x.offset")).alias("start"),
        (F.col("pos") + F.col("_x.offset") + (F.col("_x.length") - 1 if kind == "DEL" else F.lit(0))).alias("end"),
        F.lit(kind).alias("svtype"), F.col("_x.length").alias("length"),
    )
    both = part(deletions(F.col("cigar")), "DEL").unionByName(part(insertions(F.col("cigar")), "INS"))
    counted = both.groupBy(*keys, "start", "end", "svtype", "length").agg(F.count("*").alias("nreads"))
    return counted.filter(F.col("nreads") >= min_reads).select(*keys, "start", "end", "svtype", F.lit("cigar").alias("method"), "nreads")
