"""Change points of case against control reads: binary segmentation of two counting processes.

Given where reads begin, each is one of the case or of the control, and a segment has one rate of case reads (semantics
chosen here).  A split is the place with the largest likelihood ratio; it is kept when that exceeds a penalty times the
logarithm of the contig's reads.  With the running counts of a whole contig at every place, a split's ratio needs the
counts at that place and at the segment's two ends only, so each round is a column over all places and one maximum per
segment: no segment is put together in a task, and tile borders change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..session import cut_lineage, small
from .intervals import TILE, islands, tile_of

PENALTY = 3.0
LEAST_READS = 10


def running_counts(reads: DataFrame, tile: int = TILE) -> DataFrame:
    """``chrom, pos, x, y``: case and control reads that begin at or before each place where one begins.

    ``reads`` has ``chrom, pos, is_case``.  Places are ordered inside tiles; along a contig only tile sums are.
    """
    places = reads.groupBy("chrom", tile_of(F.col("pos"), tile).alias("_t"), "pos").agg(
        F.count_if("is_case").alias("_x"), F.count_if(~F.col("is_case")).alias("_y"))
    places = cut_lineage(places)
    before = Window.partitionBy("chrom").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    sums = places.groupBy("chrom", "_t").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
    base = sums.select("chrom", "_t", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_x", "_y")])
    inside = Window.partitionBy("chrom", "_t").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = places.select("chrom", "_t", "pos", *[F.sum(c).over(inside).alias(c) for c in ("_x", "_y")]).join(base, ["chrom", "_t"])
    return held.select("chrom", "pos", (F.col("_x") + F.col("_b_x")).alias("x"), (F.col("_y") + F.col("_b_y")).alias("y"))


def _log_likelihood(x: Column, y: Column) -> Column:
    term = lambda n: F.when(n > 0, n * F.log(n.cast("double"))).otherwise(0.0)
    return term(x) + term(y) - term(x + y)


def split_ratio(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Likelihood ratio of two rates against one, for running counts at a place and before and at the end of its segment."""
    return 2.0 * (_log_likelihood(x - x0, y - y0) + _log_likelihood(x1 - x, y1 - y) - _log_likelihood(x1 - x0, y1 - y0))


def segments(reads: DataFrame, penalty: float = PENALTY, least: int = LEAST_READS, tile: int = TILE) -> DataFrame:
    """``chrom, start, end, case_reads, control_reads, ratio, stat`` of all segments, between the first and last read.

    ``ratio`` is the segment's case reads over control reads (one added to each) against that of its contig; ``stat``
    the likelihood ratio of the segment's rate against the rest of the contig.  A split leaves ``least`` reads on
    either side; equal ratios take the first place.
    """
    rows = cut_lineage(running_counts(reads, tile).withColumn("low", F.lit(0).cast("long")))
    total = cut_lineage(rows.groupBy("chrom").agg(F.max("x").alias("cx"), F.max("y").alias("cy")))  # one row per contig
    bounds = rows.groupBy("chrom", "low").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    open_ = cut_lineage(bounds.withColumn("x0", F.lit(0).cast("long")).withColumn("y0", F.lit(0).cast("long")))
    done = None
    while True:
        held = rows.join(small(open_.join(total, "chrom")), ["chrom", "low"])
        fits = (F.col("x") + F.col("y") - F.col("x0") - F.col("y0") >= least) & (F.col("x1") + F.col("y1") - F.col("x") - F.col("y") >= least)
        ratio = split_ratio(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
        tried = held.filter(fits).select("chrom", "low", F.struct(F.round(ratio, 9).alias("s"), (-F.col("pos")).alias("p"), "x", "y").alias("b"), (F.lit(penalty) * F.log(F.col("cx") + F.col("cy"))).alias("need"))
        best = tried.groupBy("chrom", "low").agg(F.max("b").alias("b"), F.first("need").alias("need")).filter(F.col("b.s") > F.col("need"))
        best = cut_lineage(best.select("chrom", "low", (-F.col("b.p")).alias("cut"), F.col("b.x").alias("cutx"), F.col("b.y").alias("cuty")))
        whole = open_.join(best.select("chrom", "low"), ["chrom", "low"], "left_anti")
        done = whole if done is None else done.unionByName(whole)
        if not best.limit(1).count():
            break
        right = F.col("pos") > F.col("cut")
        rows = cut_lineage(rows.join(small(best), ["chrom", "low"]).withColumn("low", F.when(right, F.col("cut") + 1).otherwise(F.col("low"))).select("chrom", "pos", "x", "y", "low"))
        ends = rows.groupBy("chrom", "low").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.max("x").alias("x1"), F.max("y").alias("y1"))
        starts = open_.select("chrom", "low", F.col("x0"), F.col("y0")).join(best, ["chrom", "low"])
        starts = starts.select("chrom", F.explode(F.array(F.struct("low", "x0", "y0"), F.struct((F.col("cut") + 1).alias("low"), F.col("cutx").alias("x0"), F.col("cuty").alias("y0")))).alias("s")).select("chrom", "s.*")
        open_ = cut_lineage(ends.join(starts, ["chrom", "low"]).select(*open_.columns))
    x, y = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rest = 2.0 * (_log_likelihood(x, y) + _log_likelihood(F.col("cx") - x, F.col("cy") - y) - _log_likelihood(F.col("cx"), F.col("cy")))
    return done.join(total, "chrom").select(
        "chrom", "start", "end", x.alias("case_reads"), y.alias("control_reads"),
        (((x + 1) / (y + 1)) / ((F.col("cx") + 1) / (F.col("cy") + 1))).alias("ratio"), F.greatest(F.round(rest, 9), F.lit(0.0)).alias("stat"))


def change_point_calls(found: DataFrame, min_stat: float = 0.0, support: int = 1500, gap: int = 1000, expand: int = 2000, good: float = 4.0,
                       del_fold: float = C.DEL_FOLD, dup_fold: float = C.DUP_FOLD) -> DataFrame:
    """``chrom, start, end, svtype, method, score, good`` of segments that gain or lose.

    Segments with ``stat`` of at least ``min_stat`` and a ratio under ``del_fold`` (DEL) or over ``dup_fold`` (DUP) are
    joined across at most ``gap`` bases and kept with ``support`` bases or more.  A call whose ratio is ``good`` times
    away from 1 keeps its ends; any other is widened by ``expand`` bases on both sides, as its ends are less sure.
    """
    kind = F.when(F.col("ratio") < del_fold, "DEL").when(F.col("ratio") > dup_fold, "DUP")
    typed = found.filter(F.col("stat") >= min_stat).withColumn("svtype", kind).filter("svtype IS NOT NULL")
    away = F.when(F.col("ratio") > 1, F.col("ratio")).otherwise(1 / F.col("ratio"))
    merged = islands(typed, ["chrom", "svtype"], "start", "end", gap, {"score": ("max", F.col("stat")), "_away": ("max", away)}, tile=max(TILE, 10 * gap))
    kept = merged.filter(F.col("end") - F.col("start") + 1 >= support).withColumn("good", F.col("_away") >= good)
    wide = F.when(F.col("good"), 0).otherwise(expand)
    return kept.select("chrom", F.greatest(F.col("start") - wide, F.lit(1)).cast("long").alias("start"), (F.col("end") + wide).cast("long").alias("end"), "svtype",
                       F.lit("seqcbs").alias("method"), "score", "good")
