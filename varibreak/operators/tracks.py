"""Boolean and numeric tracks on the window grid: rules, smoothing, regions, thresholds."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..session import cut_lineage
from .intervals import islands
from .libstats import median_and_mad


def rule_column(rule: str, flags: dict[str, Column]) -> Column:
    """``a+b,c``: ``+`` joins with AND inside a rule, ``,`` joins rules with OR."""
    terms = [reduce(lambda a, b: a & b, [flags[t] for t in part.split("+")]) for part in rule.split(",")]
    return reduce(lambda a, b: a | b, terms)


def merge_column(text: str, files: list[Column]) -> Column:
    """``+1+2-3``: in any of the plus files and in none of the minus files."""
    import re

    plus = [files[int(n) - 1] for n in re.findall(r"\+([0-9]+)", text)]
    minus = [files[int(n) - 1] for n in re.findall(r"-([0-9]+)", text)]
    value = reduce(lambda a, b: a | b, plus) if plus else F.lit(True)
    return value & ~reduce(lambda a, b: a | b, minus) if minus else value


def smooth_runs(passing: DataFrame, keys: list[str], window: str, gap: int, support: int) -> DataFrame:
    """Regions of passing windows in window indices: ``keys, start, end``.

    Stretches without a pass of at most ``gap`` windows are filled first, then
    stretches of at most ``support`` windows are dropped.
    """
    found = islands(passing, keys, window, window, gap + 1, tile=max(10_000, 10 * (gap + 1)))
    return found.filter(F.col("end") - F.col("start") + 1 > support)


def to_regions(runs: DataFrame, keys: list[str], origin: int, step: int) -> DataFrame:
    return runs.select(*keys, (F.col("start") * step + origin).alias("start"), (F.col("end") * step + origin).alias("end"))


def call_track(track: DataFrame, keys: list[str], score: str, threshold: Column, step: int, origin: int, gap: int, support: int,
               svtype: str, method: str) -> DataFrame:
    """Regions of one score track as calls (semantics chosen here).

    ``gap`` and ``support`` are in bases; a region's score is its best window.
    """
    passing = track.filter(F.col(score) >= threshold).withColumn("_i", ((F.col("t") - origin) / F.lit(step)).cast("long"))
    best = {"score": ("max", F.col(score))}
    found = islands(passing, keys, "_i", "_i", gap // step + 1, best, tile=max(10_000, 10 * (gap // step + 1)))
    kept = found.filter(F.col("end") - F.col("start") + 1 > support // step)
    return kept.select(*keys, (F.col("start") * step + origin).alias("start"), (F.col("end") * step + origin + step - 1).alias("end"),
                       F.lit(svtype).alias("svtype"), F.lit(method).alias("method"), "score")


def coverage_bins(reads: DataFrame, keys: list[str], width: int = C.COVERAGE_BIN, origin: int = 1) -> DataFrame:
    """Reads (``start, end``) overlapping each bin; bins without reads between others are zero."""
    touched = reads.groupBy(*keys, "start", "end").agg(F.count("*").alias("_n"))
    index = lambda c: F.floor((F.col(c) - origin) / F.lit(float(width))).cast("long")
    counts = touched.withColumn("bin", F.explode(F.sequence(index("start"), index("end")))).groupBy(*keys, "bin").agg(F.sum("_n").alias("n"))
    span = counts.groupBy(*keys).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("bin"))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def running_median3(bins: DataFrame, keys: list[str], index: str, value: str, name: str) -> DataFrame:
    """Median of each bin and its neighbours; an end bin takes the median of itself, its
    neighbour and the line through the next two smoothed values (the usual end rule)."""
    shift = lambda by, col: bins.select(*keys, (F.col(index) + by).alias(index), F.col(value).alias(col))
    near = bins
    for by, col in ((1, "_p1"), (-1, "_n1"), (2, "_p2"), (-2, "_n2"), (3, "_p3"), (-3, "_n3")):
        near = near.join(shift(by, col), [*keys, index], "left")
    med = lambda a, b, c: F.element_at(F.array_sort(F.array(a, b, c)), 2)
    v = F.col(value)
    c = F.col
    inner = med(c("_p1"), v, c("_n1"))
    def edge(one, two, three):
        second = F.when(two.isNotNull(), med(v, one, two)).otherwise(one)
        third = F.when(three.isNotNull(), med(one, two, three)).otherwise(two)
        return F.when(two.isNull(), v).otherwise(med(v, second, 3 * second - 2 * third))
    out = F.when(c("_p1").isNotNull() & c("_n1").isNotNull(), inner).when(c("_p1").isNull() & c("_n1").isNull(), v).when(
        c("_p1").isNull(), edge(c("_n1"), c("_n2"), c("_n3"))
    ).otherwise(edge(c("_p1"), c("_p2"), c("_p3")))
    return near.select(*bins.columns, out.alias(name))


def call_coverage(bins: DataFrame, keys: list[str], value: str, mean: Column, width: int, origin: int = 1, gap: int = 0,
                  support: int = 0) -> DataFrame:
    """DEL where binned depth falls under 0.9 of the mean, DUP where it exceeds 1.1 (semantics chosen here)."""
    ratio = F.col(value) / mean
    typed = bins.withColumn("svtype", F.when(ratio < C.MAX_DEL_RATIO, "DEL").when(ratio > C.MIN_DUP_RATIO, "DUP")).filter("svtype IS NOT NULL")
    runs = smooth_runs(typed, [*keys, "svtype"], "bin", gap, support)
    return runs.select(*keys, (F.col("start") * width + origin).alias("start"), (F.col("end") * width + origin + width - 1).alias("end"),
                       "svtype", F.lit("cvg").alias("method"))


def relative_type(case_reads: Column, control_reads: Column) -> Column:
    """Copy-number type of a region from its read counts."""
    ratio = F.try_divide(case_reads.cast("double"), control_reads.cast("double"))
    return F.when(ratio > C.DUP_FOLD, "DUP").when(ratio < C.DEL_FOLD, "DEL").otherwise("INS")


def robust_threshold(track: DataFrame, keys: list[str], score: str, level: float, windows: Column | None = None) -> DataFrame:
    """median + level x scaled MAD of a track (semantics chosen here); ``windows`` is the number a row stands for, one if not given."""
    counts = track.groupBy(*keys, F.col(score).alias("v")).agg(F.sum(F.lit(1) if windows is None else windows).alias("n"))
    # read for the median and again for the deviations
    stats = median_and_mad(cut_lineage(counts), keys, "v", "n")
    return stats.select(*keys, (F.col("isize_med") + F.lit(float(level)) * F.col("isize_mad")).alias("threshold"))


def block_threshold(track: DataFrame, keys: list[str], score: str, step: int, block: int, alpha: float) -> DataFrame:
    """The 1 - alpha quantile of maxima over non-overlapping blocks (semantics chosen here)."""
    from .quantiles import grouped_quantiles

    tops = track.groupBy(*keys, F.floor(F.col("t") / F.lit(float(block * step))).alias("_b")).agg(F.max(score).alias("_m"))
    return grouped_quantiles(tops, keys, F.col("_m"), {"threshold": 1.0 - alpha})


def window_max(track: DataFrame, keys: list[str], score: str, width: int) -> DataFrame:
    """Best window of every ``width``-base bin: ``keys, bin, top, at``."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col("t")).alias("n")))
    return track.groupBy(*keys, F.floor(F.col("t") / F.lit(float(width))).alias("bin")).agg(best.alias("_b")).select(
        *keys, "bin", F.col("_b.s").alias("top"), (-F.col("_b.n")).alias("at")
    )


def level_alpha(level: float) -> float:
    """The error rate that a threshold level stands for: ``10 ** -level`` (semantics chosen here)."""
    return 10.0 ** -level


def bootstrap_threshold(track: DataFrame, keys: list[str], score: str, step: int, buffer: int, alpha: float, resample: int = 200, seed: int = 42) -> DataFrame:
    """``keys, threshold, mean, sd``: the ``1 - alpha`` quantile of window maxima, averaged over resamples (semantics chosen here).

    The grid is cut into blocks of ``buffer`` windows and every second one gives its maximum, so that maxima lie
    ``buffer`` windows apart.  A resample takes each maximum as often as a Poisson draw of mean one says, which depends
    on the seed, the block and the number of the resample only: reruns and other partitions draw the same.  ``mean`` and
    ``sd`` describe the maxima.  A resample that draws nothing gives no quantile.
    """
    from .quantiles import grouped_quantiles

    block = F.floor(F.col("t") / F.lit(float(buffer * step))).cast("long")
    tops = track.withColumn("_b", block).filter(F.col("_b") % 2 == 0).groupBy(*keys, "_b").agg(F.max(score).alias("_m"))
    tops = cut_lineage(tops)
    drawn = tops.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(resample))))
    share = F.pmod(F.xxhash64(F.lit(seed), "_r", "_b", *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))
    # times a Poisson variable of mean one exceeds the share: 1 - share below each tail
    tails = [1.0 - math.exp(-1.0) * sum(1.0 / math.factorial(i) for i in range(k)) for k in range(1, 12)]
    times = sum((F.when(share < t, 1).otherwise(0) for t in tails[1:]), F.when(share < tails[0], 1).otherwise(0))
    counted = drawn.withColumn("_w", times).filter("_w > 0").groupBy(*keys, "_r", "_m").agg(F.sum("_w").alias("_w"))
    each = grouped_quantiles(counted, [*keys, "_r"], F.col("_m"), {"q": 1.0 - alpha}, F.col("_w"))
    # averages of whole numbers do not depend on the order in which values arrive
    average = lambda c: F.avg(F.round(F.col(c) * 1e9).cast("long")) / 1e9
    found = each.groupBy(*keys).agg(average("q").alias("threshold"))
    return found.join(tops.groupBy(*keys).agg(average("_m").alias("mean"), F.round(F.stddev_samp("_m"), 9).alias("sd")), keys)
