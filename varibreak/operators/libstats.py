"""Per-library summary statistics and the insert-size model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import flags
from ..session import cut_lineage, small
from .quantiles import grouped_quantiles

MAX_HISTOGRAM = 1_000_000


def sample_reads(aln: DataFrame, yield_reads: int, keys: list[str]) -> DataFrame:
    """Keep about ``yield_reads`` reads per group, mates together.

    The fraction is ``min(yield / n, 1)`` and a read stays when the hash of its
    name falls below it, so the choice is the same on every run.  Reads are not dealt by group, as a library may be
    half of them; only many groups are joined by a shuffle.
    """
    share = aln.groupBy(*keys).agg((F.least(F.lit(1.0), F.lit(float(yield_reads)) / F.count("*")) * 1_000_000).alias("_cut"))
    bucket = F.conv(F.substring(F.md5("qname"), 1, 8), 16, 10).cast("long") % 1_000_000
    return aln.join(small(share), keys).filter(bucket < F.col("_cut")).drop("_cut")


def index_counts(aln: DataFrame, keys: list[str]) -> DataFrame:
    """Mapped reads per group, as an alignment index reports them."""
    return aln.filter(F.col("flag").bitwiseAND(4) == 0).groupBy(*keys).agg(F.count("*").alias("nreads"))


def read_stats(aln: DataFrame, keys: list[str]) -> DataFrame:
    """Read length, insert size (mean, sd, median, scaled MAD), strand counts and hang/clip rates."""
    reads = aln.filter(flags.usable(F.col("flag")))
    size = F.abs("isize")
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    hang = flags.hanging(F.col("flag"))
    n_plus, n_minus = F.count_if(plus), F.count_if(minus)
    base = reads.groupBy(*keys).agg(
        F.avg("qwidth").alias("rl"), F.avg(size).alias("isize_mean"), F.stddev_samp(size).alias("isize_sd"),
        n_plus.alias("n_plus"), n_minus.alias("n_minus"),
        (F.count_if(hang & plus) / (n_plus + 1)).alias("p_left"),
        (F.count_if(hang & minus) / (n_minus + 1)).alias("p_right"),
        # the reference counts clips on either strand over one strand's reads
        (F.count_if(F.regexp_like("cigar", F.lit("[0-9]+S$"))) / (n_plus + 1)).alias("q_left"),
        (F.count_if(F.regexp_like("cigar", F.lit("^[0-9]+S"))) / (n_minus + 1)).alias("q_right"),
    )
    sizes = cut_lineage(reads.groupBy(*keys, size.alias("size")).agg(F.count("*").alias("n")))
    return base.join(median_and_mad(sizes, keys, "size", "n"), keys)


def median_and_mad(counts: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Median and 1.4826 x median absolute deviation from a value/count table."""
    median = weighted_quantiles(counts, keys, value, weight, {"isize_med": 0.5})
    # one row per group; the group keys are libraries
    dev = counts.join(median, keys).withColumn("_dev", F.abs(F.col(value) - F.col("isize_med")))
    dev = dev.groupBy(*keys, "_dev").agg(F.sum(weight).alias(weight))
    mad = weighted_quantiles(dev, keys, "_dev", weight, {"_mad": 0.5})
    return median.join(mad.select(*keys, (F.col("_mad") * 1.4826).alias("isize_mad")), keys)


def weighted_quantiles(counts: DataFrame, keys: list[str], value: str, weight: str, probs: dict[str, float]) -> DataFrame:
    return grouped_quantiles(counts, keys, F.col(value), probs, weight=F.col(weight))


def mean_coverage(aln: DataFrame, contigs: DataFrame, keys: list[str], by_chrom: bool = False) -> DataFrame:
    """reads x read length / genome length, for the whole genome or per chromosome."""
    length = contigs.select("chrom", F.col("length").alias("_len")) if by_chrom else contigs.agg(F.sum("length").alias("_len"))
    group = [*keys, "chrom"] if by_chrom else list(keys)
    counts = aln.groupBy(*group).agg(
        F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("nreads"),
        F.avg(F.when(flags.usable(F.col("flag")), F.col("qwidth"))).alias("rl"),
    )
    joined = counts.join(length, "chrom") if by_chrom else counts.crossJoin(F.broadcast(length))  # one row
    return joined.select(*group, "nreads", "rl", (F.col("nreads") * F.col("rl") / F.col("_len")).alias("cvg"))


def histogram_modes(values: np.ndarray, counts: np.ndarray, near: int = 100, r_min: float = 0.001, r_dip: float = 0.25):
    """``(value, share)`` of a histogram's modes, by value.

    Values are taken by falling count while they hold at least ``r_min`` of the mass.  One that no taller mode has
    claimed is a mode; it claims the values less than ``near`` away and its hump, the unbroken run of counts of at
    least ``r_dip`` of its own.
    """
    total = counts.sum()
    claimed = np.zeros(len(values), dtype=bool)
    modes = []
    for peak in np.lexsort((values, -counts)):
        if counts[peak] < r_min * total:
            break
        if claimed[peak]:
            continue
        dips = np.flatnonzero(counts < r_dip * counts[peak])
        after = np.searchsorted(dips, peak)
        start = dips[after - 1] + 1 if after else 0
        stop = dips[after] if after < len(dips) else len(values)
        claimed[start:stop] = True
        claimed |= np.abs(values - values[peak]) < near
        modes.append((float(values[peak]), float(counts[peak] / total)))
    return sorted(modes)


def density_modes(values: np.ndarray, counts: np.ndarray, near: float = 20.0, adjust: float = 2.0, points: int = 512):
    """Local maxima of a Gaussian kernel density of the counted values."""
    total = counts.sum()
    mean = np.average(values, weights=counts)
    sd = np.sqrt((counts * (values - mean) ** 2).sum() / (total - 1))
    q1, q3 = (_counted_quantile(values, counts, p) for p in (0.25, 0.75))
    spread = min(sd, (q3 - q1) / 1.34) or sd or abs(values[0]) or 1.0
    width = adjust * 0.9 * spread * total ** -0.2
    grid = np.linspace(values[0] - 3 * width, values[-1] + 3 * width, points)
    height = np.zeros(points)
    for chunk in np.array_split(np.arange(len(values)), max(1, len(values) // 4096)):
        z = (grid[:, None] - values[None, chunk]) / width
        height += (np.exp(-0.5 * z * z) * counts[None, chunk]).sum(axis=1)
    height /= total * width * np.sqrt(2 * np.pi)
    found = []
    for i, x in enumerate(grid):
        others = height[(np.abs(grid - x) < near) & (grid != x)]
        if len(others) and height[i] > others.max():
            found.append((float(np.rint(x)), float(height[i])))
    return found


def _counted_quantile(values: np.ndarray, counts: np.ndarray, p: float) -> float:
    top = np.cumsum(counts)
    rank = (top[-1] - 1) * p
    low, high = (values[np.searchsorted(top, k, side="right")] for k in (np.floor(rank), np.ceil(rank)))
    return float(low + (high - low) * (rank - np.floor(rank)))


def _positive_counts(aln: DataFrame, keys: list[str]) -> DataFrame:
    reads = aln.filter(flags.usable(F.col("flag")) & (F.col("isize") > 0))
    return cut_lineage(reads.groupBy(*keys, F.col("isize").cast("double").alias("v")).agg(F.count("*").alias("n")))


def find_modes(counts: DataFrame, keys: list[str], method: int = 2) -> DataFrame:
    """``keys, mode, height`` of each library's insert sizes.

    Method 2 trims values at ten medians and at six deviations above the median
    before estimating the density, so a library hands its task at most ten
    medians' worth of distinct sizes.
    """
    table = counts
    if method == 2:
        table = _below(table, keys, weighted_quantiles(counts, keys, "v", "n", {"_m": 0.5}).withColumn("_top", F.col("_m") * 10.0))
        spread = table.groupBy(*keys).agg(
            F.sum("n").alias("_c"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("_mean"),
            F.sum(F.col("v") * F.col("v") * F.col("n")).alias("_sq"),
        )
        sd = F.sqrt(F.try_divide(F.col("_sq") - F.col("_c") * F.col("_mean") * F.col("_mean"), F.col("_c") - 1))
        limit = weighted_quantiles(table, keys, "v", "n", {"_m": 0.5}).join(spread, keys)
        table = _below(table, keys, limit.withColumn("_top", F.col("_m") + 6.0 * sd))
    finder = density_modes if method == 2 else histogram_modes

    def modes(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_HISTOGRAM:
            raise ValueError(f"a library has more than {MAX_HISTOGRAM} distinct insert sizes")
        pdf = pdf.sort_values("v")
        found = finder(pdf["v"].to_numpy(float), pdf["n"].to_numpy(float))
        out = pd.DataFrame(found, columns=["mode", "height"])
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "mode", "height"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in keys)
    return table.select(*keys, "v", "n").groupBy(*keys).applyInPandas(modes, f"{schema}, mode double, height double")


def _below(table: DataFrame, keys: list[str], limit: DataFrame) -> DataFrame:
    return table.join(limit.select(*keys, "_top"), keys).filter(F.col("v") < F.col("_top")).drop("_top")


def library_parameters(aln: DataFrame, keys: list[str], method: int = 2) -> DataFrame:
    """Target insert size, one-sided deviations and fitness for insertion/deletion scans.

    The target is the right-most mode at least a fifth as high as the highest.
    Insertions need no left mode of 5% of the target's height and fewer than 5%
    of sizes below ``max(100, target - 2 sdL)``.  Deletions need sizes on both
    sides of the target (semantics chosen here).
    """
    counts = _positive_counts(aln, keys)
    modes = cut_lineage(find_modes(counts, keys, method))
    best = modes.groupBy(*keys).agg(F.max("height").alias("_best"))
    tall = modes.join(best, keys).filter("height >= _best * 0.2")
    target = cut_lineage(tall.groupBy(*keys).agg(F.max("mode").alias("is"), F.max_by("height", "mode").alias("_h")))
    left_mode = modes.join(target, keys).groupBy(*keys).agg(F.max(F.when(F.col("mode") < F.col("is"), F.col("height"))).alias("_left"))
    base = counts.join(target, keys)
    v, n, t = F.col("v"), F.col("n"), F.col("is")
    near = v < t * 10
    total, s1, s2 = (F.sum(F.when(near, x)) for x in (n, v * n, v * v * n))
    top = base.groupBy(*keys).agg((F.first("is") + 10.0 * F.sqrt(F.try_divide(s2 - s1 * s1 / total, total - 1))).alias("_max"))
    base = base.join(top, keys)
    off = (v - t) * (v - t) * n
    right, left = (v > t) & (v < F.col("_max")), v < t
    rms = lambda side: F.sqrt(F.try_divide(F.sum(F.when(side, off)), F.sum(F.when(side, n))))
    sides = cut_lineage(base.groupBy(*keys).agg(rms(right).alias("sdR"), rms(left).alias("sdL")))
    low = base.join(sides, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(left & (v < F.greatest(F.lit(100.0), t - 2.0 * F.col("sdL"))), n)), F.lit(0)).alias("_low"),
        F.sum(F.when(left, n)).alias("_nleft"),
    )
    out = target.join(left_mode, keys).join(sides, keys).join(low, keys)
    insertion = (F.col("_left").isNull() | (F.col("_left") < 0.05 * F.col("_h"))) & (F.col("_low") / (2.0 * F.col("_nleft")) < 0.05)
    return out.select(*keys, "is", "sdR", "sdL", F.coalesce(insertion, F.lit(False)).alias("good_for_insertion"),
                      (F.col("sdR").isNotNull() & F.col("sdL").isNotNull()).alias("good_for_deletion"))


def null_insert_distribution(pairs: DataFrame, keys: list[str], upper: float | None = None, delta: float | None = None) -> DataFrame:
    """Mean and sd of plausible insert lengths, failure rate ``p`` and missing rate ``p_na``.

    ``pairs`` has ``p_start, m_start`` (NULL when unmapped).  Lengths count when
    they lie strictly between -100 and ``delta`` (default five medians).
    """
    sized = pairs.select(*keys, (F.col("m_start") - F.col("p_start")).cast("double").alias("v"))
    counts = cut_lineage(sized.groupBy(*keys, "v").agg(F.count("*").alias("n")))
    known = counts.filter("v IS NOT NULL")
    limits = weighted_quantiles(known, keys, "v", "n", {"_med": 0.5}).select(
        *keys, (F.lit(float(upper)) if upper is not None else F.col("_med") * 10.0).alias("_upper")
    ).withColumn("delta", F.lit(float(delta)) if delta is not None else F.col("_upper") / 2.0)
    v, n = F.col("v"), F.col("n")
    total = F.sum("n")
    clamped = F.greatest(F.least(v, F.col("_upper")), F.lit(-100.0))
    kept = (clamped < F.col("delta")) & (clamped > -100.0)
    joined = counts.join(limits, keys)
    s0, s1, s2 = (F.sum(F.when(kept, x)) for x in (n, clamped * n, clamped * clamped * n))
    return joined.groupBy(*keys).agg(
        F.try_divide(s1, s0).alias("mu"), F.sqrt(F.try_divide(s2 - F.try_divide(s1 * s1, s0), s0 - 1)).alias("sigma"),
        (1.0 - F.coalesce(F.sum(F.when((v < F.col("delta")) & (v > 0), n)), F.lit(0)) / total).alias("p"),
        (F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)) / total).alias("p_na"),
        F.first("delta").alias("delta"),
    )
