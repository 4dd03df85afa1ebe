"""Exact order statistics without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

MAX_BUCKETS = 4096


def grouped_quantiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float],
                      weight: Column | None = None) -> DataFrame:
    """Linearly interpolated quantiles (the usual ``1 + (n - 1) p`` rank) per group.

    ``weight`` counts a row several times.  Values are counted first (map-side combined).  Each group's range is cut into
    equal buckets; only the buckets that hold a wanted rank are looked into.
    """
    if not keys:
        return grouped_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, weight).drop("_all")
    counted = df.select(*keys, value.cast("double").alias("_v"), (F.lit(1) if weight is None else weight).alias("_w"))
    counts = counted.filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.sum("_w").alias("_n"))
    # read several times below; the input itself is read once
    counts = cut_lineage(counts)
    span = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"))
    joined = counts.join(span, keys).withColumn(
        "_bucket",
        F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * MAX_BUCKETS), F.lit(MAX_BUCKETS - 1))).otherwise(0),
    )
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    coarse = joined.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_bn")).withColumn("_base", F.coalesce(F.sum("_bn").over(along), F.lit(0)))
    # zero-based ranks floor/ceil of (n - 1) p; a bucket is kept when it holds any of them
    rank = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    wanted = F.array(*[f(r).cast("long") for r in rank.values() for f in (F.floor, F.ceil)])
    coarse = coarse.join(span, keys).filter(
        F.exists(wanted, lambda k: (k >= F.col("_base")) & (k < F.col("_base") + F.col("_bn")))
    ).select(*keys, "_bucket", "_base")
    fine = joined.join(coarse, [*keys, "_bucket"])
    inner = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    fine = fine.withColumn("_top", F.sum("_n").over(inner) + F.col("_base"))
    at = lambda k: F.min(F.when(F.col("_top") > k, F.col("_v")))
    out = []
    for name, r in rank.items():
        low, high = at(F.floor(r)), at(F.ceil(r))
        part = F.max(r - F.floor(r))
        out.append((low + (high - low) * part).alias(name))
    return fine.groupBy(*keys).agg(*out)

