"""Region calls: contrast with a control, priority merging, deduplication, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from .intervals import island_of_points, islands, overlap_reduce, overlapping


def region_difference(case: DataFrame, control: DataFrame, keys: list[str]) -> DataFrame:
    """Case regions that overlap no control region of the same keys (semantics chosen here)."""
    return overlapping(case, control, keys, keep=False)


def first_overlap(left: DataFrame, right: DataFrame, keys: list[str], ident: str, name: str = "first_hit") -> DataFrame:
    """Smallest ``ident`` among the right regions overlapping each left region, and how many there are."""
    return overlap_reduce(left, right, keys, "start", "end", {name: ("min", F.col(ident)), "n_hits": ("sum", F.lit(1))})


def priority_merge(dominant: DataFrame, clipped: DataFrame, big: DataFrame, discordant: DataFrame) -> DataFrame:
    """Dominant regions not confirmed elsewhere, plus the first overlapping region that displaces each of the others.

    A dominant region overlapped by a clip call is dropped; else by a long-insert
    call it is replaced by the first of those; else likewise by a discordant one.
    Regions have ``chrom, start, end, id``.
    """
    marked = first_overlap(dominant, clipped, ["chrom"], "id", "_clip").drop("n_hits")
    marked = first_overlap(marked, big, ["chrom"], "id", "_big").drop("n_hits")
    marked = first_overlap(marked, discordant, ["chrom"], "id", "_disc").drop("n_hits")
    remain = marked.filter("_clip IS NULL AND _big IS NULL AND _disc IS NULL").select(*dominant.columns)
    take = lambda src, col, cond: src.join(marked.filter(cond).select(F.col(col).alias("id")).distinct(), "id", "left_semi").select(*dominant.columns)
    return remain.unionByName(take(big, "_big", "_clip IS NULL AND _big IS NOT NULL")).unionByName(
        take(discordant, "_disc", "_clip IS NULL AND _big IS NULL AND _disc IS NOT NULL")
    )


def method_rank(method: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(m) for m in C.METHOD_PRIORITY]), method)
    return F.when(rank > 0, rank).otherwise(len(C.METHOD_PRIORITY) + 1)


def deduplicate(calls: DataFrame, strict: bool = True) -> DataFrame:
    """Keep the best call of every group of overlapping calls (semantics chosen here).

    Groups are chains of overlapping regions of one chromosome, and with
    ``strict`` of one type.  The best has the highest evidence priority, then the
    smallest start, end and id.  Calls have ``chrom, start, end, svtype, method, id``.
    """
    keys = ["chrom", "svtype"] if strict else ["chrom"]
    cols = [c for c in calls.columns if c not in keys]
    ranked = calls.withColumn("_best", F.struct(method_rank(F.col("method")).alias("rank"), *[F.col(c) for c in ("start", "end", "id")], *[F.col(c) for c in cols if c not in ("start", "end", "id")]))
    merged = islands(ranked, keys, "start", "end", 0, {"_best": ("min", F.col("_best"))})
    return merged.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in cols]).select(*calls.columns)


def accuracy(truth: DataFrame, called: DataFrame, keys: list[str]) -> DataFrame:
    """One row: hit, called, target, precision, recall, f1 (rates cut to three decimals)."""
    hit = overlapping(truth, called, keys)
    count = lambda df, name: df.agg(F.count("*").alias(name))  # one row each
    row = count(hit, "hit").crossJoin(F.broadcast(count(called, "called"))).crossJoin(F.broadcast(count(truth, "target")))
    cut = lambda x: F.floor(x * 1000.0) / 1000.0
    row = row.withColumn("precision", cut(F.try_divide(F.col("hit"), F.col("called")))).withColumn("recall", cut(F.try_divide(F.col("hit"), F.col("target"))))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return row.withColumn("f1", cut(f1))


def type_breakdown(calls: DataFrame) -> DataFrame:
    """Calls per type and method with their share of all calls, in percent."""
    counts = calls.groupBy("svtype", "method").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("svtype", "method", "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def insert_alert(regions: DataFrame, reads: DataFrame, low: int, high: int) -> DataFrame:
    """Flag regions overlapped by a read pair whose insert size lies in ``low..high`` (semantics chosen here)."""
    spans = reads.filter(F.abs("isize").between(low, high) & (F.col("isize") > 0)).select("chrom", F.col("pos").alias("start"), (F.col("pos") + F.col("isize") - 1).alias("end"))
    flagged = overlap_reduce(regions, spans, ["chrom"], "start", "end", {"_n": ("sum", F.lit(1))})
    return flagged.withColumn("alert", F.col("_n").isNotNull()).drop("_n")


def confirm_with_clips(regions: DataFrame, clusters: DataFrame, half_width: int = 500) -> DataFrame:
    """Deletion regions with a right-clip cluster near their start and a left-clip one near their end.

    Confirmed regions take the cluster positions; the others stay imprecise with
    a confidence interval of ``half_width`` on both sides.
    """
    from .intervals import nearest_within

    side = lambda s: clusters.filter(F.col("side") == s).select("chrom", F.col("position").alias("_cp")).distinct()
    near = nearest_within(regions, side("R"), ["chrom"], "start", "_cp", half_width, {"_st": F.col("_cp")}).drop("dist")
    near = nearest_within(near, side("L"), ["chrom"], "end", "_cp", half_width, {"_en": F.col("_cp")}).drop("dist")
    ok = F.col("_st").isNotNull() & F.col("_en").isNotNull()
    return near.select(
        *[c for c in regions.columns if c not in ("start", "end")],
        F.when(ok, F.col("_st")).otherwise(F.col("start")).alias("start"), F.when(ok, F.col("_en")).otherwise(F.col("end")).alias("end"),
        (~ok).alias("imprecise"), F.when(~ok, -half_width).alias("cipos_low"), F.when(~ok, half_width).alias("cipos_high"),
    )


def double_clips(clusters: DataFrame) -> DataFrame:
    """Positions that carry both a left- and a right-clip cluster."""
    side = lambda s: clusters.filter(F.col("side") == s).select("chrom", "position")
    return side("L").intersect(side("R"))


def bin_thresholds(windows: DataFrame, bins: DataFrame, keys: list[str], width: int, origin: int = 1) -> DataFrame:
    """Attach to each window the thresholds of its coverage bin."""
    located = windows.withColumn("bin", F.floor((F.col("t") - origin) / F.lit(float(width))).cast("long"))
    return located.join(bins, [*keys, "bin"], "left")


def override_thresholds(windows: DataFrame, table: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """As :func:`bin_thresholds` for an interval table ``chrom, start, end, <names>`` of disjoint rows."""
    return island_of_points(windows, table, keys, "t", {n: F.col(n) for n in names})


def call_big_deletions(pairs: DataFrame, keys: list[str], min_pairs: int, max_size: int) -> DataFrame:
    """Deletions from chains of overlapping over-long pairs (semantics chosen here).

    ``pairs`` spans the inner distance; the call is the part all pairs share.
    """
    found = islands(pairs, keys, "start", "end", 0, {"_lo": ("max", F.col("start")), "_hi": ("min", F.col("end")), "support": ("sum", F.lit(1))})
    kept = found.filter((F.col("support") >= min_pairs) & (F.col("_lo") < F.col("_hi")) & (F.col("_hi") - F.col("_lo") <= max_size))
    return kept.select(*keys, F.col("_lo").alias("start"), F.col("_hi").alias("end"), "support", F.lit("DEL").alias("svtype"), F.lit("bigd").alias("method"))


def unite(evidence: dict[str, DataFrame]) -> DataFrame:
    """One table of all kinds of evidence with the name of each in ``method``; columns that a kind lacks are NULL."""
    out = None
    for method, found in evidence.items():
        part = found.withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no evidence to unite")
    return out
