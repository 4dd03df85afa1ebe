"""Clusters of read-pair anchors.

An anchor joins two intervals that may lie on different chromosomes and strands.
Both are placed on one line twice the genome's length (forward strand first), so
an anchor is a point of the plane with extent, ``lst..led`` by ``rst..red``.

The sweep visits anchors by their left start; each joins the cluster of the
first still-open anchor (smallest in key order) it overlaps on both intervals,
else it opens a cluster.  That "first overlapping earlier anchor" is a parent
pointer, so clusters are the trees of a forest.  Anchors are visited in key
order ``(lst, led, rst, red)``, which makes equal anchors one weighted node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, small
from .forest import find_roots
from .intervals import tile_of

KEY = ["lst", "led", "rst", "red"]
CELL = 512


def strand_offsets(contigs: DataFrame, order: str = "chrom") -> DataFrame:
    """``chrom, fwd, off``: where each strand of each contig starts on the line.

    ``contigs`` (``chrom, length``) is one row per contig of the reference.
    """
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = contigs.select("chrom", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("_b"), F.sum("length").over(everything).alias("_t"))
    return placed.select("chrom", F.explode(F.array(F.struct(F.lit(True).alias("fwd"), F.col("_b").alias("off")), F.struct(F.lit(False).alias("fwd"), (F.col("_b") + F.col("_t")).alias("off")))).alias("x")).select("chrom", "x.fwd", "x.off")


def to_line(anchors: DataFrame, offsets: DataFrame) -> DataFrame:
    """Anchors (``lfwd, lchr, lst, led, rfwd, rchr, rst, red``) on the line, smaller start left."""
    held = small(offsets)
    off = lambda side: held.select(F.col("chrom").alias(f"{side}chr"), F.col("fwd").alias(f"{side}fwd"), F.col("off").alias(f"_{side}"))
    placed = anchors.join(off("l"), ["lchr", "lfwd"]).join(off("r"), ["rchr", "rfwd"])  # two rows per contig
    one = F.struct((F.col("lst") + F.col("_l")).alias("s"), (F.col("led") + F.col("_l")).alias("e"))
    two = F.struct((F.col("rst") + F.col("_r")).alias("s"), (F.col("red") + F.col("_r")).alias("e"))
    keep = two["s"] >= one["s"]
    low, high = F.when(keep, one).otherwise(two), F.when(keep, two).otherwise(one)
    rest = [c for c in anchors.columns if c not in ("lfwd", "lchr", "lst", "led", "rfwd", "rchr", "rst", "red")]
    return placed.select(*rest, low["s"].alias("lst"), low["e"].alias("led"), high["s"].alias("rst"), high["e"].alias("red"))


STRETCH = 1 << 20


def from_line(clusters: DataFrame, offsets: DataFrame) -> DataFrame:
    """Line coordinates back to strand, chromosome and position.

    A coordinate belongs to the last offset strictly below it.  Every strand of a contig is listed under each stretch
    of a million coordinates that it reaches, so a coordinate meets the few contigs of its own stretch only; past the
    last stretch the last contig goes on.
    """
    after = F.lead("off").over(Window.orderBy("off"))  # two rows per contig
    spans = offsets.select("chrom", "fwd", "off", after.alias("_after"))
    last = F.col("_after").isNull()
    stretches = F.sequence(tile_of(F.col("off") + 1, STRETCH), F.when(last, tile_of(F.col("off") + 1, STRETCH)).otherwise(tile_of(F.col("_after"), STRETCH)))
    listed = small(spans.withColumn("_part", F.explode(stretches)).filter(last | (F.col("_after") > F.col("off"))))
    final = spans.filter(last).select(tile_of(F.col("off") + 1, STRETCH).alias("_end")).first()
    if final is None:
        raise ValueError("no contigs")

    def put(df: DataFrame, start: str, end: str, side: str) -> DataFrame:
        here = listed.select("_part", F.col("off").alias("_off"), "_after", F.col("chrom").alias(f"{side}chr"), F.col("fwd").alias(f"{side}fwd"))
        part = F.least(tile_of(F.col(start), STRETCH), F.lit(final["_end"]))
        held = df.withColumn("_part", part).join(here, "_part", "left").filter(
            (F.col(start) > F.col("_off")) & (F.col("_after").isNull() | (F.col(start) <= F.col("_after"))))
        return held.withColumn(start, F.col(start) - F.col("_off")).withColumn(end, F.col(end) - F.col("_off")).drop("_part", "_off", "_after")

    held = put(put(clusters, "lst", "led", "l"), "rst", "red", "r")
    return held.select(*[c for c in clusters.columns if c not in KEY], "lfwd", "lchr", "lst", "led", "rfwd", "rchr", "rst", "red")


def sweep_events(line: DataFrame, idx: str) -> DataFrame:
    """An "in" at the left start and an "out" at the right end of every anchor."""
    return line.select(F.explode(F.array(
        F.struct(F.col("lst").alias("pos"), F.col(idx).alias("idx"), F.lit(True).alias("is_in")),
        F.struct(F.col("red").alias("pos"), F.col(idx).alias("idx"), F.lit(False).alias("is_in")),
    )).alias("x")).select("x.*")


def both_overlap(a: str, b: str) -> Column:
    """Whether two anchors overlap on both of their intervals."""
    c = lambda t, f: F.col(f"{t}.{f}")
    return (c(a, "led") >= c(b, "lst")) & (c(b, "led") >= c(a, "lst")) & (c(a, "red") >= c(b, "rst")) & (c(b, "red") >= c(a, "rst"))


SMALL_CELL = 64


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``b``, earlier in key order, overlap rows of ``a`` on both ends and are still open."""
    return (b[..., 1] >= a[..., 0]) & (b[..., 0] <= a[..., 1]) & (b[..., 3] >= a[..., 2]) & (b[..., 2] <= a[..., 3]) & (b[..., 3] >= a[..., 0])


def _first_earlier(cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For rows in order of cell and key: the place of the first earlier overlapping row of the cell, or -1.

    All small cells are compared at once, row by row distance; a large one is searched from its first row on, in blocks.
    """
    parent = np.full(len(rows), -1)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (cells[1:] != cells[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(rows)))
    place = np.arange(len(rows)) - np.repeat(starts, sizes)
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    left = np.flatnonzero(small & (place > 0))
    for back in range(1, SMALL_CELL):
        left = left[place[left] >= back]
        if not len(left):
            break
        hit = left[_overlap(rows[left], rows[left - back])]
        parent[hit] = hit - back  # a greater distance is an earlier row
    for start, size in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist()):
        for i in range(start + 1, start + size):
            for lo in range(start, i, 1024):
                hit = _overlap(rows[i], rows[lo : min(lo + 1024, i)])
                if hit.any():
                    parent[i] = lo + int(np.argmax(hit))
                    break
    return parent


def _partners_of_cells(batches):
    """Child and parent keys of rows that come cell by cell; the last cell of a batch waits for the next batch."""
    names = [*KEY, *("p_" + c for c in KEY)]
    held = np.empty((0, 6), dtype=np.int64)

    def found(part):
        parent = _first_earlier(part[:, :2], part[:, 2:])
        kids = np.flatnonzero(parent >= 0)
        both = np.concatenate([part[kids, 2:], part[parent[kids], 2:]], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[:, i]) for i in range(8)], names)

    for batch in batches:
        held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
        last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1)) if len(held) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield found(held[:cut])
            held = held[cut:]
    if len(held):
        yield found(held)


def first_partners(line: DataFrame, cell: int = CELL) -> DataFrame:
    """``node, parent`` for every anchor with an earlier overlapping partner.

    Anchors are spread over the square cells of the plane they touch; two that
    overlap share a cell, so the smallest partner over all cells is the parent.
    A cell holds distinct anchors of its own few hundred bases only; a task goes through all its cells in one call.
    """
    nodes = line.select(*KEY).distinct()
    tiles = lambda s, e: F.sequence(tile_of(F.col(s), cell), tile_of(F.col(e), cell))
    spread = nodes.withColumn("_x", F.explode(tiles("lst", "led"))).withColumn("_y", F.explode(tiles("rst", "red")))
    dealt = spread.select("_x", "_y", *[F.col(c).cast("long").alias(c) for c in KEY]).repartition("_x", "_y").sortWithinPartitions("_x", "_y", *KEY)
    schema = ", ".join(f"{c} long" for c in KEY + ["p_" + c for c in KEY])
    found = dealt.mapInArrow(_partners_of_cells, schema)
    parent = F.struct(*[F.col("p_" + c).alias(c) for c in KEY])
    return found.groupBy(F.struct(*KEY).alias("node")).agg(F.min(parent).alias("parent"))


def sweep_clusters(line: DataFrame, cell: int = CELL) -> DataFrame:
    """Cluster of every distinct anchor: ``lst, led, rst, red, root`` (root = key of the opening anchor)."""
    nodes = line.select(F.struct(*KEY).alias("node")).distinct()
    forest = nodes.join(first_partners(line, cell), "node", "left").select("node", F.coalesce("parent", "node").alias("parent"))
    return find_roots(forest, "node", "parent").select("node.*", "root")


def collapse(line: DataFrame, members: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row per cluster: outer intervals and support."""
    counted = line.groupBy(*KEY).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    return counted.join(members, KEY).groupBy("root").agg(
        F.min("lst").alias("lst"), F.max("led").alias("led"), F.min("rst").alias("rst"), F.max("red").alias("red"), F.sum("_n").alias("sup")
    ).drop("root")


def cluster_anchors(anchors: DataFrame, contigs: DataFrame, cell: int = CELL) -> DataFrame:
    """Clustered anchors in genome coordinates with their support ``sup``."""
    offsets = cut_lineage(strand_offsets(contigs))
    line = cut_lineage(to_line(anchors, offsets))  # read for its keys, their partners and the supports
    return from_line(collapse(line, sweep_clusters(line, cell)), offsets)


def _contrast(case: DataFrame, control: DataFrame, offsets: DataFrame, cell: int) -> DataFrame:
    """Joint clusters on the line: extent of the case part, ``sup`` and ``control_sup``."""
    parts = []
    for sign, anchors in ((1, case), (-1, control)):
        line = cut_lineage(to_line(anchors, offsets))
        parts.append(collapse(line, sweep_clusters(line, cell)).withColumn("sup", F.col("sup") * sign))
    both = cut_lineage(parts[0].unionByName(parts[1]))
    joint = both.join(sweep_clusters(both, cell), KEY)
    mine = F.col("sup") > 0
    pick = lambda agg, c: agg(F.when(mine, F.col(c))).alias(c)
    return joint.groupBy("root").agg(
        pick(F.min, "lst"), pick(F.max, "led"), pick(F.min, "rst"), pick(F.max, "red"),
        F.sum(F.when(mine, F.col("sup")).otherwise(0)).alias("sup"), F.sum(F.when(mine, 0).otherwise(-F.col("sup"))).alias("control_sup"),
    ).drop("root")


def contrast_support(case: DataFrame, control: DataFrame, contigs: DataFrame, cell: int = CELL) -> DataFrame:
    """``lst, led, rst, red, sup, control_sup`` of every joint cluster of case and control anchors, on the line.

    Case and control are clustered apart, then their clusters together; the extent is that of the case part, NULL
    where the case has none.
    """
    return _contrast(case, control, cut_lineage(strand_offsets(contigs)), cell)


def contrast_clusters(case: DataFrame, control: DataFrame, contigs: DataFrame, case_support: int, control_support: int,
                      cell: int = CELL) -> DataFrame:
    """Clusters of case anchors with enough support and too little of it in the control, in genome coordinates.

    A joint cluster (``contrast_support``) is kept when its case support reaches ``case_support`` and the control's
    stays below ``control_support``.
    """
    offsets = cut_lineage(strand_offsets(contigs))
    merged = _contrast(case, control, offsets, cell)
    merged = merged.filter((F.col("sup") > 0) & (F.col("sup") >= case_support) & (F.col("control_sup") < control_support)).drop("control_sup")
    return from_line(merged, offsets)
