"""Breakend tables: ordering, filters, adjacency and event types.

A breakend row is ``chr1, pos1, goRight1, chr2, pos2, goRight2, cid, mcid``;
``goRight`` is true when the retained sequence lies to the right of the position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..session import cut_lineage
from .intervals import TILE, count_overlaps, distance_to, island_of_points, islands, nearest_within, tile_of
from .quantiles import grouped_quantiles

COLUMNS = ["chr1", "pos1", "goRight1", "chr2", "pos2", "goRight2", "cid", "mcid"]


def increasing(chr1: Column, pos1: Column, chr2: Column, pos2: Column) -> Column:
    """Whether (chr1, pos1) precedes (chr2, pos2); chromosome names compare as text."""
    return F.when(chr1 == chr2, pos2 > pos1).otherwise(chr2 > chr1)


def canonical(bnd: DataFrame) -> DataFrame:
    """Swap ends where needed so the first end precedes the second."""
    keep = increasing(F.col("chr1"), F.col("pos1"), F.col("chr2"), F.col("pos2"))
    swap = {"chr1": "chr2", "pos1": "pos2", "goRight1": "goRight2", "cid": "mcid"}
    swap.update({b: a for a, b in list(swap.items())})
    return bnd.select(*[F.when(keep, F.col(c)).otherwise(F.col(swap[c])).alias(c) if c in swap else F.col(c) for c in bnd.columns])


def on_chromosomes(bnd: DataFrame, names: list[str]) -> DataFrame:
    """Rows with either end on one of the named chromosomes."""
    return bnd.filter(F.col("chr1").isin(*names) | F.col("chr2").isin(*names))


def hotspots(df: DataFrame, keys: list[str], pos: str, distance: int, size: int) -> DataFrame:
    """Flag rows in runs of densely spaced rows, column ``hot``.

    A run is a maximal chain of rows, each less than ``distance`` after the one
    before; it is hot when it has more than ``size + 2`` rows.
    """
    runs = islands(df, keys, pos, pos, distance - 1, {"n": ("sum", F.lit(1))}, tile=max(TILE, 10 * distance))
    hot = runs.filter(F.col("n") > size + 2)
    marked = island_of_points(df, hot, keys, pos, {"_n": F.col("n")}, tile=max(TILE, 10 * distance))
    return marked.withColumn("hot", F.col("_n").isNotNull()).drop("_n")


def drop_near_duplicates(bnd: DataFrame, distance: int) -> DataFrame:
    """Drop rows with an earlier row of the same orientation within ``distance`` at both ends.

    Earlier rows count whether or not they are kept themselves.  Rows are put in
    square cells of side ``distance``: inside a cell every row but the first has
    an earlier neighbour, so only one row per cell looks at the cells around it.
    """
    group = ["chr1", "chr2", "goRight1", "goRight2"]
    key = F.struct("pos1", "pos2", "cid", "mcid")
    rows = bnd.withColumn("_x", tile_of(F.col("pos1"), distance)).withColumn("_y", tile_of(F.col("pos2"), distance)).withColumn("_key", key)
    rows = cut_lineage(rows)  # read for the first row of each cell and for the rows around it
    cell = [*group, "_x", "_y"]
    first = rows.groupBy(*cell).agg(F.min("_key").alias("_key"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)])
    near = first.select(*group, F.col("_key").alias("_own"), F.explode(steps).alias("_d"), "_x", "_y").select(
        *group, "_own", (F.col("_x") + F.col("_d.dx")).alias("_x"), (F.col("_y") + F.col("_d.dy")).alias("_y")
    )
    close = (F.col("_key") < F.col("_own")) & (F.abs(F.col("_key.pos1") - F.col("_own.pos1")) < distance) & (F.abs(F.col("_key.pos2") - F.col("_own.pos2")) < distance)
    hidden = near.join(rows.select(*cell, "_key"), cell).filter(close).select(*group, F.col("_own").alias("_key")).distinct()
    kept = first.select(*group, "_key").join(hidden, [*group, "_key"], "left_anti")
    return kept.select(*group, "_key.pos1", "_key.pos2", "_key.cid", "_key.mcid").select(*COLUMNS)


def separated(bnd: DataFrame, distance: int = C.MIN_BREAKEND_SEPARATION) -> DataFrame:
    """Drop pairs whose ends lie on one chromosome less than ``distance`` apart."""
    return bnd.filter((F.col("chr1") != F.col("chr2")) | (F.col("pos2") - F.col("pos1") >= distance))


def away_from_gaps(bnd: DataFrame, gaps: DataFrame, distance: int = C.GAP_DISTANCE) -> DataFrame:
    """Drop rows with an end closer than ``distance`` to a gap."""
    out = bnd
    for end in ("1", "2"):
        named = gaps.select(F.col("chrom").alias(f"chr{end}"), "start", "end")
        out = distance_to(out, named, [f"chr{end}"], f"pos{end}", "_gap").filter(
            F.col("_gap").isNull() | (F.col("_gap") >= distance)
        ).drop("_gap")
    return out


def adjacent_pairs(bnd: DataFrame, distance: int) -> DataFrame:
    """Pairs of rows with adjacent, oppositely oriented ends.

    ``bnd`` carries ``row`` (order of the table).  Output: ``i, ei, j, ej`` with
    i < j and the end numbers, plus both rows.  The end looking left must not lie
    right of the other and be less than ``distance`` before it.  Hotspot and
    near-duplicate filters run first, so an end has few neighbours.
    """
    row = F.struct("row", *COLUMNS)
    ends = bnd.select(row.alias("b"), F.explode(F.array(
        F.struct(F.lit(1).alias("e"), F.col("chr1").alias("chrom"), F.col("pos1").alias("pos"), F.col("goRight1").alias("right")),
        F.struct(F.lit(2).alias("e"), F.col("chr2").alias("chrom"), F.col("pos2").alias("pos"), F.col("goRight2").alias("right")),
    )).alias("x")).select("b", "x.e", "x.chrom", "x.pos", "x.right")
    left = ends.filter("NOT right").withColumn("_t", F.explode(F.array(tile_of(F.col("pos"), distance), tile_of(F.col("pos"), distance) + 1)))
    right = ends.filter("right").withColumn("_t", tile_of(F.col("pos"), distance))
    pairs = left.alias("a").join(right.alias("c"), ["chrom", "_t"]).filter(
        (F.col("c.pos") >= F.col("a.pos")) & (F.col("c.pos") - F.col("a.pos") < distance) & (F.col("a.b.row") != F.col("c.b.row"))
    )
    swap = F.col("a.b.row") > F.col("c.b.row")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(
        pick("a.b.row", "c.b.row").alias("i"), pick("a.e", "c.e").alias("ei"), pick("c.b.row", "a.b.row").alias("j"), pick("c.e", "a.e").alias("ej"),
        F.col("a.b").alias("A"), F.col("a.e").alias("eA"), F.col("c.b").alias("B"), F.col("c.e").alias("eB"),
    )


def _mate(side: str, what: str) -> Column:
    """Field of the mate end of row ``A``/``B``: the end that is not adjacent."""
    return F.when(F.col(f"e{side}") == 1, F.col(f"{side}.{what}2")).otherwise(F.col(f"{side}.{what}1"))


def _own(side: str, what: str) -> Column:
    return F.when(F.col(f"e{side}") == 1, F.col(f"{side}.{what}1")).otherwise(F.col(f"{side}.{what}2"))


def fold_change(regions: DataFrame, case: DataFrame, control: DataFrame | None, scale: float = 1.0) -> DataFrame:
    """``regions`` (``chrom, st, ed``) plus ``fc, contrast``: read depth against control or surroundings.

    Long events are measured on 50 kb at either end.  Without a control the
    contrast is a bracket at least 10 kb wide on both sides, scaled by length.
    Reads have ``chrom, start, end``; a read touching two measured pieces counts
    in each.  One pseudo-count is added to the contrast.
    """
    half = F.lit(C.EVENT_HALF_MAX)
    st, ed = F.col("st"), F.col("ed")
    size = ed - st
    long = size > 2 * C.EVENT_HALF_MAX
    mid_lo, mid_hi = st + F.floor(size / 2).cast("long"), st + F.ceil(size / 2).cast("long")
    load = F.least(F.lit(2 * C.EVENT_HALF_MAX), size)
    bracket = F.greatest(F.lit(C.BRACKET_MIN), load)
    piece = lambda role, s, e: F.struct(F.lit(role).alias("role"), s.alias("start"), e.alias("end"))
    event = [piece("event", st, F.when(long, st + half).otherwise(mid_lo)), piece("event", F.when(long, ed - half).otherwise(mid_hi), ed)]
    around = [piece("around", st - bracket, st), piece("around", ed, ed + bracket)]
    distinct = regions.select("chrom", "st", "ed").distinct()
    cut = lambda pieces: distinct.select("chrom", "st", "ed", F.explode(F.array(*pieces)).alias("p")).select("chrom", "st", "ed", "p.role", "p.start", "p.end")
    measure = lambda df, reads: count_overlaps(df, reads, ["chrom"], "start", "end", "start", "end")
    if control is None:
        counted = measure(cut(event + around), case).groupBy("chrom", "st", "ed").agg(
            F.sum(F.when(F.col("role") == "event", F.col("n"))).alias("donor"), F.sum(F.when(F.col("role") == "around", F.col("n"))).alias("other")
        )
        factor = load / (2 * bracket + 2)
    else:
        counted = measure(cut(event), case).groupBy("chrom", "st", "ed").agg(F.sum("n").alias("donor")).join(
            measure(cut(event), control).groupBy("chrom", "st", "ed").agg(F.sum("n").alias("other")), ["chrom", "st", "ed"]
        )
        factor = F.lit(float(scale))
    out = counted.select("chrom", "st", "ed", ((F.col("donor") / (F.col("other") + 1)) / factor).alias("fc"), (F.col("other") + 1).alias("contrast"))
    return regions.join(out, ["chrom", "st", "ed"], "left")


def classify(bnd: DataFrame, distance: int, case: DataFrame | None, control: DataFrame | None = None, scale: float = 1.0,
             del_fold: float = C.DEL_FOLD, dup_fold: float = C.DUP_FOLD, max_length: int = C.MAX_FOLD_LENGTH,
             min_length: int = C.MIN_FOLD_LENGTH) -> DataFrame:
    """Type every breakend row: INV, INS.DUP, TRA, DOM.INS, DEL, TANDEM.DUP or INTERCHROMOSOMAL.

    A fold change below ``del_fold`` is a loss, above ``dup_fold`` a gain; regions
    of ``max_length`` or more are not measured, those under ``min_length`` need not be.

    Adjacent pairs are read in table order and later ones overwrite earlier ones.
    ``case``/``control`` are reads for coverage checks; without ``case`` no
    coverage is looked at.  Adds ``Distance, EventType, Partner, FoldChange,
    EventStart, EventEnd, DonorStart, DonorEnd``.
    """
    pairs = adjacent_pairs(bnd, distance)
    pairs = pairs.select(
        "i", "ei", "j", "ej",
        _own("A", "chr").alias("chrom"), _own("A", "pos").alias("posA"), _own("B", "pos").alias("posB"),
        _mate("A", "chr").alias("chrAm"), _mate("B", "chr").alias("chrBm"), _mate("A", "pos").alias("posAm"), _mate("B", "pos").alias("posBm"),
        _mate("A", "goRight").alias("rAm"), _mate("B", "goRight").alias("rBm"),
        F.struct(F.col("A.row").alias("row"), F.col("A.pos1").alias("p1"), F.col("A.pos2").alias("p2")).alias("ra"),
        F.struct(F.col("B.row").alias("row"), F.col("B.pos1").alias("p1"), F.col("B.pos2").alias("p2")).alias("rb"),
    )
    inversion = ~F.col("rAm") & F.col("rBm") & (F.col("chrom") == F.col("chrAm")) & (F.col("chrom") == F.col("chrBm")) & (F.abs(F.col("posBm") - F.col("posAm")) < distance)
    same = F.col("chrAm") == F.col("chrBm")
    straight = same & F.col("rAm") & ~F.col("rBm") & (F.col("posAm") < F.col("posBm"))
    inverted = same & ~F.col("rAm") & F.col("rBm") & (F.col("posAm") > F.col("posBm"))
    pairs = pairs.withColumn("inv", inversion).withColumn("shape", F.when(straight, "").when(inverted, ".INV"))
    pairs = pairs.filter("inv OR chrAm = chrBm").withColumn("dst", F.least("posAm", "posBm")).withColumn("ded", F.greatest("posAm", "posBm"))
    # the size limit guards the straight branch only; inverted donors are measured at any size
    checked = F.lit(case is not None) & ~F.col("inv") & F.col("shape").isNotNull() & (
        (F.col("shape") == ".INV") | (F.col("ded") - F.col("dst") < max_length)
    )
    pairs = pairs.withColumn("checked", checked)
    if case is not None:
        asked = pairs.filter("checked").select(F.col("chrAm").alias("chrom"), F.col("dst").alias("st"), F.col("ded").alias("ed")).distinct()
        measured = fold_change(asked, case, control, scale).select(F.col("chrom").alias("chrAm"), F.col("st").alias("dst"), F.col("ed").alias("ded"), "fc", "contrast")
        pairs = pairs.join(measured, ["chrAm", "dst", "ded"], "left")
    else:
        pairs = pairs.withColumn("fc", F.lit(None).cast("double")).withColumn("contrast", F.lit(None).cast("long"))
    fc = F.coalesce(F.col("fc"), F.lit(1.0))
    grown = (fc > dup_fold) & (F.col("contrast") > C.MIN_FOLD_READS)
    ending = F.coalesce(F.col("shape"), F.lit(""))
    kind = F.when(F.col("inv"), F.lit("INV")).when(~F.col("checked"), F.concat(F.lit("DOM.INS"), ending)).when(grown, F.concat(F.lit("INS.DUP"), ending)).otherwise(F.concat(F.lit("TRA"), ending))
    shaped = ~F.col("inv") & F.col("shape").isNotNull()
    own = lambda me, other: F.struct(
        F.col(f"{me}.row").alias("row"), F.struct("i", "j", "ei", "ej").alias("at"), kind.alias("EventType"), F.col(f"{other}.row").alias("Partner"),
        F.when(F.col("inv"), F.col(f"{me}.p1")).when(shaped, F.col("posA")).alias("EventStart"),
        F.when(F.col("inv"), F.col(f"{me}.p2")).when(shaped, F.col("posB")).alias("EventEnd"),
        F.when(shaped, F.col("dst")).alias("DonorStart"), F.when(shaped, F.col("ded")).alias("DonorEnd"),
        F.when(F.col("checked"), fc).alias("FoldChange"),
    )
    said = pairs.select(F.explode(F.array(own("ra", "rb"), own("rb", "ra"))).alias("x")).select("x.*")
    # later pairs overwrite only what they set themselves, so every field takes its last set value
    fields = ["EventType", "Partner", "EventStart", "EventEnd", "DonorStart", "DonorEnd", "FoldChange"]
    last = said.groupBy("row").agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in fields])
    out = cut_lineage(bnd.join(last, "row", "left"))
    single = out.filter("EventType IS NULL AND chr1 = chr2").select(F.col("chr1").alias("chrom"), F.col("pos1").alias("st"), F.col("pos2").alias("ed"))
    small = F.col("pos2") - F.col("pos1")
    if case is not None:
        depth = fold_change(single.filter(F.col("ed") - F.col("st") < max_length).distinct(), case, control, scale)
        out = out.join(depth.select(F.col("chrom").alias("chr1"), F.col("st").alias("pos1"), F.col("ed").alias("pos2"), F.col("fc").alias("_fc"), F.col("contrast").alias("_cc")), ["chr1", "pos1", "pos2"], "left")
        out = out.withColumn("_fc", F.when(small < max_length, F.coalesce("_fc", F.lit(1.0))))
    else:
        out = out.withColumn("_fc", F.lit(None).cast("double")).withColumn("_cc", F.lit(None).cast("long"))
    free = F.col("EventType").isNull() & (F.col("chr1") == F.col("chr2"))
    enough = F.coalesce(F.col("_cc") > C.MIN_FOLD_READS, F.lit(False))
    short = small < min_length
    loss, gain = free & ~F.col("goRight1") & F.col("goRight2"), free & F.col("goRight1") & ~F.col("goRight2")
    is_del = loss & (short | F.coalesce((F.col("_fc") < del_fold) & enough, F.lit(False)))
    is_dup = gain & (short | F.coalesce((F.col("_fc") > dup_fold) & enough, F.lit(False)))
    called = is_del | is_dup
    kind = F.when(is_del, "DEL").when(is_dup, "TANDEM.DUP").when(F.col("EventType").isNull() & (F.col("chr1") != F.col("chr2")), "INTERCHROMOSOMAL").otherwise(F.col("EventType"))
    return out.select(
        "row", *COLUMNS, F.when(F.col("chr1") == F.col("chr2"), small).alias("Distance"), kind.alias("EventType"), "Partner",
        F.when(loss | gain, F.col("_fc")).otherwise(F.col("FoldChange")).alias("FoldChange"),
        F.when(called, F.col("pos1")).otherwise(F.col("EventStart")).alias("EventStart"), F.when(called, F.col("pos2")).otherwise(F.col("EventEnd")).alias("EventEnd"),
        "DonorStart", "DonorEnd",
    )


def number_rows(bnd: DataFrame) -> DataFrame:
    """Add ``row``: 1-based rank by (chr1, pos1, pos2, cid, mcid).

    A range-partitioned sort gives every row its partition and place in it; the
    per-partition counts (one row each) turn that into a rank without moving the
    table through one task.
    """
    order = ["chr1", "pos1", "chr2", "pos2", "goRight1", "goRight2", "cid", "mcid"]
    return global_rank(bnd, order, "row")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense global row numbers by ``order``: a distributed sort plus partition offsets."""
    # the sorted table is pinned so that both uses below see the same partitions
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mono", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mono"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))  # one row per partition
    inner = F.col("_mono") - F.shiftleft(F.col("_part"), 33) + 1
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + inner).drop("_mono", "_part", "_off")


def pair_clips(left: DataFrame, right: DataFrame, read_length: int) -> DataFrame:
    """Left-clip clusters with the nearest right-clip cluster from 1 before to a read length after."""
    return nearest_within(
        left, right, ["chrom"], "position", "position_r", read_length,
        {"Rclip": F.col("position_r"), "Rreads": F.col("nreads"), "mcid": F.col("cid"), "pmmR": F.col("mismatch")}, low=-1,
    )


def call_insertions(left: DataFrame, right: DataFrame, read_length: int, min_reads: int, max_gap: int | None = None) -> DataFrame:
    """INS rows from left/right clip pairs with enough reads and a small gap.

    Clusters have ``chrom, position, nreads, mismatch, cid`` after hotspot
    removal.  Without ``max_gap`` it is the 10% quantile of the distance to the
    next right cluster, kept within 10..25.
    """
    right = right.withColumn("position_r", F.col("position"))
    paired = pair_clips(left, right.drop("position"), read_length).filter("Rclip IS NOT NULL")
    gap, total = F.col("dist"), F.col("nreads") + F.col("Rreads")
    if max_gap is None:
        paired = paired.crossJoin(F.broadcast(clip_gap(left, right).drop("_g")))  # one row
        limit: Column = F.col("max_gap")
    else:
        limit = F.lit(max_gap)
    return paired.filter((total >= min_reads) & (gap <= limit)).select(
        F.col("chrom").alias("chr1"), F.col("position").alias("pos1"), F.lit(False).alias("goRight1"), F.col("chrom").alias("chr2"),
        F.col("Rclip").alias("pos2"), F.lit(True).alias("goRight2"), "cid", "mcid", gap.alias("Distance"), F.lit("INS").alias("EventType"),
        total.alias("reads"),
    )


def clip_gap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: ``max_gap`` from the distances of left clips to the next right clip (from 1 before on)."""
    following = next_at_or_after(left.withColumn("_from", F.col("position") - 1), right, ["chrom"], "_from", "position_r", "_next")
    dist = following.filter("_next IS NOT NULL").select((F.col("_next") - F.col("position")).alias("d"))
    q = grouped_quantiles(dist, [], F.col("d"), {"q": 0.1})
    return q.select(F.lit(0).alias("_g"), F.least(F.lit(25.0), F.greatest("q", F.lit(10.0))).alias("max_gap"))


def next_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, name: str, tile: int = TILE) -> DataFrame:
    """Smallest right coordinate not before each left coordinate."""
    r = right.select(*keys, F.col(right_pos).alias("_p")).distinct().withColumn("_r", F.col("_p"))
    l = left.select(*keys, F.col(left_pos).alias("_p")).distinct().withColumn("_kind", F.lit(0))
    both = l.unionByName(r.withColumn("_kind", F.lit(1)), allowMissingColumns=True).withColumn("_tile", tile_of(F.col("_p"), tile))
    along = Window.partitionBy(*keys).orderBy(F.desc("_tile")).rowsBetween(Window.unboundedPreceding, -1)
    later = both.groupBy(*keys, "_tile").agg(F.min("_r").alias("_m")).select(*keys, "_tile", F.min("_m").over(along).alias("_later"))
    order = Window.partitionBy(*keys, "_tile").orderBy(F.desc("_p"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.min("_r").over(order)).filter("_kind = 0").join(later, [*keys, "_tile"])
    return left.join(found.select(*keys, F.col("_p").alias(left_pos), F.coalesce("_in", "_later").alias(name)), [*keys, left_pos], "left")


def single_events(bnd: DataFrame) -> DataFrame:
    """Type each breakend by itself: DEL or TANDEM.DUP under 10 kb by orientation, INTERCHROMOSOMAL across chromosomes."""
    short = F.col("pos2") - F.col("pos1") < C.MIN_FOLD_LENGTH
    event = (
        F.when(F.col("chr1") != F.col("chr2"), "INTERCHROMOSOMAL")
        .when(~F.col("goRight1") & F.col("goRight2") & short, "DEL")
        .when(F.col("goRight1") & ~F.col("goRight2") & short, "TANDEM.DUP")
    )
    return bnd.select(*COLUMNS, event.alias("event"))
