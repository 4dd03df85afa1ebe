"""Interval primitives that stay linear on skewed data.

Coordinates are cut into fixed tiles.  Rows are first reduced to one row per
coordinate inside a tile, so no window partition ever holds more rows than a
tile has coordinates, however many reads pile up on one locus.  Only per-tile
border rows (a few per tile) are ordered along a whole chromosome.  No operator
here enumerates overlapping pairs.

Intervals are closed, ``[start, end]``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, dealt, shuffled, stored

TILE = 100_000
LEVELS = 30  # dyadic levels: contigs shorter than 2**30 bases


def tile_of(pos: Column, width: int) -> Column:
    return ((pos - F.pmod(pos, F.lit(width))) / F.lit(width)).cast("long")


def _to_tiles(df: DataFrame, start: str, end: str, tile: int) -> DataFrame:
    """One row per tile an interval touches, in column ``_tile``."""
    return df.withColumn("_tile", F.explode(F.sequence(tile_of(F.col(start), tile), tile_of(F.col(end), tile))))


def _stitch(df: DataFrame, keys: list[str], joins_prev) -> DataFrame:
    """Group ids ``_gid`` for the first and last row of every tile.

    ``df`` has ``_tile, start, end, _border`` and ``joins_prev`` maps the lagged
    border row (a Column giving a lagged column by name) to a boolean.
    """
    order = Window.partitionBy(*keys).orderBy("_tile", "start")
    lagged = lambda name: F.lag(name).over(order)
    new = F.when(F.coalesce(joins_prev(lagged), F.lit(False)), 0).otherwise(1)
    return df.filter("_border").withColumn("_new", new).withColumn("_gid", F.sum("_new").over(order)).drop("_new")


def interval_runs(df: DataFrame, keys: list[str], start: str, end: str, sums: dict[str, Column],
                  tile: int = TILE, merge: bool = False) -> DataFrame:
    """Piecewise-constant sums over intervals: ``keys, start, end, <sums>``.

    Every interval adds its values where it starts and takes them back after it
    ends; running sums inside each tile give the covered stretches.  Values must
    be integers for the result to be exact.  ``merge`` joins stretches that only
    a tile border separates.
    """
    names = list(sums)
    cut = _to_tiles(df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), *[sums[n].alias(n) for n in names]), "_s", "_e", tile)
    lo, stop = F.col("_tile") * tile, (F.col("_tile") + 1) * tile
    # a border closes every interval of its tile, so intervals that go on need no closing row
    opening = F.struct(F.greatest("_s", lo).alias("pos"), F.lit(1).alias("sign"))
    closing = F.struct((F.col("_e") + 1).alias("pos"), F.lit(-1).alias("sign"))
    ends_here = F.col("_e") + 1 < stop
    events = cut.select(*keys, "_tile", *names, F.explode(F.when(ends_here, F.array(opening, closing)).otherwise(F.array(opening))).alias("_ev"))
    events = events.select(*keys, "_tile", *names, F.col("_ev.pos").alias("start"), F.col("_ev.sign").alias("_sign"))
    # an interval makes two rows in most cases; they are summed and ordered in parts of bounded length, a hot locus by its bases first
    rows = 2 * cut.count()
    events = dealt(events, rows, *keys, "_tile", "start").groupBy(*keys, "_tile", "start").agg(
        *[F.sum(F.col("_sign") * F.col(n)).alias(n) for n in names],
        F.sum("_sign").alias("_net"),
    )
    events = dealt(events, rows, *keys, "_tile")
    order = Window.partitionBy(*keys, "_tile").orderBy("start")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    levels = events.select(*keys, "_tile", "start", *[F.sum(n).over(running).alias(n) for n in names], F.sum("_net").over(running).alias("_n"))
    if merge:
        # rows that change nothing are left out before ends are looked up, so that one order serves all steps
        value = F.when(F.col("_n") > 0, F.struct(*names))
        levels = levels.withColumn("_v", value).withColumn("_before", F.lag("_v").over(order)).filter("NOT _v <=> _before")
    last = (F.col("_tile") + 1) * tile - 1
    runs = levels.select(*keys, "_tile", "start", F.coalesce(F.lead("start").over(order) - 1, last).alias("end"), *names, "_n").filter("_n > 0")
    if not merge:
        return runs.drop("_tile", "_n")
    # runs that touch no border of their tile are whole
    touches = (F.col("start") == F.col("_tile") * tile) | (F.col("end") == last)
    return _merge_across_tiles(runs.drop("_n").withColumn("_border", touches), keys, names)


def _merge_across_tiles(runs: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Join runs with equal values that only a tile border separates."""
    local = stored(runs)
    joins = lambda lag: (lag("end") + 1 == F.col("start")) & reduce(lambda a, b: a & b, [lag(n) == F.col(n) for n in names])
    merged = _stitch(local, keys, joins).groupBy(*keys, "_gid").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(n).alias(n) for n in names]
    )
    cols = [*keys, "start", "end", *names]
    return merged.select(cols).unionByName(local.filter("NOT _border").select(cols))


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def islands(df: DataFrame, keys: list[str], start: str, end: str, max_step: int,
            aggs: dict[str, tuple[str, Column]] | None = None, tile: int = TILE) -> DataFrame:
    """Merge intervals into islands: ``keys, start, end, <aggs>``.

    An interval joins the island before it when ``start - (largest end so far)
    <= max_step``; 0 joins on overlap only, 1 also on adjacency.  ``aggs`` maps a
    name to ``(sum|min|max, column)``; every input row counts once.
    """
    aggs = aggs or {}
    if max_step >= tile:
        raise ValueError("max_step must be smaller than the tile")
    cut = _to_tiles(
        df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), *[c.alias(n) for n, (_, c) in aggs.items()]),
        "_s", "_e", tile,
    )
    lo = F.greatest(F.col("_s"), F.col("_tile") * tile)
    head = F.col("_s") >= F.col("_tile") * tile
    # an interval cut at a border keeps the border coordinate on both sides, so
    # its pieces overlap and are joined again whatever max_step is
    places = cut.groupBy(*keys, "_tile", lo.alias("start")).agg(
        F.max(F.least(F.col("_e"), (F.col("_tile") + 1) * tile)).alias("end"),
        *[_MERGE[kind](F.when(head, F.col(n)) if kind == "sum" else F.col(n)).alias(n) for n, (kind, _) in aggs.items()],
    )
    order = Window.partitionBy(*keys, "_tile").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merge = [_MERGE[kind](n).alias(n) for n, (kind, _) in aggs.items()]
    local = (
        places.withColumn("_new", F.when(F.col("start") - before <= max_step, 0).otherwise(1))
        .withColumn("_lid", F.sum("_new").over(order))
        .groupBy(*keys, "_tile", "_lid")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), *merge)
    )
    both = Window.partitionBy(*keys, "_tile")
    local = local.withColumn("_border", (F.col("_lid") == F.min("_lid").over(both)) | (F.col("_lid") == F.max("_lid").over(both)))
    stitched = _stitch(local, keys, lambda lag: F.col("start") - lag("end") <= max_step)
    cols = [*keys, "start", "end", *aggs]
    merged = stitched.groupBy(*keys, "_gid").agg(F.min("start").alias("start"), F.max("end").alias("end"), *merge)
    return merged.select(cols).unionByName(local.filter("NOT _border").select(cols))


def island_of_points(points: DataFrame, found: DataFrame, keys: list[str], pos: str, carry: dict[str, Column],
                     tile: int = TILE) -> DataFrame:
    """Attach to every point the disjoint interval of ``found`` that contains it.

    ``found`` has ``keys, start, end``; ``carry`` names the columns taken from it,
    NULL where no interval contains the point.
    """
    inside = found.select(*keys, F.col("start").alias("_fs"), F.col("end").alias("_fe"), *[c.alias(n) for n, c in carry.items()])
    cut = _to_tiles(inside, "_fs", "_fe", tile)
    starts = cut.select(
        *keys, "_tile", F.greatest(F.col("_fs"), F.col("_tile") * tile).alias("_p"), F.lit(0).alias("_kind"),
        F.struct("_fe", *carry).alias("_hit"),
    )
    places = points.select(*keys, F.col(pos).alias("_p")).distinct().withColumn("_tile", tile_of(F.col("_p"), tile))
    both = starts.unionByName(places.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_tile").orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    located = both.withColumn("_last", F.last("_hit", ignorenulls=True).over(order)).filter("_kind = 1")
    located = located.select(
        *keys, F.col("_p").alias(pos),
        *[F.when(F.col("_last._fe") >= F.col("_p"), F.col(f"_last.{n}")).alias(n) for n in carry],
    )
    return points.join(located, [*keys, pos], "left")


def prefix_at(points: DataFrame, events: DataFrame, keys: list[str], pos: str, values: list[str],
              tile: int = TILE) -> DataFrame:
    """For each distinct point, the sums of ``values`` over events at or before it.

    Events and points become one row per coordinate in one shuffle, which is written once and read for the tile
    totals and for the running sums inside tiles.  Several events or points at a coordinate may be rows of their own.
    """
    asked = points.select(*keys, pos).withColumn("_asked", F.lit(True))
    both = events.select(*keys, pos, *values).unionByName(asked, allowMissingColumns=True)
    both = both.groupBy(*keys, tile_of(F.col(pos), tile).alias("_tile"), pos).agg(
        *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values], F.max("_asked").alias("_asked"))
    both = cut_lineage(both)
    along = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    base = both.groupBy(*keys, "_tile").agg(*[F.sum(v).alias(f"_t_{v}") for v in values]).select(
        *keys, "_tile", *[F.coalesce(F.sum(f"_t_{v}").over(along), F.lit(0)).alias(f"_b_{v}") for v in values]
    )
    order = Window.partitionBy(*keys, "_tile").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    inner = both.select(*keys, "_tile", pos, "_asked", *[F.sum(v).over(order).alias(v) for v in values]).filter("_asked")
    return inner.join(base, [*keys, "_tile"]).select(*keys, pos, *[(F.col(v) + F.col(f"_b_{v}")).alias(v) for v in values])


def range_sums(regions: DataFrame, events: DataFrame, keys: list[str], start: str, end: str, pos: str,
               values: list[str], tile: int = TILE) -> DataFrame:
    """``regions`` plus the sums of ``values`` over events with start <= pos <= end."""
    points = regions.select(*keys, F.explode(F.array(F.col(start) - 1, F.col(end))).alias(pos))
    # at most two points per distinct region; both lookups below read them
    cum = cut_lineage(prefix_at(points, events, keys, pos, values, tile))
    upper = cum.select(*keys, F.col(pos).alias(end), *[F.col(v).alias(f"_u_{v}") for v in values])
    lower = cum.select(*keys, (F.col(pos) + 1).alias(start), *[F.col(v).alias(f"_l_{v}") for v in values])
    joined = regions.join(upper, [*keys, end], "left").join(lower, [*keys, start], "left")
    return joined.select(*regions.columns, *[(F.col(f"_u_{v}") - F.col(f"_l_{v}")).alias(v) for v in values])


def count_overlaps(regions: DataFrame, items: DataFrame, keys: list[str], start: str, end: str,
                   item_start: str, item_end: str, name: str = "n", tile: int = TILE) -> DataFrame:
    """``regions`` plus the number of item intervals overlapping each.

    Overlaps = items starting at or before the region's end, less items ending
    before its start, so two prefix counts replace the join; items are read once.
    """
    side = lambda c, st, en: F.struct(F.col(c).cast("long").alias("_pos"), F.lit(st).alias("_st"), F.lit(en).alias("_en"))
    events = items.select(*keys, F.explode(F.array(side(item_start, 1, 0), side(item_end, 0, 1))).alias("_x")).select(*keys, "_x.*")
    points = regions.select(*keys, F.explode(F.array((F.col(start) - 1).cast("long"), F.col(end).cast("long"))).alias("_pos"))
    cum = cut_lineage(prefix_at(points, events, keys, "_pos", ["_st", "_en"], tile))
    upper = cum.select(*keys, F.col("_pos").alias(end), F.col("_st").alias("_u"))
    lower = cum.select(*keys, (F.col("_pos") + 1).alias(start), F.col("_en").alias("_l"))
    joined = regions.join(upper, [*keys, end], "left").join(lower, [*keys, start], "left")
    return joined.select(*regions.columns, (F.coalesce("_u", F.lit(0)) - F.coalesce("_l", F.lit(0))).alias(name))


def _ancestors(pos: Column, levels: int) -> Column:
    """The dyadic blocks, one per level, that contain a coordinate."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda l: F.struct(l.alias("lv"), F.floor(pos / F.pow(F.lit(2.0), l)).cast("long").alias("nd")))


def _cover(start: Column, end: Column, levels: int, top: int) -> Column:
    """The maximal dyadic blocks that tile ``[start, end]`` exactly (at most two per level), none above level ``top``."""
    end = F.when(end < 1 << levels, end).otherwise(F.raise_error(F.lit(f"a position is past 2 ** {levels}, the dyadic levels in use")).cast("long"))

    def at(level):
        size = F.pow(F.lit(2.0), level)
        first = F.ceil(start / size).cast("long")
        last = (F.floor((end + 1) / size) - 1).cast("long")
        left = F.when((first <= last) & (first % 2 == 1), F.struct(level.alias("lv"), first.alias("nd")))
        right = F.when((first <= last) & (last % 2 == 0), F.struct(level.alias("lv"), last.alias("nd")))
        return F.array(left, right)
    blocks = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), at))
    return F.array_distinct(F.filter(blocks, lambda b: b.isNotNull()))


def overlap_reduce(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str,
                   aggs: dict[str, tuple[str, Column]], levels: int = LEVELS) -> DataFrame:
    """Reduce, for every left interval, the right rows that overlap it.

    An overlapping right interval either starts inside the left one or contains
    its first coordinate.  Both cases become equi-joins on dyadic blocks whose
    build side holds one pre-reduced row per block, so the work is
    O((n + m) levels) rows however many pairs overlap; no block of a side is longer
    than its longest interval, which bounds the levels.  Both sides name their
    interval columns ``start`` and ``end``; ``aggs`` as in :func:`islands`.
    """
    mine = cut_lineage(left.select(*keys, start, end).distinct())
    values = [c.alias(n) for n, (_, c) in aggs.items()]
    merge = [_MERGE[kind](n).alias(n) for n, (kind, _) in aggs.items()]
    theirs = right.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), *values).groupBy(*keys, "_s", "_e").agg(*merge)
    theirs = cut_lineage(theirs)
    longest = lambda df, first, last: max(df.agg(F.max(F.col(last) - F.col(first) + 1)).first()[0] or 1, 1)
    top = lambda df, first, last: min(levels, int(longest(df, first, last)).bit_length() - 1)
    own, other = top(mine, start, end), top(theirs, "_s", "_e")
    block = [F.col("_b.lv").alias("_lv"), F.col("_b.nd").alias("_nd")]
    by_start = (
        theirs.groupBy(*keys, "_s").agg(*merge)
        .withColumn("_b", F.explode(_ancestors(F.col("_s"), own)))
        .select(*keys, *block, *aggs).groupBy(*keys, "_lv", "_nd").agg(*merge)
    )
    by_cover = (
        theirs.withColumn("_b", F.explode(_cover(F.col("_s"), F.col("_e"), levels, other)))
        .select(*keys, *block, *aggs).groupBy(*keys, "_lv", "_nd").agg(*merge)
    )
    inside = mine.filter(F.col(end) > F.col(start)).withColumn("_b", F.explode(_cover(F.col(start) + 1, F.col(end), levels, own)))
    stabbed = mine.withColumn("_b", F.explode(_ancestors(F.col(start), other)))
    cols = [*keys, start, end]
    hits = (
        inside.select(*cols, *block).join(shuffled(by_start), [*keys, "_lv", "_nd"])
        .unionByName(stabbed.select(*cols, *block).join(shuffled(by_cover), [*keys, "_lv", "_nd"]))
        .groupBy(*cols).agg(*merge)
    )
    return left.join(hits, cols, "left")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end",
                keep: bool = True) -> DataFrame:
    """Left rows that overlap some right interval (``keep``), or that overlap none."""
    flagged = overlap_reduce(left, right, keys, start, end, {"_any": ("max", F.lit(1))})
    return flagged.filter(F.col("_any").isNotNull() if keep else F.col("_any").isNull()).drop("_any")


def points_in(points: DataFrame, regions: DataFrame, keys: list[str], pos: str, keep: bool = True,
              tile: int = TILE) -> DataFrame:
    """Points inside (or, with ``keep=False``, outside) a set of intervals."""
    merged = islands(regions, keys, "start", "end", 1, tile=tile)
    marked = island_of_points(points, merged, keys, pos, {"_in": F.lit(True)}, tile)
    return marked.filter(F.col("_in").isNotNull() if keep else F.col("_in").isNull()).drop("_in")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, band: int,
                   carry: dict[str, Column], low: int | None = None, tile: int = TILE) -> DataFrame:
    """The right row nearest to each left row, at most ``band`` away.

    Distance is ``right - left``; ``low`` bounds it from below (default ``-band``)
    and ties go to the smaller coordinate.  ``right`` holds one row per
    coordinate.  Adds ``dist`` and the ``carry`` columns; NULL where nothing is near.
    """
    low = -band if low is None else low
    reach = max(abs(low), band)
    hit = F.struct(F.col(right_pos).alias("_rp"), *[c.alias(n) for n, c in carry.items()])
    spread = right.select(*keys, F.col(right_pos).alias("_p"), hit.alias("_hit")).withColumn(
        "_tile", F.explode(F.sequence(tile_of(F.col("_p") - reach, tile), tile_of(F.col("_p") + reach, tile)))
    )
    places = left.select(*keys, F.col(left_pos).alias("_p")).distinct().withColumn("_tile", tile_of(F.col("_p"), tile))
    both = spread.withColumn("_kind", F.lit(0)).unionByName(places.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_tile").orderBy("_p", "_kind")
    # the hit to the right is the last one met when walking back: running frames cost one pass, trailing ones do not
    both = both.withColumn("_before", F.last("_hit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*keys, "_tile").orderBy(F.desc("_p"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_after", F.last("_hit", ignorenulls=True).over(back))
    gap = lambda h: F.col(f"{h}._rp") - F.col("_p")
    fits = lambda h: F.when((gap(h) >= low) & (gap(h) <= band), F.col(h))
    near = both.filter("_kind = 1").withColumn("_x", fits("_before")).withColumn("_y", fits("_after"))
    pick = F.when(F.col("_x").isNull(), F.col("_y")).when(F.col("_y").isNull(), F.col("_x")).when(
        F.abs(gap("_y")) < F.abs(gap("_x")), F.col("_y")
    ).otherwise(F.col("_x"))
    near = near.withColumn("_pick", pick).select(
        *keys, F.col("_p").alias(left_pos), (F.col("_pick._rp") - F.col("_p")).alias("dist"),
        *[F.col(f"_pick.{n}").alias(n) for n in carry],
    )
    return left.join(near, [*keys, left_pos], "left")


def distance_to(points: DataFrame, regions: DataFrame, keys: list[str], pos: str, name: str = "gap_distance",
                tile: int = TILE) -> DataFrame:
    """Distance from each point to the closest interval: 0 inside, NULL without intervals on the contig."""
    merged = islands(regions, keys, "start", "end", 1, tile=tile).withColumn("_tile", tile_of(F.col("start"), tile))
    asked = points.select(*keys, F.col(pos).alias("_p")).distinct().withColumn("_tile", tile_of(F.col("_p"), tile))
    both = merged.select(*keys, "_tile", F.col("start").alias("_p"), F.lit(0).alias("_kind"), F.col("start").alias("_st"), F.col("end").alias("_en")).unionByName(
        asked.withColumn("_kind", F.lit(1)), allowMissingColumns=True
    )
    # nearest interval of earlier and later tiles: one row per tile along the chromosome
    earlier = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_tile")).rowsBetween(Window.unboundedPreceding, -1)
    per_tile = both.groupBy(*keys, "_tile").agg(F.max("_en").alias("_me"), F.min("_st").alias("_ms")).select(
        *keys, "_tile", F.max("_me").over(earlier).alias("_prev"), F.min("_ms").over(later).alias("_next")
    )
    forth = Window.partitionBy(*keys, "_tile").orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "_tile").orderBy(F.desc("_p"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    inner = both.select(
        *keys, "_tile", "_p", "_kind", F.max("_en").over(forth).alias("_e"), F.min("_st").over(back).alias("_s")
    ).filter("_kind = 1")
    joined = inner.join(per_tile, [*keys, "_tile"])
    before, after = F.greatest("_e", "_prev"), F.least("_s", "_next")
    closest = F.least(F.col("_p") - before, after - F.col("_p"))
    dist = F.when(closest.isNotNull(), F.greatest(F.lit(0), closest))
    return points.join(joined.select(*keys, F.col("_p").alias(pos), dist.alias(name)), [*keys, pos], "left")
