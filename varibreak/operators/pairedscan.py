"""Windows with enough x events followed by enough y events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .intervals import island_of_points, islands, tile_of

STRETCH_TILE = 1_000_000  # positions; stretches that begin in a tile are walked by one call


def _scan(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, w: int, min_x: int, min_y: int):
    """Greedy walk over distinct sorted positions with their counts."""
    cum_x, cum_y = np.concatenate([[0], np.cumsum(nx)]), np.concatenate([[0], np.cumsum(ny)])
    hits, i, j = [], 0, 0
    while i < len(x):
        start = x[i]
        j = max(j, int(np.searchsorted(y, start, side="right")))
        if j >= len(y):
            break
        if y[j] - start > 2 * w:
            # no y follows closely; restart at the first x within 2w of that y
            i = max(i + 1, int(np.searchsorted(x, y[j] - 2 * w, side="left")))
            continue
        stop_x = int(np.searchsorted(x, start + w, side="left"))
        first_y = max(j, int(np.searchsorted(y, x[stop_x - 1] + 1, side="left")))
        stop_y = max(first_y, int(np.searchsorted(y, start + 2 * w, side="left")))
        count_x, count_y = cum_x[stop_x] - cum_x[i], cum_y[stop_y] - cum_y[first_y]
        if count_x >= min_x and count_y >= min_y:
            hits.append((int(start), int(count_x), int(count_y)))
        i, j = stop_x, stop_y
    return hits


def paired_event_scan(x: DataFrame, y: DataFrame, keys: list[str], pos: str, w: int, min_x: int = 1, min_y: int = 1) -> DataFrame:
    """``keys, first_x, count_x, count_y`` of every window ``[first_x, first_x + w)`` holding at
    least ``min_x`` x events, followed within ``2w`` of its start by at least ``min_y`` y events.

    The walk never looks further than ``2w`` ahead, so x events are cut into
    independent stretches wherever two of them lie ``2w`` or more apart; each
    stretch takes along the y events up to ``2w`` after it.  Events are counted
    per position first: a stretch costs its length, not its depth.  A call walks all
    stretches that begin in one tile.
    """
    counted = lambda df: df.groupBy(*keys, F.col(pos).alias("_p")).agg(F.count("*").alias("_n"))
    # both are looked up several times; the reads are read once
    cx, cy = cut_lineage(counted(x)), cut_lineage(counted(y))
    reach = 2 * w
    stretches = islands(cx, keys, "_p", "_p", reach - 1, tile=max(100_000, 10 * reach))
    sid = {"_sid": F.col("start")}
    own_x = island_of_points(cx, stretches, keys, "_p", sid)
    # a y may follow two stretches: the one it lies in and the one ending within 2w before it
    here = island_of_points(cy, stretches.select(*keys, "start", (F.col("end") + reach).alias("end")), keys, "_p", sid)
    shifted = island_of_points(cy.withColumn("_q", F.col("_p") - reach), stretches, keys, "_q", {"_sid2": F.col("start")})
    own_y = here.select(*keys, "_p", "_n", "_sid").unionByName(
        shifted.select(*keys, "_p", "_n", F.col("_sid2").alias("_sid"))
    ).filter("_sid IS NOT NULL").distinct()
    both = own_x.select(*keys, "_p", "_n", "_sid", F.lit(True).alias("_is_x")).unionByName(own_y.withColumn("_is_x", F.lit(False)))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_sid", "_p"])
        sides = []
        for side in (pdf[pdf["_is_x"]], pdf[~pdf["_is_x"]]):
            sides.append([side[c].to_numpy(np.int64) for c in ("_sid", "_p", "_n")])
        (sx, *x_rows), (sy, *y_rows) = sides
        hits = []
        for sid in np.unique(sx):
            one = [v[slice(*np.searchsorted(s, [sid, sid + 1]))] for s, rows in ((sx, x_rows), (sy, y_rows)) for v in rows]
            hits += _scan(*one, w, min_x, min_y)
        out = pd.DataFrame(hits, columns=["first_x", "count_x", "count_y"]).astype("int64")
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "first_x", "count_x", "count_y"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema if f.name in keys)
    return both.withColumn("_part", tile_of(F.col("_sid"), STRETCH_TILE)).groupBy(*keys, "_part").applyInPandas(walk, f"{schema}, first_x long, count_x long, count_y long")
