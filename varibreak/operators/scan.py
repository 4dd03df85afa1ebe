"""Windowed log-likelihood scans over a regular grid.

Windows start at ``origin + step * i``.  A pair that straddles windows adds one
constant to a contiguous stretch of them, so it enters the running sums twice
(where the stretch starts and after it ends) instead of once per window.  Terms
are integers (see ``SCORE_SCALE``): sums are exact and independent of task order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import SCORE_SCALE
from ..functions.density import MAX_TABLE_ROWS, hanging_table, hanging_term_column, mixture_term, scaled, shifted_ratio, unscaled
from ..session import cut_lineage, small
from .intervals import interval_runs, islands
from .mates import pair_class

GRID_TILE = 10_000  # windows per tile


def first_window(pos: Column, origin: int, step: int) -> Column:
    """Index of the first grid start at or after ``pos``."""
    return F.ceil((pos - origin) / F.lit(float(step))).cast("long")


def last_window(pos: Column, origin: int, step: int) -> Column:
    """Index of the last grid start at or before ``pos``."""
    return F.floor((pos - origin) / F.lit(float(step))).cast("long")


def windows_within(df: DataFrame, start: Column, end: Column, w: int, step: int, origin: int) -> DataFrame:
    """Window index range ``i0..i1`` of windows ``[t, t + w - 1]`` contained in ``[start, end]``; rows without any drop out."""
    out = df.withColumn("i0", F.greatest(first_window(start, origin, step), F.lit(0))).withColumn("i1", last_window(end - (w - 1), origin, step))
    return out.filter("i0 <= i1")


def windows_overlapping(df: DataFrame, start: Column, end: Column, w: int, step: int, origin: int) -> DataFrame:
    """Index range of windows ``[t, t + w - 1]`` that overlap ``[start, end]``."""
    out = df.withColumn("i0", F.greatest(first_window(start - (w - 1), origin, step), F.lit(0))).withColumn("i1", last_window(end, origin, step))
    return out.filter("i0 <= i1")


def window_sums(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Runs of windows with their sums: ``keys, start, end`` are window indices."""
    return interval_runs(df, keys, "i0", "i1", sums, tile=GRID_TILE)


def to_windows(runs: DataFrame, keys: list[str], values: list[str], step: int, origin: int) -> DataFrame:
    """One row per window of every run, ``t`` = window start."""
    return runs.select(*keys, F.explode(F.sequence("start", "end")).alias("_i"), *values).select(
        *keys, (F.col("_i") * step + origin).alias("t"), *values
    )


def window_counts(items: DataFrame, keys: list[str], start: str, end: str, w: int, step: int, origin: int = 1) -> DataFrame:
    """Items overlapping each window (windows without items are absent)."""
    cut = windows_overlapping(items, F.col(start), F.col(end), w, step, origin)
    return to_windows(window_sums(cut, keys, {"n": F.lit(1)}), keys, ["n"], step, origin)


def straddle_scores(frags: DataFrame, keys: list[str], w: int, shift: int, step: int, r: float, mu: float, sigma: float,
                    origin: int = 1, cap: float | None = None) -> DataFrame:
    """Score and count of fragments ``start..end`` (with ``isize``) that contain each window.

    ``shift`` is the event size entering the density ratio: positive for
    deletions, negative for insertions.
    """
    return straddle_terms(frags, keys, w, {"score": shift}, step, r, mu, sigma, origin, cap)


def straddle_terms(frags: DataFrame, keys: list[str], w: int, shifts: dict[str, int], step: int, r: float, mu: float, sigma: float,
                   origin: int = 1, cap: float | None = None) -> DataFrame:
    """The scores of several event sizes, by name, and the count ``n`` from one pass over the fragments; see :func:`straddle_scores`."""
    terms = {n: scaled(mixture_term(shifted_ratio(F.col("isize"), shift, mu, sigma, cap), r)).alias(f"_{n}") for n, shift in shifts.items()}
    cut = windows_within(frags.select("*", *terms.values()), F.col("start"), F.col("end"), w, step, origin)
    return window_sums(cut, keys, {**{n: F.col(f"_{n}") for n in shifts}, "n": F.lit(1)})


def deletion_scan(pairs: DataFrame, keys: list[str], w: int, step: int, rates: list[float], mu: float, sigma: float,
                  origin: int = 1) -> DataFrame:
    """Deletion score per window and mixing rate: ``keys, t, r, cov_term, il_term, z``.

    ``pairs`` has ``p_start, p_end, m_start, m_end``.  The coverage term counts
    reads of either strand in the window; the insert-length term sums over
    fragments (the bases between the reads) that contain it.
    """
    frag = pairs.withColumn("fs", F.col("p_end") + 1).withColumn("fe", F.greatest(F.col("m_start"), F.col("p_end") + 2) - 1)
    ratio = shifted_ratio(F.col("fe") - F.col("fs") + 1, w, mu, sigma)
    terms = {f"il_{i}": scaled(mixture_term(ratio, r)) for i, r in enumerate(rates)}
    il = windows_within(frag, F.col("fs"), F.col("fe"), w, step, origin).select(*keys, "i0", "i1", F.lit(0).alias("reads"), *[c.alias(n) for n, c in terms.items()])
    ends = pairs.select(*keys, F.explode(F.array(F.struct(F.col("p_start").alias("s"), F.col("p_end").alias("e")), F.struct(F.col("m_start").alias("s"), F.col("m_end").alias("e")))).alias("x"))
    cov = windows_overlapping(ends, F.col("x.s"), F.col("x.e"), w, step, origin).select(*keys, "i0", "i1", F.lit(1).alias("reads"))
    both = il.unionByName(cov, allowMissingColumns=True).fillna(0, subset=list(terms))
    runs = window_sums(both, keys, {"reads": F.col("reads"), **{n: F.col(n) for n in terms}})
    per_rate = F.array(*[
        F.struct(F.lit(float(r)).alias("r"), (F.col("reads") * round(math.log(1.0 - r) * SCORE_SCALE)).alias("cov"), F.col(f"il_{i}").alias("il"))
        for i, r in enumerate(rates)
    ])
    wide = to_windows(runs.withColumn("_x", per_rate), keys, ["_x"], step, origin)
    return wide.select(*keys, "t", F.explode("_x").alias("x")).select(
        *keys, "t", F.col("x.r").alias("r"), unscaled(F.col("x.cov")).alias("cov_term"), unscaled(F.col("x.il")).alias("il_term"),
        unscaled(F.col("x.cov") + F.col("x.il")).alias("z"),
    )


def hanging_scores(reads: DataFrame, keys: list[str], pos: str, before: bool, w: int, step: int, delta: int, r: float, p: float,
                   mu: float, sigma: float, origin: int = 1) -> DataFrame:
    """Score and count of hanging reads at distance 1 .. delta - 1 from each window.

    ``before`` takes reads left of the window start; otherwise the distance runs
    from the window's end ``t + w`` to the read.  Reads at one position are
    counted before they are spread over their windows.
    """
    at = reads.filter(F.col(pos).isNotNull()).groupBy(*keys, F.col(pos).alias("_x")).agg(F.count("*").alias("_n"))
    lo, hi = (F.col("_x") + 1, F.col("_x") + delta - 1) if before else (F.col("_x") - w - delta + 1, F.col("_x") - w - 1)
    spread = at.withColumn("i0", F.greatest(first_window(lo, origin, step), F.lit(0))).withColumn("i1", last_window(hi, origin, step)).filter("i0 <= i1")
    spread = spread.select(*keys, "_x", "_n", F.explode(F.sequence("i0", "i1")).alias("i")).withColumn("t", F.col("i") * step + origin)
    dist = F.col("t") - F.col("_x") if before else F.col("_x") - (F.col("t") + w)
    terms = hanging_table(reads.sparkSession, delta, mu, sigma, r, p)
    return (
        spread.withColumn("dist", dist).join(F.broadcast(terms), "dist")
        .groupBy(*keys, "t").agg(F.sum(F.col("term") * F.col("_n")).alias("score"), F.sum("_n").alias("n"))
    )


def hanging_scores_by_model(reads: DataFrame, models: DataFrame, model_keys: list[str], keys: list[str], pos: str, before: bool, w: int, step: int, r: float,
                            rate: str, origin: int = 1) -> DataFrame:
    """``keys, t, score`` as ``hanging_scores``, each read by the model of its library; one pass over all libraries.

    ``models`` has ``model_keys`` and ``delta, mu, sd`` and the hang rate named ``rate``; their terms are a table of
    ``delta - 1`` rows per library, made by columns.
    """
    dists = models.select(*model_keys, F.explode(F.sequence(F.lit(1), F.col("delta").cast("long") - 1)).alias("dist"), "mu", "sd", F.col(rate).alias("_p"))
    terms = small(dists.select(*model_keys, "dist", scaled(hanging_term_column(F.col("dist"), F.col("mu"), F.col("sd"), r, F.col("_p"))).alias("term")), MAX_TABLE_ROWS)
    both = list(dict.fromkeys([*keys, *model_keys]))
    at = reads.filter(F.col(pos).isNotNull()).groupBy(*both, F.col(pos).alias("_x")).agg(F.count("*").alias("_n"))
    at = at.join(models.select(*model_keys, F.col("delta").cast("long").alias("_d")), model_keys)
    lo, hi = (F.col("_x") + 1, F.col("_x") + F.col("_d") - 1) if before else (F.col("_x") - w - F.col("_d") + 1, F.col("_x") - w - 1)
    spread = at.withColumn("i0", F.greatest(first_window(lo, origin, step), F.lit(0))).withColumn("i1", last_window(hi, origin, step)).filter("i0 <= i1")
    spread = spread.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("t", F.col("i") * step + origin)
    dist = F.col("t") - F.col("_x") if before else F.col("_x") - (F.col("t") + w)
    return spread.withColumn("dist", dist).join(terms, [*model_keys, "dist"]).groupBy(*keys, "t").agg(F.sum(F.col("term") * F.col("_n")).alias("score"))


def _combine(parts: list[DataFrame], keys: list[str], names: list[str]) -> DataFrame:
    """Add up per-window parts, each giving one of ``names``; missing windows are zero."""
    rows = None
    for part, name in zip(parts, names):
        piece = part.select(*keys, "t", F.col("score").alias(name))
        rows = piece if rows is None else rows.unionByName(piece, allowMissingColumns=True)
    sums = {n: F.coalesce(F.sum(n), F.lit(0)) for n in names}
    return rows.groupBy(*keys, "t").agg(*[unscaled(c).alias(n) for n, c in sums.items()], unscaled(sum(sums.values(), F.lit(0))).alias("z"))


def _classed(pairs: DataFrame, keys: list[str], delta: int) -> DataFrame:
    """The classes of the pairs, written once, as three terms read them and mates would be joined for each."""
    return cut_lineage(pairs.select(*keys, "p_start", "m_start").withColumn("cls", pair_class(F.col("p_start"), F.col("m_start"), delta)))


def deletion_hanging_scan(pairs: DataFrame, keys: list[str], w: int, step: int, r: float, p: float, read_length: int, delta: int,
                          mu: float, sigma: float, origin: int = 1) -> DataFrame:
    """Straddling and hanging terms of a deletion scan per window.

    ``pairs`` has ``p_start, m_start`` with NULL for an unmapped end.  Windows
    are closed ``[t, t + w]``.
    """
    classed = _classed(pairs, keys, delta)
    star = classed.filter("cls = 'star'").select(
        *keys, (F.col("p_start") + read_length + 1).alias("start"),
        F.greatest(F.col("m_start") - 1, F.col("p_start") + read_length + 1).alias("end"), (F.col("m_start") - F.col("p_start")).alias("isize"),
    )
    il = to_windows(straddle_scores(star, keys, w + 1, w, step, r, mu, sigma, origin), keys, ["score"], step, origin)
    args = (w, step, delta, r, p, mu, sigma, origin)
    minus = hanging_scores(classed.filter("cls IN ('minus', 'both')"), keys, "p_start", True, *args)
    plus = hanging_scores(classed.filter("cls IN ('plus', 'both')"), keys, "m_start", False, *args)
    return _combine([minus, plus, il], keys, ["hang_minus", "hang_plus", "il_term"]).drop("z")


def insertion_scan(pairs: DataFrame, keys: list[str], w: int, step: int, r: float, p: float, read_length: int, max_insert: int,
                   mu: float, sigma: float, origin: int = 1) -> DataFrame:
    """Insertion scan: hanging reads on both sides of a point and pairs straddling it."""
    classed = _classed(pairs, keys, max_insert)
    star = classed.filter("cls = 'star'").select(
        *keys, (F.col("p_start") + read_length + 1).alias("start"),
        F.greatest(F.col("m_start") - 1, F.col("p_start") + read_length).alias("end"), (F.col("m_start") - F.col("p_start")).alias("isize"),
    )
    il = to_windows(straddle_scores(star, keys, 1, -w, step, r, mu, sigma, origin), keys, ["score"], step, origin)
    args = (0, step, max_insert, r, p, mu, sigma, origin)
    minus = hanging_scores(classed.filter("cls IN ('minus', 'both')"), keys, "p_start", True, *args)
    plus = hanging_scores(classed.filter("cls IN ('plus', 'both')"), keys, "m_start", False, *args)
    return _combine([minus, plus, il], keys, ["hang_minus", "hang_plus", "il_term"])


def call_peaks(track: DataFrame, keys: list[str], score: str, threshold: Column, step: int, min_gap: int = 1,
               tile: int = 100_000) -> DataFrame:
    """Maximal stretches of passing windows: ``keys, start, end, score, peak``.

    Each passing window stands for ``step`` bases; stretches closer than
    ``min_gap`` bases merge.  ``peak`` is the first window with the top score.
    """
    passing = track.filter(F.col(score) >= threshold).select(*keys, F.col("t").alias("start"), (F.col("t") + step - 1).alias("end"), F.col(score).alias("_s"))
    best = F.struct(F.col("_s").alias("score"), (-F.col("start")).alias("neg"))
    found = islands(passing.withColumn("_best", best), keys, "start", "end", min_gap, {"_best": ("max", F.col("_best"))}, tile)
    return found.select(*keys, "start", "end", F.col("_best.score").alias("score"), (-F.col("_best.neg")).alias("peak"))
