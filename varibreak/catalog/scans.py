"""Window scans and tracks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import constants as C
from .. import views
from ..functions.density import hanging_term, unscaled
from ..operators import changepoint, mates, scan, tracks
from .shared import PAIRS_SQL
from .registry import query

W, STEP, R, MU, SD = 100, 10, 0.5, 300.0, 60.0
P, DELTA, RL = 0.05, 600, 100
SCALE = f"{C.SCORE_SCALE}e0"


def ratio_sql(z: str, w: float) -> str:
    var = SD * SD
    return f"exp(({z} - {MU}e0) * CAST({w / var!r} AS DOUBLE) - CAST({w * w / (2.0 * var)!r} AS DOUBLE))"


def term_sql(z: str, w: float, r: float = R) -> str:
    return f"CAST(round(ln({1.0 - r}e0 + {r}e0 * {ratio_sql(z, w)}) * {SCALE}) AS BIGINT)"


FRAGS = """
frags AS (SELECT sample, chrom, pos + 100 AS start, pos + isize - 101 AS "end", isize FROM aln
  WHERE (flag & 1548) = 0 AND isize > 200 AND mchrom = chrom)"""


def fragments(spark, d):
    """The stretch between the two reads of every proper plus-strand pair."""
    reads = views.aln(spark, d).filter("(flag & 1548) = 0 AND isize > 200 AND mchrom = chrom")
    return reads.selectExpr("sample", "chrom", "pos + 100 AS start", "pos + isize - 101 AS end", "isize")


def windows_sql(start: str, end: str, w: int) -> str:
    return f"unnest(range(greatest(CAST(ceil(({start} - 1) / {STEP}e0) AS BIGINT), 0), CAST(floor(({end} - {w - 1} - 1) / {STEP}e0) AS BIGINT) + 1))"


def scores_sql(w_span: int, shift: int, name: str = "scores") -> str:
    return f"""{name} AS (SELECT sample, chrom, i * {STEP} + 1 AS t, sum(term) / {SCALE} AS score, count(*) AS n FROM (
    SELECT sample, chrom, {windows_sql('start', '"end"', w_span)} AS i, {term_sql('isize', shift)} AS term FROM frags) GROUP BY ALL)"""


def straddle_track(spark, d, shift: int):
    runs = scan.straddle_scores(fragments(spark, d), ["sample", "chrom"], W, shift, STEP, R, MU, SD)
    track = scan.to_windows(runs, ["sample", "chrom"], ["score", "n"], STEP, 1)
    return track.select("sample", "chrom", "t", unscaled(F.col("score")).alias("score"), "n")


@query("jn01_windows_within", "aln", FRAGS + f"""
SELECT sample, chrom, i * {STEP} + 1 AS t, count(*) AS n FROM (SELECT sample, chrom, {windows_sql('start', '"end"', W)} AS i FROM frags) GROUP BY ALL""")
def windows_within(spark, d):
    cut = scan.windows_within(fragments(spark, d), F.col("start"), F.col("end"), W, STEP, 1)
    return scan.to_windows(scan.window_sums(cut, ["sample", "chrom"], {"n": F.lit(1)}), ["sample", "chrom"], ["n"], STEP, 1)


@query("ag04_deletion_term", "aln", FRAGS + "," + scores_sql(W, W) + "\nSELECT sample, chrom, t, score, n FROM scores")
def deletion_term(spark, d):
    return straddle_track(spark, d, W)


@query("ag04_insertion_term", "aln", FRAGS + "," + scores_sql(W, -W) + "\nSELECT sample, chrom, t, score, n FROM scores")
def insertion_term(spark, d):
    return straddle_track(spark, d, -W)


def tail_table_sql() -> str:
    rows = ", ".join(f"({x}, {round(hanging_term(x, MU, SD, R, P) * C.SCORE_SCALE)})" for x in range(1, DELTA))
    return f"tail(dist, term) AS (VALUES {rows})"


def hanging_sql(left: bool) -> str:
    dist = "t - x" if left else f"x - (t + {W})"
    lo, hi = ("x + 1", f"x + {DELTA - 1}") if left else (f"x - {W + DELTA - 1}", f"x - {W + 1}")
    return f"""
hang AS (SELECT sample, chrom, pos AS x FROM aln WHERE (flag & 13) = 9 AND strand = '{'+' if left else '-'}'),
spread AS (SELECT sample, chrom, x, unnest(range(greatest(CAST(ceil(({lo} - 1) / {STEP}e0) AS BIGINT), 0), CAST(floor(({hi} - 1) / {STEP}e0) AS BIGINT) + 1)) * {STEP} + 1 AS t FROM hang),
{tail_table_sql()}
SELECT sample, chrom, t, sum(term) / {SCALE} AS score, count(*) AS n FROM spread JOIN tail ON dist = {dist} GROUP BY sample, chrom, t"""


def hanging_track(spark, d, left: bool):
    reads = views.aln(spark, d).filter(f"(flag & 13) = 9 AND strand = '{'+' if left else '-'}'")
    out = scan.hanging_scores(reads, ["sample", "chrom"], "pos", left, W, STEP, DELTA, R, P, MU, SD)
    return out.select("sample", "chrom", "t", unscaled(F.col("score")).alias("score"), "n")


@query("jn05_hanging_left", "aln", hanging_sql(True))
def hanging_left(spark, d):
    return hanging_track(spark, d, True)


@query("ag05_hanging_right", "aln", hanging_sql(False))
def hanging_right(spark, d):
    return hanging_track(spark, d, False)


PROPER = """
pp AS (SELECT sample, chrom, pos AS ps, pos + 99 AS pe, mpos AS ms, mpos + 99 AS me FROM aln WHERE (flag & 1548) = 0 AND isize > 0 AND mchrom = chrom)"""


def proper_pairs(spark, d):
    reads = views.aln(spark, d).filter("(flag & 1548) = 0 AND isize > 0 AND mchrom = chrom")
    return reads.selectExpr("sample", "chrom", "pos AS p_start", "pos + 99 AS p_end", "mpos AS m_start", "mpos + 99 AS m_end")


RATES = (0.25, 0.5)


def deletion_scan_sql() -> str:
    start, end = "pe + 1", "greatest(ms, pe + 2) - 1"
    over = f"unnest(range(greatest(CAST(ceil((s - {W - 1} - 1) / {STEP}e0) AS BIGINT), 0), CAST(floor((e - 1) / {STEP}e0) AS BIGINT) + 1))"
    return PROPER + f""",
rates(r) AS (VALUES {', '.join(f'({r}e0)' for r in RATES)}),
il AS (SELECT sample, chrom, r, i, sum(term) AS il FROM (SELECT sample, chrom, r, {windows_sql(start, end, W)} AS i,
    CAST(round(ln(1e0 - r + r * {ratio_sql(f'({end}) - ({start}) + 1', W)}) * {SCALE}) AS BIGINT) AS term FROM pp, rates) GROUP BY ALL),
ends AS (SELECT sample, chrom, ps AS s, pe AS e FROM pp UNION ALL SELECT sample, chrom, ms, me FROM pp),
cov AS (SELECT sample, chrom, r, i, n FROM (SELECT sample, chrom, i, count(*) AS n FROM (SELECT sample, chrom, {over} AS i FROM ends) GROUP BY ALL), rates)
SELECT sample, chrom, i * {STEP} + 1 AS t, r, coalesce(n, 0) * CAST(round(ln(1e0 - r) * {SCALE}) AS BIGINT) / {SCALE} AS cov_term, coalesce(il, 0) / {SCALE} AS il_term,
  (coalesce(n, 0) * CAST(round(ln(1e0 - r) * {SCALE}) AS BIGINT) + coalesce(il, 0)) / {SCALE} AS z
FROM cov FULL JOIN il USING (sample, chrom, r, i)"""


@query("st11_deletion_scan", "aln", deletion_scan_sql())
def deletion_scan(spark, d):
    out = scan.deletion_scan(proper_pairs(spark, d), ["sample", "chrom"], W, STEP, list(RATES), MU, SD)
    return out.select("sample", "chrom", "t", "r", "cov_term", "il_term", "z")


@query("ag06_coverage_term", "aln", PROPER + f""",
ends AS (SELECT sample, chrom, ps AS s, pe AS e FROM pp UNION ALL SELECT sample, chrom, ms, me FROM pp),
cov AS (SELECT sample, chrom, i, count(*) AS n FROM (SELECT sample, chrom, unnest(range(greatest(CAST(ceil((s - {W - 1} - 1) / {STEP}e0) AS BIGINT), 0), CAST(floor((e - 1) / {STEP}e0) AS BIGINT) + 1)) AS i FROM ends) GROUP BY ALL)
SELECT sample, chrom, i * {STEP} + 1 AS t, n, round(n * ln(0.5e0), 6) AS cov_term FROM cov""")
def coverage_term(spark, d):
    pairs = proper_pairs(spark, d)
    ends = pairs.selectExpr("sample", "chrom", "p_start AS s", "p_end AS e").unionByName(pairs.selectExpr("sample", "chrom", "m_start AS s", "m_end AS e"))
    counts = scan.window_counts(ends, ["sample", "chrom"], "s", "e", W, STEP)
    return counts.select("sample", "chrom", "t", "n", F.round(F.col("n") * math.log(0.5), 6).alias("cov_term"))


def hang_scan_sql(insertion: bool) -> str:
    gap = 0 if insertion else W
    shift, span = (-W, 1) if insertion else (W, W + 1)
    floor_end = "p_start + 100" if insertion else "p_start + 101"
    lo_p, hi_p = f"m_start - {gap + DELTA - 1}", f"m_start - {gap + 1}"
    rng = lambda lo, hi: f"unnest(range(greatest(CAST(ceil(({lo} - 1) / {STEP}e0) AS BIGINT), 0), CAST(floor(({hi} - 1) / {STEP}e0) AS BIGINT) + 1)) * {STEP} + 1"
    z = ", z" if insertion else ""
    return PAIRS_SQL + f""",
cls AS (SELECT *, m_start - p_start AS dd FROM pairs),
{tail_table_sql()},
minus AS (SELECT chrom, p_start AS x, {rng('p_start + 1', f'p_start + {DELTA - 1}')} AS t FROM cls WHERE p_start IS NOT NULL AND (m_start IS NULL OR dd > {DELTA} OR dd < 0)),
plus AS (SELECT chrom, m_start AS x, {rng(lo_p, hi_p)} AS t FROM cls WHERE m_start IS NOT NULL AND (p_start IS NULL OR dd > {DELTA} OR dd < 0)),
star AS (SELECT chrom, p_start + 101 AS s, greatest(m_start - 1, {floor_end}) AS e, dd FROM cls WHERE dd > 0 AND dd < {DELTA}),
sp AS (SELECT chrom, {windows_sql('s', 'e', span)} * {STEP} + 1 AS t, {term_sql('dd', shift)} AS term FROM star),
allp AS (SELECT chrom, t, term AS a, 0 AS b, 0 AS c FROM minus JOIN tail ON dist = t - x
  UNION ALL SELECT chrom, t, 0, term, 0 FROM plus JOIN tail ON dist = x - (t + {gap}) UNION ALL SELECT chrom, t, 0, 0, term FROM sp),
tot AS (SELECT chrom, t, sum(a) / {SCALE} AS hang_minus, sum(b) / {SCALE} AS hang_plus, sum(c) / {SCALE} AS il_term, sum(a + b + c) / {SCALE} AS z FROM allp GROUP BY chrom, t)
SELECT chrom, t, hang_minus, hang_plus, il_term{z} FROM tot"""


@query("st11_deletion_hanging_scan", "aln", hang_scan_sql(False))
def deletion_hanging_scan(spark, d):
    pairs = mates.map_positions(views.aln(spark, d), ["rid"])
    return scan.deletion_hanging_scan(pairs, ["chrom"], W, STEP, R, P, RL, DELTA, MU, SD)


@query("st11_insertion_scan", "aln", hang_scan_sql(True))
def insertion_scan(spark, d):
    pairs = mates.map_positions(views.aln(spark, d), ["rid"])
    return scan.insertion_scan(pairs, ["chrom"], W, STEP, R, P, RL, DELTA, MU, SD)


PEAK = 20.0
ISLANDS_SQL = """
p AS (SELECT *, t - lag(t) OVER (PARTITION BY sample, chrom ORDER BY t) AS d FROM scores WHERE score >= {b}),
g AS (SELECT *, sum(CASE WHEN d IS NULL OR d - {step} >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY t) AS gid FROM p)"""


@query("wn03_peaks", "aln", FRAGS + "," + scores_sql(W, W) + "," + ISLANDS_SQL.format(b=f"{PEAK}e0", step=STEP, gap=50) + f"""
SELECT sample, chrom, min(t) AS start, max(t) + {STEP - 1} AS "end", max(score) AS score, arg_max(t, (score, -t)) AS peak FROM g GROUP BY sample, chrom, gid""")
def peaks(spark, d):
    return scan.call_peaks(straddle_track(spark, d, W), ["sample", "chrom"], "score", F.lit(PEAK), STEP, min_gap=50)


@query("wn04_smoothed_runs", "aln", FRAGS + "," + scores_sql(W, W) + """,
p AS (SELECT sample, chrom, (t - 1) // 10 AS i FROM scores WHERE score >= 15e0),
q AS (SELECT *, i - lag(i) OVER (PARTITION BY sample, chrom ORDER BY i) AS d FROM p),
g AS (SELECT *, sum(CASE WHEN d IS NULL OR d - 1 > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY i) AS gid FROM q)
SELECT sample, chrom, min(i) * 10 + 1 AS start, max(i) * 10 + 1 AS "end" FROM g GROUP BY sample, chrom, gid HAVING max(i) - min(i) + 1 > 5""")
def smoothed_runs(spark, d):
    track = straddle_track(spark, d, W).filter("score >= 15").selectExpr("sample", "chrom", "(t - 1) div 10 AS i")
    return tracks.to_regions(tracks.smooth_runs(track, ["sample", "chrom"], "i", 3, 5), ["sample", "chrom"], 1, STEP)


@query("ev07_track_calls", "aln", FRAGS + "," + scores_sql(W, W) + """,
p AS (SELECT sample, chrom, (t - 1) // 10 AS i, score FROM scores WHERE score >= 12e0),
q AS (SELECT *, i - lag(i) OVER (PARTITION BY sample, chrom ORDER BY i) AS d FROM p),
g AS (SELECT *, sum(CASE WHEN d IS NULL OR d - 1 > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY i) AS gid FROM q)
SELECT sample, chrom, min(i) * 10 + 1 AS start, max(i) * 10 + 10 AS "end", 'DEL' AS svtype, 'lcd' AS method, max(score) AS score
FROM g GROUP BY sample, chrom, gid HAVING max(i) - min(i) + 1 > 10""")
def track_calls(spark, d):
    return tracks.call_track(straddle_track(spark, d, W), ["sample", "chrom"], "score", F.lit(12.0), STEP, 1, 100, 100, "DEL", "lcd")


@query("wn11_window_maximum", "aln", FRAGS + "," + scores_sql(W, W) + """
SELECT sample, chrom, t // 1000 AS bin, max(score) AS top, arg_max(t, (score, -t)) AS at FROM scores GROUP BY sample, chrom, t // 1000""")
def window_maximum(spark, d):
    return tracks.window_max(straddle_track(spark, d, W), ["sample", "chrom"], "score", 1000)


@query("st10_robust_threshold", "aln", FRAGS + "," + scores_sql(W, W) + """,
m AS (SELECT sample, quantile_cont(score, 0.5) AS med FROM scores GROUP BY sample),
a AS (SELECT s.sample, any_value(med) AS med, quantile_cont(abs(score - med), 0.5) AS mad FROM scores s JOIN m USING (sample) GROUP BY s.sample)
SELECT sample, round(med + 3e0 * mad * 1.4826e0, 6) AS threshold FROM a""")
def robust_threshold(spark, d):
    runs = scan.straddle_scores(fragments(spark, d), ["sample", "chrom"], W, W, STEP, R, MU, SD).withColumn("score", unscaled(F.col("score")))
    t = tracks.robust_threshold(runs, ["sample"], "score", 3.0, F.col("end") - F.col("start") + 1)
    return t.select("sample", F.round("threshold", 6).alias("threshold"))


@query("st10_block_threshold", "aln", FRAGS + "," + scores_sql(W, W) + """,
b AS (SELECT sample, t // 1000 AS blk, max(score) AS m FROM scores GROUP BY ALL)
SELECT sample, round(quantile_cont(m, 0.95), 6) AS threshold FROM b GROUP BY sample""")
def block_threshold(spark, d):
    t = tracks.block_threshold(straddle_track(spark, d, W), ["sample"], "score", STEP, 100, 0.05)
    return t.select("sample", F.round("threshold", 6).alias("threshold"))


RULES = scores_sql(W, W, "sd") + "," + scores_sql(W, -W, "si") + """,
trk AS (SELECT sample, chrom, t, coalesce(a.score, 0) AS lcd, coalesce(b.score, 0) AS lci, coalesce(a.n, 0) AS cvg FROM sd a FULL JOIN si b USING (sample, chrom, t))"""


@query("set05_track_algebra", "aln", FRAGS + "," + RULES + """,
f AS (SELECT chrom, t, bool_or(sample = 'case' AND (lcd >= 5e0 OR (lci >= 2e0 AND cvg >= 4))) AS pos,
  bool_or(sample = 'control' AND (lcd >= 5e0 OR (lci >= 2e0 AND cvg >= 4))) AS neg FROM trk GROUP BY chrom, t)
SELECT chrom, t FROM f WHERE pos AND NOT neg""")
def track_algebra(spark, d):
    """Rule ``lcd,lci+cvg`` per sample, then ``+1-2``: in the case and not in the control."""
    runs = scan.straddle_terms(fragments(spark, d), ["sample", "chrom"], W, {"lcd": W, "lci": -W}, STEP, R, MU, SD)
    score = {n: unscaled(F.col(n)) for n in ("lcd", "lci")}
    rule = tracks.rule_column("lcd,lci+cvg", {"lcd": score["lcd"] >= 5, "lci": score["lci"] >= 2, "cvg": F.col("n") >= 4})
    # all windows of a run share their values, so only windows that pass are made
    passing = scan.to_windows(runs.filter(rule), ["sample", "chrom"], [], STEP, 1)
    per = passing.groupBy("chrom", "t").agg(F.bool_or(F.col("sample") == "case").alias("one"), F.bool_or(F.col("sample") == "control").alias("two"))
    return per.filter(tracks.merge_column("+1-2", [F.col("one"), F.col("two")])).select("chrom", "t")


BINS_SQL = """
rd AS (SELECT sample, chrom, pos AS s, pos + 99 AS e FROM aln),
cnt AS (SELECT sample, chrom, bin, count(*) AS n FROM (SELECT sample, chrom, unnest(range((s - 1) // 1000, (e - 1) // 1000 + 1)) AS bin FROM rd) GROUP BY ALL),
bins AS (SELECT sample, chrom, g.bin, coalesce(n, 0) AS n FROM (SELECT sample, chrom, unnest(range(min(bin), max(bin) + 1)) AS bin FROM cnt GROUP BY sample, chrom) g LEFT JOIN cnt USING (sample, chrom, bin)),
sm AS (SELECT *, lag(n) OVER w AS p1, lead(n) OVER w AS n1, count(*) OVER (PARTITION BY sample, chrom) AS k FROM bins WINDOW w AS (PARTITION BY sample, chrom ORDER BY bin)),
med AS (SELECT *, CASE WHEN p1 IS NOT NULL AND n1 IS NOT NULL THEN (list_sort([p1, n, n1]))[2] END AS m FROM sm),
rm AS (SELECT sample, chrom, bin, n, CASE WHEN m IS NOT NULL THEN m WHEN k < 3 THEN n
    WHEN p1 IS NULL THEN (list_sort([n, lead(m) OVER w, 3 * lead(m) OVER w - 2 * coalesce(lead(m, 2) OVER w, lead(n, 2) OVER w)]))[2]
    ELSE (list_sort([n, lag(m) OVER w, 3 * lag(m) OVER w - 2 * coalesce(lag(m, 2) OVER w, lag(n, 2) OVER w)]))[2] END AS rm
  FROM med WINDOW w AS (PARTITION BY sample, chrom ORDER BY bin))"""


def coverage_bins(spark, d):
    reads = views.aln(spark, d).selectExpr("sample", "chrom", "pos AS start", "pos + 99 AS end")
    return tracks.coverage_bins(reads, ["sample", "chrom"], 1000)


@query("wn06_running_median", "aln", BINS_SQL + "\nSELECT sample, chrom, bin, n, rm FROM rm")
def running_median(spark, d):
    return tracks.running_median3(coverage_bins(spark, d), ["sample", "chrom"], "bin", "n", "rm")


@query("ev07_coverage_calls", "aln", BINS_SQL + """,
mean AS (SELECT sample, avg(n) AS mu FROM bins GROUP BY sample),
ty AS (SELECT sample, chrom, bin, CASE WHEN rm / mu < 0.9e0 THEN 'DEL' WHEN rm / mu > 1.1e0 THEN 'DUP' END AS svtype FROM rm JOIN mean USING (sample)),
q AS (SELECT *, bin - lag(bin) OVER (PARTITION BY sample, chrom, svtype ORDER BY bin) AS d FROM ty WHERE svtype IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom, svtype ORDER BY bin) AS gid FROM q)
SELECT sample, chrom, min(bin) * 1000 + 1 AS start, max(bin) * 1000 + 1000 AS "end", svtype, 'cvg' AS method FROM g GROUP BY sample, chrom, svtype, gid""")
def coverage_calls(spark, d):
    bins = tracks.running_median3(coverage_bins(spark, d), ["sample", "chrom"], "bin", "n", "rm")
    mean = coverage_bins(spark, d).groupBy("sample").agg(F.avg("n").alias("mu"))
    return tracks.call_coverage(bins.join(mean, "sample"), ["sample", "chrom"], "rm", F.col("mu"), 1000)


@query("cp01_running_counts", "aln", """
p AS (SELECT chrom, pos, count(*) FILTER (sample = 'case') AS cx, count(*) FILTER (sample <> 'case') AS cy FROM aln GROUP BY chrom, pos)
SELECT chrom, pos, CAST(sum(cx) OVER w AS BIGINT) AS x, CAST(sum(cy) OVER w AS BIGINT) AS y FROM p WINDOW w AS (PARTITION BY chrom ORDER BY pos)""")
def running_counts(spark, d):
    return changepoint.running_counts(views.aln(spark, d).select("chrom", "pos", (F.col("sample") == "case").alias("is_case")))


@query("ev07_change_points")
def change_points(spark, d):
    """Gains and losses of the case between change points (tested against a recursive search)."""
    reads = views.aln(spark, d).select("chrom", "pos", (F.col("sample") == "case").alias("is_case"))
    return changepoint.change_point_calls(changepoint.segments(reads), support=500)


@query("st10_bootstrap_threshold")
def bootstrap_threshold(spark, d):
    """Resampled thresholds of the deletion track (tested against plain resampling with the same draws)."""
    return tracks.bootstrap_threshold(straddle_track(spark, d, W), ["sample"], "score", STEP, 20, 0.05)
