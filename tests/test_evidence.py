"""Evidence that alone yields a call, methods of thresholds, resampled quantiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varibreak.config import JoinOptions, ScanOptions
from varibreak.operators import scan, thresholds, tracks
from varibreak.plans import pipelines

COLS = "rid long, sample string, lib string, chrom string, pos long, qwidth int, isize long, mchrom string, mpos long, cigar string, flag int, strand string, seq string, mapq int"
NOTHING = JoinOptions(tracks="track=del,cvg=3", big="minmpr=99,maxins=9", discordant="", change_point="", coverage="", hanging="", confirm="")


def read(i, pos, flag=99, mpos=0, cigar="100M", sample="case", isize=0):
    return (i, sample, "l", "c", pos, 100, isize, "c", mpos, cigar, flag, "-" if flag & 16 else "+", "A" * 100, 60)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def joined(aln, options, **kw):
    raw, _ = pipelines.join_calls(aln, None, None, 10, options=options, scan_options=ScanOptions(big_deletion=10**6, insert_size=300.0, insert_sd=30.0), **kw)
    return {(r.svtype, r.method): (r.start, r.end) for r in raw.collect()}


def only(**kw):
    return JoinOptions(**{**NOTHING.__dict__, **kw})


def test_each_evidence_alone_yields_a_call(spark):
    plain = [read(i, 100 + 50 * i, flag=67) for i in range(200)]
    turned = [read(1000 + i, 3000 + i, flag=1, mpos=5000 + i) for i in range(6)]  # both ends forward
    away = [read(1100 + i, 7000 + i, flag=17, mpos=8000 + i) for i in range(6)]  # reverse before forward
    hang = [read(1200 + i, 2000 + i, flag=9) for i in range(4)] + [read(1300 + i, 2300 + i, flag=25) for i in range(4)]
    base = frame(spark, plain)
    assert joined(base, NOTHING) == {}
    assert joined(frame(spark, plain + turned + away), only(discordant="minmpr=5,maxins=10000")) == {("INV", "disc"): (3104, 5000), ("DUP", "disc"): (7104, 8000)}
    assert joined(frame(spark, plain + turned[:4]), only(discordant="minmpr=5,maxins=10000")) == {}
    assert joined(frame(spark, plain + hang), only(hanging="width=250,minfwd=3,minrev=3")) == {("INS", "hax"): (2000, 2500)}
    deep = [read(2000 + i, 4000 + 10 * i, flag=67) for i in range(200)]
    got = joined(frame(spark, plain + deep), only(coverage="width=500,gap=0,sup=1"))
    assert ("DUP", "cvg") in got and got["DUP", "cvg"][0] in range(3501, 4502) and ("DEL", "cvg") in got
    control = [read(3000 + i, 100 + i, flag=67, sample="control") for i in range(0, 10_000, 3)]
    case = [read(9000 + i, 100 + i, flag=67) for i in range(0, 10_000, 3) if not 4000 <= i < 6000 or i % 15 == 0]
    got = joined(frame(spark, control + case), only(change_point="minstat=0,sup=500,gap=100,expand=0,good=4"))
    assert abs(got["DEL", "seqcbs"][0] - 4100) < 60 and abs(got["DEL", "seqcbs"][1] - 6100) < 60
    assert joined(frame(spark, control + case), only(change_point="minstat=0,sup=5000,gap=100,expand=0,good=4")) == {}
    assert joined(frame(spark, case), only(change_point="minstat=0")) == {}
    with pytest.raises(ValueError, match="unknown options"):
        joined(base, only(change_point="minstats=0"))


def test_small_deletions_need_their_share_of_reads(spark):
    rows = [read(i, 500, flag=67, cigar="50M4D50M") for i in range(6)] + [read(50 + i, 490, flag=67) for i in range(6)]
    at = lambda sup: joined(frame(spark, rows), only(tracks=f"track=del,cvg=5,sup={sup}"))
    assert at(50) == {("DEL", "cigar"): (550, 553)} and at(51) == {}


def test_methods_of_a_threshold(spark):
    rng = np.random.default_rng(3)
    rows = [("case", "c", 1 + 10 * i, float(v)) for i, v in enumerate(rng.exponential(1.0, 4000))]
    rows += [("case", "c", 20_001 + 10 * i, 60.0) for i in range(30)]
    score = spark.createDataFrame(rows, "sample string, chrom string, t long, lCd double").groupBy("sample", "chrom", "t").agg(F.max("lCd").alias("lCd"))
    for c in ("lCi", "lDl", "lDr"):
        score = score.withColumn(c, F.lit(0.0))
    libs = spark.createDataFrame([("case", "l", 100.0, 30.0, 300.0, 30.0, 30.0, 0.01, 0.01, True, True, True, False)],
                                 "sample string, lib string, rl double, cvg double, `is` double, sdR double, sdL double, p_left double, p_right double, lCd boolean, lCi boolean, lDl boolean, lDr boolean")
    options = ScanOptions(delta=500)
    margin = {}
    for method in ("robust", "empr", "boot", "theo"):
        held = pipelines._margin(score, ["lCd"], {"method": method, "thresh": "level2"}, 10, libs, options)
        margin[method] = held.select((F.col("lCd") - F.col("_s")).alias("t")).first().t
    assert margin["robust"] == margin["empr"] and len({round(v, 6) for v in margin.values()}) == 3 and all(0 < v < 1000 for v in margin.values())
    want = thresholds.threshold(0.01, score.count(), [thresholds.deletion_library(math.sqrt(30 / 200), 100, 0.5, 300, 30, 100, 100)])
    assert margin["theo"] == pytest.approx(want, abs=1e-9)
    held = pipelines._margin(score, ["lCd"], {"method": "value", "thresh": "7.5"}, 10, None, options)
    assert held.filter("_s >= 0").count() == score.filter("lCd >= 7.5").count()
    assert pipelines._margin(score, ["lDr", "lDl"], {"method": "theo"}, 10, libs, options).filter("_s >= 0").count() == 0  # no library is fit
    with pytest.raises(ValueError, match="unknown method"):
        pipelines._margin(score, ["lCd"], {"method": "guess"}, 10, libs, options)
    with pytest.raises(ValueError, match="library table"):
        pipelines._margin(score, ["lCd"], {"method": "theo"}, 10, None, options)


def test_theory_adds_the_fit_libraries():
    lib = {"rl": 100.0, "cvg": 20.0, "is": 300.0, "sdR": 30.0, "sdL": 30.0, "p_left": 0.01, "p_right": 0.02, "lCd": True, "lCi": False, "lDl": True, "lDr": True}
    one = thresholds.sample_thresholds([lib], 0.05, 1e6, 100, 0.5)
    two = thresholds.sample_thresholds([lib, lib], 0.05, 1e6, 100, 0.5)
    masked = thresholds.sample_thresholds([lib, {**lib, "lCd": False}], 0.05, 1e6, 100, 0.5)
    assert two["lCd"] != one["lCd"] == masked["lCd"] and one["lCi"] == math.inf and two["lDl"] != one["lDl"] != one["lDr"]


def test_resampled_threshold_repeats_and_matches_its_draws(spark):
    rng = np.random.default_rng(1)
    rows = [("s", 1 + 10 * i, float(round(v, 6))) for i, v in enumerate(rng.normal(size=3000))]
    df = spark.createDataFrame(rows, "sample string, t long, score double")
    make = lambda d, **k: tracks.bootstrap_threshold(d, ["sample"], "score", 10, 20, 0.1, **{"resample": 50, **k}).collect()
    [a], [b], [c] = make(df.repartition(7)), make(df.coalesce(1)), make(df, seed=7)
    assert a == b and a.threshold != c.threshold
    top = {}
    for _, t, v in rows:
        if (t // 200) % 2 == 0:
            top[t // 200] = max(top.get(t // 200, -9.0), v)
    values = np.array(list(top.values()))
    assert a.mean == pytest.approx(values.mean()) and a.sd == pytest.approx(values.std(ddof=1))
    spread = [np.quantile(rng.choice(values, len(values)), 0.9) for _ in range(500)]
    assert abs(a.threshold - np.mean(spread)) < 4 * np.std(spread) / math.sqrt(50) + 0.02


def test_terms_of_one_pass_and_thresholds_of_runs(spark):
    rng = random.Random(9)
    rows = [("a", s, s + rng.randrange(100, 700)) for s in (rng.randrange(1, 4000) for _ in range(80))]
    frags = spark.createDataFrame([(c, s, e, e - s + 201) for c, s, e in rows], "chrom string, start long, end long, isize long")
    one = lambda shift: scan.straddle_scores(frags, ["chrom"], 100, shift, 10, 0.5, 300.0, 60.0)
    windows = lambda runs, n: {(r.t, r[n], r.n) for r in scan.to_windows(runs, ["chrom"], [n, "n"], 10, 1).collect()}
    both = scan.straddle_terms(frags, ["chrom"], 100, {"up": 100, "down": -100}, 10, 0.5, 300.0, 60.0)
    assert windows(both, "up") == windows(one(100), "score") and windows(both, "down") == windows(one(-100), "score")
    track = scan.to_windows(one(100), ["chrom"], ["score"], 10, 1)
    width = F.col("end") - F.col("start") + 1
    assert tracks.robust_threshold(one(100), ["chrom"], "score", 3.0, width).collect() == tracks.robust_threshold(track, ["chrom"], "score", 3.0).collect()
