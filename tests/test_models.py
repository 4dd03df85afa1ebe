import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import simulate
from varibreak.operators import libstats, match, scan
from varibreak.operators import thresholds as th


def test_threshold_has_the_asked_error_rate():
    libs = [th.deletion_library(0.3, 100, 0.5, 300, 60, 100, 100), th.deletion_library(0.2, 100, 0.5, 350, 50, 100, 100)]
    for alpha in (0.01, 0.1):
        b = th.threshold(alpha, 1e5, libs)
        assert th.p_value(b, 1e5, libs) == pytest.approx(alpha, rel=1e-4)
    hang = [th.hanging_library(0.5, 0.05, 0.05 * 0.09, 300, 60, 600, 100)]
    assert th.threshold(0.01, 1e5, hang) > th.threshold(0.1, 1e5, hang) > hang[0].dpsi(0.0)
    ins = [th.insertion_library(0.3, 100, 0.5, 300, 60, 100, 100)]
    assert th.p_value(th.threshold(0.05, 1e5, ins), 1e5, ins) == pytest.approx(0.05, rel=1e-4)
    assert th.threshold(0.1, 1e5, []) == 0.0


def test_slopes_are_derivatives():
    for lib in (th.deletion_library(0.3, 100, 0.5, 300, 60, 100, 100), th.hanging_library(0.5, 0.05, 0.004, 300, 60, 600, 100)):
        h = 1e-5
        assert (lib.psi(0.7 + h) - lib.psi(0.7 - h)) / (2 * h) == pytest.approx(lib.dpsi(0.7), rel=1e-6)


def sizes(spark, values):
    rows = [("s", "l", int(v), 3) for v in values]
    return spark.createDataFrame(rows, "sample string, lib string, isize int, flag int")


def test_library_scenarios(spark):
    rng = np.random.default_rng(1)
    stray = np.rint(rng.uniform(size=200) * 1e6)
    nice = np.rint(np.concatenate([rng.normal(300, 40, 20000), stray]))
    heavy = np.concatenate([nice, np.rint(rng.uniform(size=5000) * 90)])
    two = np.concatenate([np.rint(rng.normal(300, 30, 10000)), np.rint(rng.normal(600, 30, 10000))])
    got = [libstats.library_parameters(sizes(spark, v), ["sample", "lib"]).first() for v in (nice, heavy, two)]
    assert got[0]["is"] == pytest.approx(300, abs=8) and got[0]["good_for_insertion"]
    assert got[0]["sdR"] == pytest.approx(40, rel=0.2) or got[0]["sdR"] > 40
    assert not got[1]["good_for_insertion"]
    assert got[2]["is"] == pytest.approx(600, abs=8) and not got[2]["good_for_insertion"]


def test_matches_equal_brute_force(spark):
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(1500))
    pieces = spark.createDataFrame([("c", s + 1, seq[s : s + 37]) for s in range(0, 1500, 37)], "chrom string, start long, seq string")
    pats = {}
    for n in range(12):
        at = rng.randrange(1400)
        p = list(seq[at : at + 30 + n])
        for _ in range(n % 3):
            i = rng.randrange(len(p))
            p[i] = rng.choice([b for b in "ACGT" if b != p[i]])
        pats[f"p{n}"] = "".join(p)
    tiles = match.reference_tiles(pieces, 200, 100)
    assert "".join(r["seq"][:200] for r in tiles.orderBy("tile").collect()) == seq
    got = match.find_matches(spark.createDataFrame(list(pats.items()), "pid string, pattern string"), tiles, 200)
    want = {(k, i + 1) for k, p in pats.items() for i in range(1500 - len(p) + 1) if sum(a != b for a, b in zip(p, seq[i : i + len(p)])) <= 1}
    assert {(r["pid"], r["mstart"]) for r in got.collect()} == want
    asked = spark.createDataFrame([(700, seq[690:725], "c"), (40, seq[10:45], "c"), (700, "A" * 35, "c")], "center long, pat string, chrom string")
    wide = match.reference_tiles(pieces, 200, 301)
    homes = match.count_in_window(asked, wide, 200, "center", "pat", 100).collect()
    assert sorted((r["center"], r["n_remap"], r["remap_at"]) for r in homes if r["n_remap"]) == [(40, 1, 72), (700, 1, 92)]  # 11 - (-60) + 1 and 691 - 600 + 1


def test_simulated_deletion_is_found(spark):
    pairs = simulate.simulate_pairs(spark, 40_000, 6_000, 300, 30, "deletion", at=20_000, size=200, mix=0.5)
    reads = pairs.filter("p_start IS NOT NULL AND m_start IS NOT NULL").withColumn("chrom", F.lit("c")).select(
        "chrom", "p_start", (F.col("p_start") + 99).alias("p_end"), "m_start", (F.col("m_start") + 99).alias("m_end"))
    track = scan.deletion_scan(reads, ["chrom"], 200, 10, [0.5], 200.0, 30.0)
    top = track.orderBy(F.desc("il_term")).first()
    assert abs(top["t"] - 20_000) <= 60
    inserted = simulate.simulate_pairs(spark, 20_000, 2_000, 300, 30, "insertion", at=10_000, size=150)
    assert inserted.filter("p_start IS NULL OR m_start IS NULL").count() > 5


def test_spike(spark):
    pieces = spark.createDataFrame([("c", 1, "AAAA"), ("c", 5, "CCCC"), ("c", 9, "GGGG")], "chrom string, start long, seq string")
    glue = lambda df: "".join(r["seq"] for r in df.orderBy("start").collect())
    assert glue(simulate.spike_variant(pieces, "c", 3, 4)) == "AAACGGGG"
    assert glue(simulate.spike_variant(pieces, "c", 6, 0, "TT")) == "AAAACCTTCCGGGG"


def test_window_occurrences_at_the_edges(spark):
    tiles = match.reference_tiles(spark.createDataFrame([("c", 1, "ACGTACGTTT")], "chrom string, start long, seq string"), 8, 41)
    asked = spark.createDataFrame([(1, "c", 3, "ACGT"), (2, "c", 3, "ACGTACGTTTACGT"), (3, "d", 3, "ACGT"), (4, "c", 3, None), (5, "c", 9, "CCCCC")], "id int, chrom string, center long, pat string")
    found = match.count_in_window(asked, tiles, 8, "center", "pat", 20)
    assert {r.id: (r.n_remap, r.remap_at) for r in found.collect()} == {1: (2, 19), 2: (0, None), 3: (0, None), 4: (0, None), 5: (0, None)}
    # offsets are counted in batches of rows, not one by one in an expression
    assert "ArrowEvalPython" in found._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("word", [4, 18, 19])
def test_repeated_words_of_any_letters(spark, word):
    rng = random.Random(word)
    unit = "".join(rng.choice("ACGTN") for _ in range(60))
    texts = {"c": "A" * 40 + unit + "0123acgtNNNN" * 6 + unit, "d": "".join(rng.choice("ACGT") for _ in range(300)), "e": "ACG"}
    pieces = spark.createDataFrame([(c, 1, t) for c, t in texts.items()], "chrom string, start long, seq string")
    found = match.repeated_words(match.reference_tiles(pieces, 32, word - 1), 32, word)
    want = []
    for chrom, text in texts.items():
        places = {}
        for i in range(len(text) - word + 1):
            places.setdefault(text[i:i + word], []).append(i + 1)
        want += [(chrom, k, len(v), v[0], v[-1]) for k, v in places.items() if len(v) > 1]
    assert sorted(tuple(r) for r in found.select("chrom", "kmer", "n", "first_at", "last_at").collect()) == sorted(want)
    # words of the four letters travel as numbers
    assert word > 18 or "_code" in found._jdf.queryExecution().optimizedPlan().toString()
