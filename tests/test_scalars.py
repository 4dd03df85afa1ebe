import math

import pytest
from pyspark.sql import functions as F

from varibreak import config
from varibreak.functions import cigar, density, discrete, dna, records


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "c string").select(fn(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [
    ("69M1D29M2S", (0, None, 98, 99, 2)),
    ("98M2S", (0, None, 98, 98, 2)),
    ("68M1I29M2S", (0, None, 97, 97, 2)),
    ("5H10S85M", (10, 0, 85, None, 0)),
    ("10S2I88M5S", (10, 90, 88, 88, 5)),
    ("10S50=40X", (10, 0, 90, None, 0)),
    ("100M", (0, None, 100, None, 0)),
    ("50I", (0, None, 0, None, 0)),
])
def test_soft_clip_tuple(spark, text, expected):
    assert tuple(one(spark, text, cigar.soft_clip)) == expected


def test_more_than_two_clips_is_null(spark):
    assert one(spark, "5S10M5S10M5S", cigar.soft_clip) is None


def test_indels_and_lengths(spark):
    assert [tuple(x) for x in one(spark, "20M2D30M1I49M", cigar.insertions)] == [(52, 1, 50)]
    assert [tuple(x) for x in one(spark, "3H5S10M2I4=7N1P3X2D1M6I", cigar.insertions)] == [(10, 2, 15), (27, 6, 25)]
    assert [tuple(x) for x in one(spark, "20M2D30M1I49M", cigar.deletions)] == [(20, 2, 20)]
    assert one(spark, "20M2D30M1I49M", cigar.aligned_length) == 100
    assert one(spark, "20M2D30M1I49M", lambda c: cigar.aligned_length(c, cigar.REFERENCE_LENGTH_CLASS)) == 101


@pytest.mark.parametrize("left,own,expected", [(True, True, 315), (True, False, 270), (False, True, 288), (False, False, 312)])
def test_imputed_isize(spark, left, own, expected):
    # left takes the head of the read and the tail of the mate (10 + 5), right the tail and the head (5 + 7)
    df = spark.createDataFrame([("10S85M5S", 300, "7S80M5S", 300 if own else (285 if left else 300))], "a string, i int, b string, j int")
    got = df.select(cigar.imputed_isize(F.col("i"), F.col("a"), F.col("j"), F.col("b"), left, own).alias("x")).first()["x"]
    assert got == expected


def test_dna(spark):
    assert one(spark, "AACGT", dna.reverse_complement) == "ACGTT"
    assert [one(spark, b, dna.base_code) for b in "AcGtN"] == [1, 2, 3, 4, 5]
    df = spark.createDataFrame([("ACGTACGT", "ACGTACGA"), ("ACGTACGT", "TCGTACGA"), ("ACG", "ACGT"), ("ACGTA", "ACGTA")], "a string, b string")
    assert [r[0] for r in df.select(dna.within_one_mismatch(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_density_closed_form(spark):
    f = lambda z: math.exp(-0.5 * ((z - 300) / 60) ** 2)
    got = spark.createDataFrame([(380,)], "z int").select(density.shifted_ratio(F.col("z"), 100, 300, 60)).first()[0]
    assert got == pytest.approx(f(280) / f(380))
    assert density.right_tail(300, 300, 60) == pytest.approx(0.5)


def test_discrete_quantiles():
    cdf = lambda k, rate: sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(k + 1))
    for rate in (0.5, 4.0, 30.0):
        k = discrete.poisson_quantile(0.2, rate)
        assert cdf(k, rate) >= 0.2 and (k == 0 or cdf(k - 1, rate) < 0.2)
    assert discrete.binomial_quantile(0.1, 20, 0.5) == 7
    assert discrete.min_insertion_reads(1.0) == 6


def test_info_and_alt(spark):
    info = "IMPRECISE;SVTYPE=DEL;CIEND=-5,5;END=90;SVLEN=-12;PURITY=0.35"
    assert one(spark, info, lambda c: records.info_value(c, "END")) == "90"
    assert one(spark, info, lambda c: records.info_value(c, "SVLEN")) == "-12"
    assert one(spark, info, lambda c: records.info_value(c, "HOMLEN")) is None
    assert one(spark, info, records.purity) == 0.35
    alt = lambda own, mate: one(spark, "N", lambda c: records.breakend_alt(F.lit("2"), F.lit(7), c, F.lit(own), F.lit(mate), F.lit("")))
    assert [alt(True, True), alt(True, False), alt(False, True), alt(False, False)] == ["[2:7[N", "]2:7]N", "N[2:7[", "N]2:7]"]


def test_option_languages():
    assert config.parse_pairs("minmpr=5,maxins=50000") == {"minmpr": "5", "maxins": "50000"}
    tracks = config.parse_tracks("track=lCd,sup=100_track=ins,cvg=5:track=del")
    assert tracks == [[{"track": "lCd", "sup": "100"}, {"track": "ins", "cvg": "5"}], [{"track": "del"}]]
    assert config.parse_rules("a:b,c+d") == [[["a"]], [["b"], ["c", "d"]]]
    assert config.parse_files("a,b:c") == [["a", "b"], ["c"]]
    assert config.parse_typed("x=y,z_2.5") == {"x": "y", "z": 2.5}
    assert config.parse_int_pair("10000:3") == (10000, 3)
    with pytest.raises(ValueError):
        config.ScanOptions(step=0)
