"""Reads of regions, ranges to scan, tails, base codes, options, united evidence."""

import math
import random

import pytest
from pyspark.sql import functions as F

from varibreak.config import parse_pairs
from varibreak.functions import density, dna
from varibreak.operators import calls, regions


def test_reads_in_regions(spark):
    draw = random.Random(2)
    reads = [(i, draw.choice("ab"), draw.randrange(1, 60_000), draw.choice(["50M", "20M20000N30M", "10S40M5D", "*"]), draw.choice([0, 4])) for i in range(400)]
    asked = [("a", 16_000, 16_500), ("a", 16_384, 16_385), ("b", 1, 70_000), ("b", 30_000, 30_000), ("b", 30_000, 30_000)]
    size = {"50M": 50, "20M20000N30M": 20_050, "10S40M5D": 45, "*": 1}
    df = spark.createDataFrame(reads, "rid int, chrom string, pos long, cigar string, flag int")
    got = regions.reads_in_regions(df, spark.createDataFrame(asked, "chrom string, start long, end long")).collect()
    want = sorted((r[0], s, e) for r in reads for c, s, e in set(asked) if r[1] == c and r[2] <= e and r[2] + (1 if r[4] else size[r[3]]) - 1 >= s)
    assert sorted((r.rid, r.region_start, r.region_end) for r in got) == want and want


def test_scan_ranges(spark):
    contigs = spark.createDataFrame([(2, "c10", 500), (0, "c2", 900), (1, "x", 70)], "place int, chrom string, length long")
    get = lambda *a, **k: sorted(tuple(r) for r in regions.scan_ranges(contigs, *a, **k).collect())
    assert get("ALL") == [("c10", 1, 500), ("c2", 1, 900), ("x", 1, 70)] and get("a", first=2) == [("c2", 1, 900), ("x", 1, 70)]
    assert get("x,c10,none") == [("c10", 1, 500), ("x", 1, 70)] and get("c2", -5, 10**10) == [("c2", 1, 900)] and get("c2", 100, 200) == [("c2", 100, 200)]
    assert get("none") == []


def test_right_tail_column(spark):
    xs = [-900.0, 0.0, 250.0, 300.0, 301.0, 499.0, 699.9, 700.0, 701.0, 1200.0, 3000.0, None]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", density.right_tail_column(F.col("x"), 300, 100).alias("t")).collect()
    for r in got:
        assert r.t is None if r.x is None else math.isclose(r.t, density.right_tail(r.x, 300, 100), rel_tol=1e-9, abs_tol=1e-300)


def test_base_codes(spark):
    rows = spark.createDataFrame([("ACGTN",), ("acg",), ("",), ("=RYKMSWBDHV",), ("A*Z",)], "s string")
    got = [tuple(r) for r in rows.select("s", F.hex(dna.encode_bases(F.col("s"))), dna.decode_bases(dna.encode_bases(F.col("s")), F.length("s"))).collect()]
    assert got[0] == ("ACGTN", "1248F0", "ACGTN") and got[1][2] == "ACG" and got[2][1:] == ("", "") and got[3][2] == "=RYKMSWBDHV" and got[4][2] == "ANN"


def test_base_codes_of_any_text(spark):
    texts = ["".join(map(chr, range(128))), "EF09*\0z", "a\u00dfc", "\u00e9A", "\U0001f600G", None]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.p for r in rows.select(F.hex(dna.encode_bases(F.col("s"))).alias("p")).collect()]
    code = lambda c: f"{'=ACMGRSVTWYHKDBN'.find(c):X}" if c in "=ACMGRSVTWYHKDBN" else "F"
    want = ["".join(map(code, t.upper())) for t in texts[:-1]]
    assert got == [w + "0" * (len(w) % 2) for w in want] + [None]
    # an ASCII text is looked at letter by letter once, without the pattern
    plan = rows.select(dna.encode_bases(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan


def test_options_without_a_value_are_refused():
    assert parse_pairs("a=1,b=2") == {"a": "1", "b": "2"} and parse_pairs("") == {}
    for bad in ("minmpr:5", "word", "a=1,loose"):
        with pytest.raises(ValueError):
            parse_pairs(bad)


def test_evidence_is_united(spark):
    a, b = spark.createDataFrame([(1, 2)], "start int, end int"), spark.createDataFrame([(3, 4, 0.5)], "start int, end int, score double")
    assert sorted(map(tuple, calls.unite({"x": a, "y": b}).select("method", "start", "score").collect())) == [("x", 1, None), ("y", 3, 0.5)]
    with pytest.raises(ValueError):
        calls.unite({})
