import pytest
from tests.conftest import SMALL
from pyspark.sql import functions as F

from varibreak import views
from varibreak.config import ClipOptions, JoinOptions, ScanOptions, parse_sample_pairs
from varibreak.operators import breakends as be
from varibreak.operators import clips
from varibreak.operators.intervals import overlap_reduce
from varibreak.plans import pipelines

BND = "row long, chr1 string, pos1 long, goRight1 boolean, chr2 string, pos2 long, goRight2 boolean, cid string, mcid string"


def typed(spark, rows, reads=None, control=None):
    df = spark.createDataFrame([(i + 1, *r, f"c{i}", f"m{i}") for i, r in enumerate(rows)], BND)
    return {r["row"]: r for r in be.classify(df, 100, reads, control).collect()}


def test_inversion_pair(spark):
    got = typed(spark, [("a", 1000, False, "a", 5000, False), ("a", 1010, True, "a", 5020, True)])
    assert [got[1]["EventType"], got[2]["EventType"]] == ["INV", "INV"]
    assert (got[1]["Partner"], got[1]["EventStart"], got[1]["EventEnd"]) == (2, 1000, 5000)


@pytest.mark.parametrize("inverted,name", [(False, "TRA"), (True, "TRA.INV")])
def test_transposition_pair(spark, inverted, name):
    reads = spark.createDataFrame([("b", 100, 199)], "chrom string, start long, end long")
    rows = [("a", 1000, False, "b", 7000 if not inverted else 9000, not inverted), ("a", 1010, True, "b", 9000 if not inverted else 7000, inverted)]
    got = typed(spark, rows, reads)
    assert got[1]["EventType"] == got[2]["EventType"] == name
    assert (got[1]["DonorStart"], got[1]["DonorEnd"], got[1]["EventStart"], got[1]["EventEnd"]) == (7000, 9000, 1000, 1010)
    assert typed(spark, rows)[1]["EventType"] == name.replace("TRA", "DOM.INS")


def test_duplicated_donor(spark):
    mk = lambda n: spark.createDataFrame([("b", 7000 + i, 7099 + i) for i in range(n)], "chrom string, start long, end long")
    got = typed(spark, [("a", 1000, False, "b", 7000, True), ("a", 1010, True, "b", 9000, False)], mk(90), mk(40))
    assert got[1]["EventType"] == "INS.DUP" and got[1]["FoldChange"] == pytest.approx(90 / 41)


def test_single_breakends(spark):
    rows = [("a", 100, False, "a", 900, True), ("a", 2000, True, "a", 2900, False), ("a", 4000, False, "b", 4000, True), ("a", 6000, False, "a", 30000, True)]
    got = typed(spark, rows)
    assert [got[i]["EventType"] for i in (1, 2, 3, 4)] == ["DEL", "TANDEM.DUP", "INTERCHROMOSOMAL", None]


def test_later_pairs_overwrite_earlier_ones(spark):
    # row 2 is adjacent to row 1 (inversion) and to row 3; the later pair decides its type
    got = typed(spark, [("a", 1000, False, "a", 5000, False), ("a", 1010, True, "a", 5020, True), ("a", 1005, False, "a", 8000, True)])
    assert got[1]["EventType"] == "INV" and got[2]["Partner"] == 3


@pytest.fixture(scope="module")
def reads(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("aln"))
    views.aln(spark, SMALL).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_library_table(spark, reads):
    rows = pipelines.library_table(reads, views.contigs(spark, SMALL)).collect()
    assert len(rows) == 4 and all(r["rl"] == 100 and 200 < r["is"] < 420 for r in rows)


def test_planted_events_reach_the_calls(spark, reads):
    options = ClipOptions(min_reads=(3, 3), min_bases=(30, 30), hotspot=(20, 3), gap_distance=0)
    events, _ = pipelines.clip_events(reads, views.genome_tiles(spark, SMALL), None, 10.0, 100, options)
    rows = events.collect()
    dups = {(r["chr1"], r["pos1"]) for r in rows if r["EventType"] == "TANDEM.DUP"}
    assert ("chr3", 8001) in dups and ("chr4", 8001) in dups
    # the duplication at chr1:1601 is inherited: the control carries its other breakpoint, which therefore leaves the case
    control = clips.clip_clusters(reads.filter("sample = 'control'"), ["chrom"])
    assert control.filter("chrom = 'chr1' AND position = 2401 AND side = 'R'").count() == 1 and ("chr1", 1601) not in dups
    kinds = {r["EventType"] for r in rows}
    assert "TANDEM.DUP" in kinds and len(kinds - {None}) >= 2
    tracks = pipelines.scan_tracks(reads, ScanOptions(insert_size=300.0, insert_sd=60.0, prob_hang=0.05))
    saved = spark.createDataFrame([tuple(r) for r in rows], events.schema)
    raw, kept = pipelines.join_calls(reads, tracks, saved, 10, options=JoinOptions(tracks="track=lCd,thresh=level3,sup=20,gap=50_track=del,cvg=3"))
    raw_n, kept_n = raw.count(), kept.count()
    assert 0 < kept_n <= raw_n
    assert {"sclip"} <= {r["method"] for r in raw.select("method").distinct().collect()}
    assert tracks.filter(F.col("cvg") > 0).count() > 1000


def test_every_library_enters_the_scan_with_its_own_model(spark, reads):
    # the two libraries of the sample differ in their insert sizes
    half = F.when(F.col("rid") % 2 == 0, "one").otherwise("two") if dict(reads.dtypes)["rid"] == "bigint" else F.when(F.crc32(F.col("rid").cast("string").cast("binary")) % 2 == 0, "one").otherwise("two")
    two = reads.filter("sample = 'case'").withColumn("lib", half)
    model = "sample string, lib string, rl double, `is` double, sdR double, p_left double, p_right double"
    rows = {"one": ("case", "one", 100.0, 300.0, 40.0, 0.01, 0.02), "two": ("case", "two", 100.0, 350.0, 60.0, 0.03, 0.0)}
    table = lambda *names: spark.createDataFrame([rows[n] for n in names], model)
    options = ScanOptions(width=100, step=100, big_deletion=1000)
    score = lambda aln, libs: {(r["chrom"], r["t"]): (r["lCd"], r["lDl"], r["lDr"]) for r in pipelines.scan_libraries(aln, libs, options).collect()}
    both, one, other = score(two, table("one", "two")), score(two, table("one")), score(two, table("two"))
    assert both != one and both != other
    assert set(both) == set(one) | set(other)
    for at, got in both.items():
        want = [x + y for x, y in zip(one.get(at, (0, 0, 0)), other.get(at, (0, 0, 0)))]
        assert got == pytest.approx(want, abs=1e-6)


def test_one_library_is_scored_as_by_its_numbers(spark, reads):
    """The model in columns gives what the same model gives as numbers, and all libraries are one pass over the reads."""
    mine = reads.filter("sample = 'case' AND lib = 'lib1'")
    model = "sample string, lib string, rl double, `is` double, sdR double, p_left double, p_right double"
    libs = spark.createDataFrame([("case", "lib1", 100.0, 300.0, 40.0, 0.01, 0.02)], model)
    base = dict(width=100, step=50)
    plain = pipelines.scan_tracks(mine, ScanOptions(insert_size=300.0, insert_sd=40.0, prob_hang=0.01, prob_hang_right=0.02, read_length=100, **base)).collect()
    joined = {(r.chrom, r.t): r for r in pipelines.scan_libraries(mine, libs, ScanOptions(**base)).collect()}
    assert len(plain) == len(joined)
    for r in plain:
        other = joined[r.chrom, r.t]
        assert r.cvg == other.cvg and all(abs(r[c] - other[c]) < 1e-6 for c in ("lCd", "lCi", "lDl", "lDr"))
    fixed = pipelines.library_models(libs, ScanOptions(delta=700, big_deletion=900, prob_hang=0.3, insert_size=250.0, insert_sd=10.0, read_length=90)).first()
    assert (fixed.rl, fixed.mu, fixed.sd, fixed.p_left, fixed.p_right, fixed.delta, fixed.big) == (90, 250.0, 10.0, 0.3, 0.3, 700, 900)


@pytest.mark.parametrize("option,want", [(None, {(20099, 20502), (40099, 41402)}), (1200, {(40099, 41402)})])
def test_big_deletions_start_where_the_scan_leaves_pairs_out(spark, option, want):
    # library one has mean 300 and sd 50, so its limit is 450; library wide has the limit 1300
    cols = "rid long, sample string, lib string, chrom string, pos long, qwidth int, isize long, mchrom string, cigar string, flag int, seq string, mapq int"
    pairs = [("one", 20000, 602, 6), ("wide", 30000, 1100, 6), ("wide", 40000, 1502, 6), ("one", 50000, 449, 6)]
    rows = [(100 * k + i, "case", lib, "chr1", at, 100, size, "chr1", "100M", 99, "A" * 100, 60) for k, (lib, at, size, n) in enumerate(pairs) for i in range(n)]
    aln = spark.createDataFrame(rows, cols)
    libs = spark.createDataFrame([("case", "one", 300.0, 50.0), ("case", "wide", 1000.0, 100.0)], "sample string, lib string, `is` double, sdR double")
    raw, _ = pipelines.join_calls(aln, None, None, 10, options=JoinOptions(tracks="track=del,cvg=3"), libraries=libs, scan_options=ScanOptions(big_deletion=option))
    assert {(r["start"], r["end"]) for r in raw.filter("method = 'bigd'").collect()} == want


def test_options_per_sample():
    known = {"minmpr", "maxins"}
    assert parse_sample_pairs("minmpr=2,maxins=50:minmpr=5,maxins=60", known) == ({"minmpr": "2", "maxins": "50"}, {"minmpr": "5", "maxins": "60"})
    assert parse_sample_pairs("minmpr=2", known) == ({"minmpr": "2"}, {"minmpr": "2"})
    with pytest.raises(ValueError, match="unknown options"):
        parse_sample_pairs("minmp=2", known)


def test_fold_limits_are_used(spark):
    df = spark.createDataFrame([(1, "a", 100, False, "a", 900, True, "c", "m")], BND)
    assert be.classify(df, 100, None, min_length=500).first()["EventType"] is None


def test_positions_past_the_dyadic_levels_are_an_error(spark):
    far = spark.createDataFrame([("a", 2**31, 2**31 + 5)], "chrom string, start long, end long")
    with pytest.raises(Exception, match="dyadic"):
        overlap_reduce(far, far, ["chrom"], "start", "end", {"n": ("sum", F.lit(1))}).collect()
