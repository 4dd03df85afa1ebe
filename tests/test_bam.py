"""BAM: written, indexed, read back whole and by region; tags, libraries, filters, damaged files."""

import random

import pytest
from pyspark.sql import functions as F

from varibreak.sources import alignments, bam, bgzf
from varibreak.sources.bai import Index, bin_of, bins_over

CONTIGS = [("c2", 400_000), ("c10", 90_000), ("empty", 1000)]
HEADER = "@RG\tID:a\tLB:libA\tSM:s1\n@RG\tID:b\tLB:libB\tSM:s1\n@CO\tnote"
SCHEMA = "qname string, flag int, chrom string, pos long, mapq int, cigar string, mchrom string, mpos long, isize int, seq string, qual string, tags map<string,string>"


def make_reads(n=3000):
    draw = random.Random(4)
    rows = []
    for i in range(n):
        chrom, length = draw.choice(CONTIGS[:2])
        cigar = draw.choice(["50M", "10S40M", "20M5I25M", "20M3D30M", "15M9000N35M", "5H50M", "25=1X24M2P", "*"])
        seq = "".join(draw.choice("ACGTN") for _ in range(50 if cigar != "25=1X24M2P" else 50))
        flag = 4 | 1 if cigar == "*" else draw.choice([99, 147, 83, 163, 1024 + 99])
        tags = {"RG": f"Z:{draw.choice('ab')}", "NM": f"i:{draw.choice([0, 3, 200, 40_000, -5, 3_000_000_000])}"}
        if i % 3 == 0:
            tags |= {"XA": "A:q", "XF": "f:0.5", "XB": "B:s,1,-2,300", "XH": "H:1AE3", "XC": "B:f,0.25"}
        if i % 11 == 0:
            del tags["RG"]
        qual = None if i % 5 == 0 else "".join(chr(33 + draw.randrange(60)) for _ in range(50))
        pos = 777 if i % 3 == 1 else draw.randrange(1, length - 200)  # a third of all reads at one place
        rows.append((f"r{i}", flag, chrom, pos, draw.randrange(61), cigar, draw.choice(["c2", "c10", None]), draw.randrange(1, 90_000), draw.randrange(-500, 500), seq, qual, tags))
    rows += [(f"u{i}", 77, None, 0, 0, "*", None, 0, 0, "ACG" if i else "", None, {}) for i in range(9)]
    return rows


def span(row):
    taken = 0
    for n, o in bam.CIGAR_PART.findall(row["cigar"]):
        taken += int(n) if o in "MDN=X" else 0
    return row["pos"], row["pos"] + max(taken if not row["flag"] & 4 else 0, 1) - 1


def plain(rows):
    return sorted((r["qname"], r["flag"], r["chrom"], r["pos"], r["mapq"], r["cigar"], r["mchrom"], r["mpos"], r["isize"], r["seq"], r["qual"], tuple(sorted(r["tags"].items()))) for r in rows)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "two.bam")
    reads = spark.createDataFrame(make_reads(), SCHEMA)
    bam.write_bam(reads, path, CONTIGS, HEADER, parts=5)
    return path, reads.collect()


COLUMNS = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "m").split(", ")]


def test_written_file_reads_back(spark, written):
    path, rows = written
    for split in (1, 20_000, None):
        back = bam.read_bam(spark, path, COLUMNS, split_bytes=split)
        assert plain(back.collect()) == plain(rows)
    order = [(r.chrom, r.pos) for r in bam.read_bam(spark, path, ["chrom", "pos"]).collect()]
    places = {"c2": 0, "c10": 1, None: 2}
    assert order == sorted(order, key=lambda k: (places[k[0]], k[1]))
    assert not [p for p in __import__("os").listdir(path.rsplit("/", 1)[0]) if "parts" in p]
    contigs = {r.chrom: r for r in bam.bam_contigs(spark, path).collect()}
    mapped = [r for r in rows if not r.flag & 4]
    assert [contigs[c].place for c, _ in CONTIGS] == [0, 1, 2] and contigs["empty"].mapped == 0
    assert all(contigs[c].mapped == sum(r.chrom == c for r in mapped) for c in ("c2", "c10"))
    assert all(contigs[c].unmapped == sum(r.chrom == c and r.flag & 4 > 0 for r in rows) for c in ("c2", "c10"))


def scanned(path, **options):
    reader = bam.BamReader({"path": path, **options}, ["pos"])
    size = bgzf.size_of(path)
    return sum(((s.stop >> 16) if s.stop else size) - (s.start >> 16) + 1 for s in reader.partitions()), size


def test_region_scan_is_exact_and_reads_little(spark, written):
    path, rows = written
    for region in ("c2:777-777", "c2:778-790", "c10:50,000-50,200", "c10:60000", "c2", "empty", "none:5-6", "c2:399000-500000", "c2:1-30000"):
        chrom, start, end = bam.parse_region(region)
        got = sorted((r.qname, r.end) for r in bam.read_bam(spark, path, ["qname", "end"], [region]).collect())
        want = sorted((r.qname, span(r)[1]) for r in rows if r.chrom == chrom and span(r)[0] <= end and span(r)[1] > start)
        assert got == want, region
    assert any(span(r)[0] < 1000 <= span(r)[1] for r in rows if r.chrom == "c2")  # reads that begin before a region
    both = bam.read_bam(spark, path, ["qname"], ["c2:100000-150000", "c2:140000-160000", "c10:1-300"]).collect()
    assert len(both) == len(set(both))
    part, size = scanned(path, regions="c2:200000-210000")
    assert part < size / 4
    assert scanned(path, regions="empty")[0] == 0
    for bad in ("c2:9-3", "c2:0-5", ""):
        with pytest.raises(ValueError):
            bam.parse_region(bad)


def test_filters_narrow_the_scan(spark, written):
    path, rows = written
    df = bam.read_bam(spark, path, ["qname", "chrom", "pos"])
    cond = (F.col("chrom") == "c2") & (F.col("pos") > 300_000) & (F.col("pos") <= 320_000)
    assert df.filter(cond).count() == sum(r.chrom == "c2" and 300_000 < r.pos <= 320_000 for r in rows)
    assert df.filter(F.col("chrom").isin("c10", "empty")).count() == sum(r.chrom == "c10" for r in rows)
    assert df.filter("chrom = 'c2' AND chrom = 'c10'").count() == 0
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reader = bam.BamReader({"path": path}, ["pos"])
    given = [EqualTo(("chrom",), "c2"), GreaterThan(("pos",), 300_000), LessThanOrEqual(("pos",), 320_000)]
    assert list(reader.pushFilters(given)) == given
    assert reader._wanted(bam.bam_header(path)) == [(0, 300_000, 320_000)]
    assert sum((s.stop >> 16) - (s.start >> 16) + 1 for s in reader.partitions()) < bgzf.size_of(path) / 4


def test_libraries_of_one_file(spark, written, tmp_path):
    path, rows = written
    names = {"Z:a": "libA", "Z:b": "libB", None: None}
    want = {}
    for r in rows:
        want[names[r.tags.get("RG")]] = want.get(names[r.tags.get("RG")], 0) + 1
    got = bam.read_bam(spark, path, ["qname", "chrom", "pos", "library"])
    assert {r.library: r["count"] for r in got.groupBy("library").count().collect()} == want
    bam.split_libraries(got, str(tmp_path / "libs"))
    back = spark.read.parquet(str(tmp_path / "libs"))
    assert {r.library: r["count"] for r in back.groupBy("library").count().collect()} == {k or "unknown": n for k, n in want.items()}
    by_lib = alignments.read_samples(spark, path, by_read_group=True).groupBy("lib").count().collect()
    assert {r.lib: r["count"] for r in by_lib} == {k or "two.bam": n for k, n in want.items()}
    assert sorted(map(tuple, bam.bam_read_groups(spark, path).collect())) == [("a", "libA", "s1"), ("b", "libB", "s1")]
    tagged = bam.read_bam(spark, path, ["tags"]).select(bam.tag_value(F.col("tags"), "NM").alias("nm"))
    assert {r.nm for r in tagged.distinct().collect()} == {"0", "3", "200", "40000", "-5", "3000000000", None}


def test_sam_tags_and_libraries(spark, tmp_path):
    sam = tmp_path / "x.sam"
    sam.write_text("@RG\tID:a\tLB:libA\nq\t0\tc\t5\t9\t3M\t*\t0\t0\tACG\t!!!\tRG:Z:a\tNM:i:4\nw\t0\tc\t5\t9\t3M\t*\t0\t0\tACG\t*\n")
    rows = {r.qname: r for r in alignments.read_sam(spark, str(sam), more=True).collect()}
    assert rows["q"].tags == {"RG": "Z:a", "NM": "i:4"} and rows["q"].library == "libA" and rows["q"].qual == "!!!"
    assert rows["w"].tags == {} and rows["w"].library is None and rows["w"].qual is None


def test_parts_stay_whole_files(spark, written, tmp_path):
    path, rows = written
    folder = str(tmp_path / "parts")
    bam.write_bam(spark.createDataFrame(make_reads(), SCHEMA), folder, CONTIGS, HEADER, single=False, parts=4)
    files = sorted(f for f in __import__("os").listdir(folder) if f.endswith(".bam"))
    joined = ",".join(f"{folder}/{f}" for f in files)
    assert len(files) > 1 and plain(bam.read_bam(spark, joined, COLUMNS).collect()) == plain(rows)
    region = bam.read_bam(spark, joined, ["qname"], ["c2:1-900"]).count()
    assert region == bam.read_bam(spark, path, ["qname"], ["c2:1-900"]).count() > 0


def test_unsorted_and_damaged_files_fail(spark, written, tmp_path):
    path, _ = written
    spark.dataSource.register(bam.BamSource)
    rows = spark.createDataFrame(make_reads(50), SCHEMA).orderBy(F.desc("pos")).coalesce(1)
    with pytest.raises(Exception, match="not sorted"):
        rows.write.format("bam").mode("overwrite").option("contigs", "c2:9,c10:9").save(str(tmp_path / "bad.bam"))
    data = open(path, "rb").read()
    for name, cut in (("cut", data[: len(data) // 2]), ("junk", data[:9000] + b"junk" + data[9004:])):
        (tmp_path / f"{name}.bam").write_bytes(cut)
        with pytest.raises(Exception):
            bam.read_bam(spark, str(tmp_path / f"{name}.bam"), COLUMNS).collect()
    empty = str(tmp_path / "none.bam")
    bam.write_bam(spark.createDataFrame([], SCHEMA), empty, CONTIGS)
    assert bam.read_bam(spark, empty).count() == 0 and bam.read_bam(spark, empty, regions=["c2"]).count() == 0


def test_bins():
    draw = random.Random(1)
    for _ in range(2000):
        a = draw.randrange(1 << 29)
        b = min(1 << 29, a + draw.choice([1, 50, 20_000, 3_000_000, 1 << 28]))
        if b > a:
            assert bin_of(a, b) in bins_over(a, b) and bin_of(a, b) in bins_over(b - 1, b) and 0 <= bin_of(a, b) <= 37448
    assert bin_of(0, 1) == 4681 and bin_of(0, 1 << 29) == 0 and bin_of(16383, 16385) == 585
    index = Index.empty(2)
    index.contigs[1].add(5, 40_000, 100 << 16, 100 << 16 | 50, True)
    index.unplaced = 7
    again = Index.parse(index.serialize())
    assert again == index and again.contigs[0].chunks(0, 9) == [] and again.contigs[1].chunks(39_000, 39_001) == [(100 << 16, 100 << 16 | 50)]
