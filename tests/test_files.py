import struct
import zlib

import pytest
from pyspark.sql import functions as F

from varibreak.sinks import vcf
from varibreak.sources import alignments, bam as bam_source, callers, tables

CODES = {b: i for i, b in enumerate(alignments.BASE_LETTERS)}


def bgzf(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, ops, seq, mate_pos, isize):
    packed = bytes(CODES[a] << 4 | CODES[b] for a, b in zip(seq[::2], (seq[1::2] + "=")[: len(seq[::2])]))
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 60, 0, len(ops), flag, len(seq), ref, mate_pos - 1, isize)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | alignments.CIGAR_LETTERS.index(o)) for n, o in ops) + packed + b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


@pytest.fixture(scope="module")
def bam(tmp_path_factory):
    """400 reads in small blocks, records crossing block borders, with an index of every fiftieth record."""
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2)
    for name, length in (("c1", 5000), ("c2", 9000)):
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    rows = [(f"r{i}", 99 if i % 2 else 147, i // 200, 10 + i, [(5, "S"), (15, "M")], "ACGTN" * 4, 40 + i, 50) for i in range(400)]
    blocks, places, data = [bgzf(head)], [], b""
    starts = []
    for row in rows:
        starts.append(len(data))
        data += record(*row)
    size, offsets, at = 700, {}, len(blocks[0])
    for b in range(0, len(data), size):
        block = bgzf(data[b : b + size])
        offsets[b // size] = at
        blocks.append(block)
        at += len(block)
    places = [(offsets[s // size] << 16) | s % size for s in starts]
    with open(path, "wb") as out:
        out.write(b"".join(blocks))
    linear = places[::50]
    with open(path + ".bai", "wb") as out:
        out.write(b"BAI\1" + struct.pack("<iii", 1, 0, len(linear)) + struct.pack(f"<{len(linear)}Q", *linear))
    return path, rows


def test_bam_reads_the_same_whole_or_split(spark, bam):
    path, rows = bam
    alignments.register(spark)
    want = sorted((r[0], r[1], f"c{r[2] + 1}", r[3], "5S15M", r[6], r[5], "-" if r[1] & 16 else "+") for r in rows)
    for split in (1, 2000, 1 << 30):
        df = spark.read.format("bam").option("splitBytes", split).load(path)
        got = sorted(tuple(r) for r in df.select("qname", "flag", "chrom", "pos", "cigar", "mpos", "seq", "strand").collect())
        assert got == want
    parts = bam_source.BamReader({"path": path, "splitBytes": "1"}, ["pos"]).partitions()
    assert len(parts) > 4


def test_sam_and_samples(spark, bam, tmp_path):
    path, _ = bam
    sam = tmp_path / "y.sam"
    sam.write_text("@SQ\tSN:c1\tLN:5000\nq\t163\tc1\t7\t60\t3S5M\t=\t90\t91\tACGTACGT\t*\nu\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    reads = alignments.read_sam(spark, str(sam)).collect()
    assert [(r["qname"], r["chrom"], r["mchrom"], r["strand"]) for r in reads] == [("q", "c1", "c1", "+"), ("u", None, None, None)]
    assert alignments.sam_contigs(spark, str(sam)).collect()[0]["length"] == 5000
    both = alignments.read_samples(spark, f"{sam}:{path}").groupBy("sample", "lib").count().collect()
    assert {(r["sample"], r["lib"]): r["count"] for r in both} == {("control", "y.sam"): 2, ("case", "x.bam"): 400}
    out = str(tmp_path / "aln")
    alignments.write_alignments(alignments.read_samples(spark, path), out)
    assert spark.read.parquet(out).filter("chrom = 'c2'").count() == 200


def test_fasta(spark, tmp_path):
    seq = "".join("ACGT"[i * 7 % 4] for i in range(205))
    lines = [seq[i : i + 30] for i in range(0, 205, 30)]
    text = ">one\nACGT\n>two\n" + "\n".join(lines) + "\n"
    fasta = tmp_path / "g.fa"
    fasta.write_text(text)
    (tmp_path / "g.fa.fai").write_text(f"one\t4\t5\t4\t5\ntwo\t205\t{text.index('>two') + 5}\t30\t31\n")
    alignments.register(spark)
    df = spark.read.format("fasta").option("tileBases", 50).option("tilesPerTask", 2).load(str(fasta))
    got = "".join(r["seq"] for r in df.filter("chrom = 'two'").orderBy("start").collect())
    assert got == seq and df.filter("chrom = 'one'").first()["seq"] == "ACGT"


def test_text_tables_and_vcf(spark, tmp_path):
    calls = spark.createDataFrame([("b", 50, 90, "DEL", "y"), ("a", 5, 9, "INV", "x")], "chrom string, start long, end long, svtype string, id string")
    vcf.write_vcf(vcf.call_records(calls), str(tmp_path / "v.vcf"), contigs=[("b", 1000), ("a", 500)])
    lines = (tmp_path / "v.vcf").read_text().splitlines()
    head = [line for line in lines if line.startswith("#")]
    assert head[0] == "##fileformat=VCFv4.1" and head[-1].startswith("#CHROM\tPOS") and lines[: len(head)] == head
    assert [line.split("\t")[0] for line in lines[len(head) :]] == ["b", "a"] and "##contig=<ID=b,length=1000>" in head
    back = tables.read_variants(spark, str(tmp_path / "v.vcf")).orderBy("chrom").collect()
    assert [(r["chrom"], r["start"], r["end"], r["len"], r["type"]) for r in back] == [("a", 5, 9, 4, "INV"), ("b", 50, 90, 40, "DEL")]
    vcf.write_bed(calls, str(tmp_path / "bed"), ["chrom", "start", "end"])
    assert tables.read_gaps(spark, str(tmp_path / "bed")).count() == 2
    vcf.write_typed_bed(calls, str(tmp_path / "typed"))
    assert (tmp_path / "typed" / "kind=del").exists()
    vcf.write_table(calls, str(tmp_path / "t"), gzip=True)
    assert tables.read_headed(spark, str(tmp_path / "t")).columns == calls.columns
    (tmp_path / "c.txt").write_text("# note\na\t1\n")
    assert tables.read_commented(spark, str(tmp_path / "c.txt"), "n string, v int").collect()[0]["v"] == 1
    assert tables.comment_lines(spark, str(tmp_path / "c.txt")).count() == 1


def test_mates_point_at_each_other(spark):
    b = spark.createDataFrame([("1", 5, True, "2", 9, False, "k")], "chr1 string, pos1 long, goRight1 boolean, chr2 string, pos2 long, goRight2 boolean, id string")
    rows = {r["ID"]: r for r in vcf.breakend_records(b).collect()}
    assert "MATEID=k_2" in rows["k_1"]["INFO"] and "MATEID=k_1" in rows["k_2"]["INFO"]
    assert rows["k_1"]["ALT"] == "]2:9]N" and rows["k_2"]["ALT"] == "N[1:5["


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError):
        callers.read_calls(spark.createDataFrame([("x",)], "value string"), "XX")


def test_breakdancer_junction_keeps_both_ends(spark):
    line = "c1\t100\t+\tc2\t900\t-\tCTX\t0"
    got = callers.read_calls(spark.createDataFrame([(line,)], "value string"), "BD").select("chrom", "start", "end", F.col("svtype")).collect()
    assert sorted(map(tuple, got)) == [("c1", 99, 100, "INS"), ("c2", 898, 899, "INS")]


def test_one_vcf_file_defines_every_key(spark, tmp_path):
    """Many sorted parts make one file, and its header knows all INFO keys that the record builders write."""
    rows = [(f"c{i % 3}", 5000 - i, 6000 + i, "DEL", f"id{i}", 0.5) for i in range(2000)]
    calls = spark.createDataFrame(rows, "chrom string, start long, end long, svtype string, id string, purity double").repartition(7)
    records = vcf.call_records(calls)
    events = spark.createDataFrame([(1, "c0", 10, "c0", 90, 2, "INV", 80, None, "k", "m"), (2, "c0", 12, "c0", 95, 1, "INV", 83, None, "m", "k"),
                                    (3, "c0", 10, "c1", 90, None, "INTERCHROMOSOMAL", None, None, "x", "y"), (4, "c0", 20, "c0", 40, 5, "INS.DUP", 20, 1.5, "p", "q")],
                                   "row long, chr1 string, pos1 long, chr2 string, pos2 long, Partner long, EventType string, Distance long, FoldChange double, cid string, mcid string")
    bnd = spark.createDataFrame([("c1", 5, True, "c2", 9, False, "k")], "chr1 string, pos1 long, goRight1 boolean, chr2 string, pos2 long, goRight2 boolean, id string")
    support = spark.createDataFrame([("k", 4)], "cid string, nreads long")
    path = str(tmp_path / "all.vcf")
    everything = records.unionByName(vcf.event_records(events, support)).unionByName(vcf.breakend_records(bnd))
    vcf.write_vcf(everything, path)
    lines = open(path).read().splitlines()
    body = [line.split("\t") for line in lines if not line.startswith("#")]
    assert len(body) == everything.count() and [(b[0], int(b[1])) for b in body] == sorted((b[0], int(b[1])) for b in body)
    known = {line.split("ID=")[1].split(",")[0] for line in lines if line.startswith("##INFO")}
    used = {part.split("=")[0] for b in body for part in b[7].split(";")}
    assert used <= known and {"NSCLIP", "FOLDCHANGE", "BNDNUM", "PARTNERID", "MATECHR", "MATEPOS", "SOMATIC", "PURITY", "MATEID"} <= used
    back = tables.read_variants(spark, path)
    assert back.filter("purity = 0.5").count() == 2000 and not list(tmp_path.glob("*.parts-*"))
    typed = vcf.genotype_records(records.limit(3), spark.createDataFrame([("id0", "0/1", 30.0, 12, 4990, 6010)], "ID string, gt string, gq double, dp int, Lbr long, Rbr long"), "s")
    vcf.write_vcf(typed, str(tmp_path / "g.vcf"))
    assert any(line.endswith("FORMAT\ts") for line in open(tmp_path / "g.vcf").read().splitlines()) and "##FORMAT=<ID=GQ" in open(tmp_path / "g.vcf").read()
    vcf.write_vcf(records.limit(0), str(tmp_path / "e.vcf"))
    assert open(tmp_path / "e.vcf").read().splitlines()[-1].startswith("#CHROM")
    bed = str(tmp_path / "conf.bed")
    vcf.write_bed(vcf.record_bed(records), bed, ["CHROM", "POS", "END", "ALT", "ID"])
    first = open(bed).readline().rstrip().split("\t")
    assert first == ["c0", "3002", "7998", "DEL", "id1998"]


def test_statistics_files_have_two_digits(spark, tmp_path):
    rows = [("case", "l1", 300.123, 0.0123, True, 5), ("case", "l2", 12.5, 0.5, False, None), ("control", "l1", None, 0.0, True, 7)]
    stats = spark.createDataFrame(rows, "sample string, lib string, mean double, rate double, ok boolean, n int")
    vcf.write_stat(stats, str(tmp_path / "s"))
    merged = [line.split("\t") for line in (tmp_path / "s.stat").read_text().splitlines()]
    assert merged[0] == stats.columns and merged[1][2:] == ["300", "0.012", "TRUE", "5"] and merged[3][2:] == ["NA", "0.000", "TRUE", "7"]
    assert (tmp_path / "s.case.l2.stat").read_text().splitlines()[1].split("\t")[3] == "0.5"
