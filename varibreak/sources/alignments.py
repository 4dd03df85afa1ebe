"""Alignment and sequence files: SAM text, indexed FASTA, libraries of samples.

FASTA is a Python data source like BAM (``bam.py``): its index gives byte offsets, so one file is read by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bam, bgzf
from .bam import ALN_SCHEMA, BASE_LETTERS, CIGAR_LETTERS, read_bam, tag_value  # noqa: F401


def read_sam(spark: SparkSession, path: str, more: bool = False) -> DataFrame:
    """SAM text as the alignment schema; header lines are skipped.

    With ``more`` also ``qual``, ``tags``, ``rg`` and ``library`` (the LB of the read group).
    """
    f = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    none = lambda c, empty: F.when(c != empty, c)
    flag = at(1).cast("int")
    mate = F.when(at(6) == "=", at(2)).otherwise(at(6))
    added = []
    if more:
        fields = F.filter(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda x: F.length(x) > 4)
        tags = F.map_from_entries(F.transform(fields, lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, 4, 1 << 30))))
        added = [none(at(10), "*").alias("qual"), tags.alias("tags")]
    reads = f.select(
        at(0).alias("qname"), flag.alias("flag"), none(at(2), "*").alias("chrom"), at(3).cast("long").alias("pos"), at(4).cast("int").alias("mapq"),
        at(5).alias("cigar"), none(mate, "*").alias("mchrom"), at(7).cast("long").alias("mpos"), at(8).cast("int").alias("isize"), at(9).alias("seq"),
        F.length(at(9)).alias("qwidth"), F.when(flag.bitwiseAND(4) == 0, F.when(flag.bitwiseAND(16) != 0, "-").otherwise("+")).alias("strand"), *added,
    )
    if not more:
        return reads
    groups = sam_read_groups(spark, path).select("rg", "library")  # a row per header line
    return reads.withColumn("rg", tag_value(F.col("tags"), "RG")).join(F.broadcast(groups), "rg", "left")


def sam_read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``rg, library, sample`` from the ``@RG`` header lines."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@RG\t"))
    tag = lambda name: F.nullif(F.regexp_extract("value", f"\t{name}:([^\t]+)", 1), F.lit(""))
    return lines.select(tag("ID").alias("rg"), tag("LB").alias("library"), tag("SM").alias("sample")).filter("rg IS NOT NULL").dropDuplicates(["rg"])


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, length`` from the ``@SQ`` header lines."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@SQ"))
    tag = lambda name: F.regexp_extract("value", f"\t{name}:([^\t]+)", 1)
    return lines.select(tag("SN").alias("chrom"), tag("LN").cast("long").alias("length"))


@dataclass
class _Piece(InputPartition):
    path: str
    chrom: str
    first: int
    last: int
    length: int
    offset: int
    bases: int
    width: int


class _FastaReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = int(options.get("tileBases", 100_000))
        self.batch = int(options.get("tilesPerTask", 100))

    def partitions(self):
        parts = []
        with bgzf.open_input(self.path + ".fai") as index:
            for line in index.read().decode().splitlines():
                chrom, length, offset, bases, width = line.split("\t")[:5]
                tiles = -(-int(length) // self.size)
                parts += [
                    _Piece(self.path, chrom, t, min(t + self.batch, tiles), int(length), int(offset), int(bases), int(width))
                    for t in range(0, tiles, self.batch)
                ]
        return parts

    def read(self, p):
        place = lambda base: p.offset + base // p.bases * p.width + base % p.bases
        with bgzf.open_input(p.path) as handle:
            for tile in range(p.first, p.last):
                lo, hi = tile * self.size, min((tile + 1) * self.size, p.length)
                handle.seek(place(lo))
                text = handle.read(place(hi) - place(lo)).translate(None, b"\r\n")
                yield p.chrom, lo + 1, text.decode().upper()


class FastaSource(DataSource):
    """``spark.read.format("fasta").load("ref.fa")``: ``chrom, start, seq`` pieces; needs ``ref.fa.fai``."""

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return "chrom string, start long, seq string"

    def reader(self, schema):
        return _FastaReader(self.options)


def register(spark: SparkSession) -> None:
    bam.register(spark)
    spark.dataSource.register(FastaSource)


def read_samples(spark: SparkSession, text: str, by_read_group: bool = False) -> DataFrame:
    """Libraries named ``control1,control2:case1,case2``: BAM, SAM or Parquet by file name.

    Libraries of a sample are separated by commas, samples by colons; the last
    sample is the case.  Adds ``sample`` and ``lib``: the file name, or with ``by_read_group`` the
    library of a read's group where it has one, so that one file may hold several libraries.
    """
    register(spark)
    groups = text.split(":")
    out = None
    for g, group in enumerate(groups):
        sample = "case" if g == len(groups) - 1 else "control" if len(groups) == 2 else f"control{g + 1}"
        for path in group.split(","):
            if path.endswith(".sam"):
                part = read_sam(spark, path, more=by_read_group)
            elif path.endswith(".bam"):
                part = read_bam(spark, path, [*(c.split()[0] for c in ALN_SCHEMA.split(", ")), *(["library"] if by_read_group else [])])
            else:
                part = spark.read.parquet(path)
            file = F.lit(path.rsplit("/", 1)[-1])
            lib = F.coalesce("library", file) if by_read_group and "library" in part.columns else file
            part = part.withColumn("sample", F.lit(sample)).withColumn("lib", lib).drop("qual", "tags", "rg", "library")
            if "rid" not in part.columns:
                part = part.withColumn("rid", F.md5(F.concat_ws("_", "lib", "qname", F.col("flag").cast("string"), "chrom", F.col("pos").cast("string"), "cigar")))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_alignments(aln: DataFrame, path: str) -> None:
    """Parquet partitioned by chromosome and sorted by position, so region scans prune files and row groups."""
    aln.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.mode("overwrite").partitionBy("chrom").parquet(path)
