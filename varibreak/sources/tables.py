"""Text tables: gap BED, commented TSV, headed TSV, variant files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.records import info_value, purity


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """BED3 as ``chrom, start, end``."""
    return spark.read.option("sep", "\t").schema("chrom string, start long, end long").csv(path)


def read_commented(spark: SparkSession, path: str, schema: str | None = None, comment: str = "#") -> DataFrame:
    """TSV whose comment lines are dropped; the schema avoids a pass over the data."""
    reader = spark.read.option("sep", "\t").option("comment", comment)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def comment_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    return spark.read.text(path).filter(F.col("value").startswith(comment))


def read_headed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """TSV with a header line (library statistics, scan parameters)."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def parse_variants(lines: DataFrame) -> DataFrame:
    """VCF lines as ``chrom, start, end, len, id, type, purity``; the type falls back to ALT."""
    f = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    info = at(7)
    return f.select(
        at(0).alias("chrom"), at(1).cast("long").alias("start"), info_value(info, "END").try_cast("long").alias("end"),
        info_value(info, "SVLEN").try_cast("long").alias("len"), at(2).alias("id"), F.coalesce(info_value(info, "SVTYPE"), at(4)).alias("type"), purity(info).alias("purity"),
    )


def variant_bed(lines: DataFrame) -> DataFrame:
    """VCF lines as ``chrom, start, end, type, size`` with the ALT name as type."""
    v = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    end, start = info_value(at(7), "END").try_cast("long"), at(1).cast("long")
    return v.select(at(0).alias("chrom"), start.alias("start"), end.alias("end"), F.regexp_replace(at(4), "[<>]", "").alias("type"), (end - start).alias("size"))


def drop_small_variants(lines: DataFrame) -> DataFrame:
    """VCF lines without single-base substitutions and masked or ignored rows."""
    f = F.split("value", "\t")
    ref, alt = F.get(f, F.lit(3)), F.get(f, F.lit(4))
    snp = (F.length(ref) == 1) & (F.length(alt) == 1)
    return lines.filter(~F.col("value").startswith("#")).filter(~snp & ~alt.isin("<MSK>", "<IGN>"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return parse_variants(spark.read.text(path))


def write_by_chromosome(variants: DataFrame, path: str, types: list[str] | None = None) -> None:
    """Parquet split by chromosome, optionally of some types only."""
    kept = variants.filter(F.col("type").isin(*types)) if types else variants
    kept.write.mode("overwrite").partitionBy("chrom").parquet(path)
