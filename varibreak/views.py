"""Alignment-shaped views over the benchmark tables.

The benchmark tables hold orders and line items, not reads.  These views derive
a genome, its reads, gaps and contigs from them with integer arithmetic and
``md5`` only, so any SQL engine can derive the same rows:

* every ``orders`` row is a 32-base genome tile (chromosome = key mod 5), so the
  genome grows with the table;
* every ``lineitem`` row is a 100-base read starting inside its order's tile;
* every fiftieth tile carries a planted rearrangement (deletion, tandem
  duplication, inversion or translocation) whose reads are soft-clipped at the
  breakpoint and carry the bases of the other side.

``aln_sql`` is the same rule in DuckDB's dialect, used by the result checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .session import table

READ_LENGTH = 100
TILE = 32
SV_STRIDE = 50
SV_SPAN = 25


def _bases(key: Column) -> Column:
    """The 32 bases of the genome tile with this order key."""
    return _translated(_digests(key, 1))


def _digests(key: Column, tiles: int) -> Column:
    """What the bases of so many tiles are made of, from the tile with this key on."""
    return F.concat(*[F.md5((key + 5 * i).cast("string")) for i in range(tiles)])


def _translated(digests: Column) -> Column:
    return F.translate(digests, "0123456789abcdef", "ACGTACGTACGTACGT")


def _revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def genome_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chrom, tile, start, seq``: consecutive 32-base pieces, 1-based start."""
    key = F.col("o_orderkey")
    tile = F.expr("o_orderkey div 5")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("chr"), (key % 5 + 1).cast("string")).alias("chrom"),
        tile.alias("tile"),
        (tile * TILE + 1).alias("start"),
        _bases(key).alias("seq"),
    )


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome_tiles(spark, sf_dir).groupBy("chrom").agg((F.max("tile") * TILE + TILE).alias("length"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 500-base masked interval per supplier."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("chr"), (F.col("s_suppkey") % 5 + 1).cast("string")).alias("chrom"),
        F.expr("(s_suppkey div 5) * 4800 + 1500").alias("start"),
        F.expr("(s_suppkey div 5) * 4800 + 2000").alias("end"),
    )


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads: ``rid, sample, lib, qname, flag, chrom, pos, mapq, cigar, mchrom, mpos,
    isize, seq, qwidth, strand``."""
    base = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_linenumber").cast("long").alias("ln"),
        F.col("l_quantity").cast("long").alias("q"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"),
    )
    base = base.selectExpr("*", "k % 5 AS c", "k div 5 AS t").selectExpr(
        "*", "t % 50 AS m", "t div 50 AS s"
    ).selectExpr(
        "*",
        "s % 4 AS kind",
        "CASE WHEN m IN (0, 1) THEN 0 WHEN m IN (25, 26) THEN 25 END AS site",
        "sk % 3 = 0 AS is_control",
        "34 + pk % 12 AS qc",
        "5 * (t - t % 25) + c AS hk",
    )
    side = F.expr(
        "CASE WHEN site IS NULL OR s = 0 OR (is_control AND (s div 4) % 3 <> 0) THEN NULL"
        " WHEN kind IN (0, 3) THEN IF(site = 0, 'R', 'L')"
        " WHEN kind = 1 THEN IF(site = 0, 'L', 'R')"
        " ELSE IF(ln % 2 = 1, 'R', 'L') END"
    )
    base = base.withColumn("side", side).withColumn(
        "dk",
        F.expr(
            "5 * (50 * s + 25 - site) + CASE WHEN kind <> 3 THEN c WHEN site = 0 THEN (c + 1) % 5 ELSE (c + 4) % 5 END"
        ),
    )
    plain_pos = F.expr(
        "32 * t + 1 + CASE WHEN pk % 11 = 0 THEN 3 WHEN pk % 11 = 1 THEN 5 ELSE (pk * 7 + ln * 5 + q) % 32 END"
    )
    home = F.expr("32 * (t - t % 25) + 1")
    pos = F.when(F.col("side") == "R", home - (READ_LENGTH - F.col("qc"))).when(F.col("side") == "L", home).otherwise(
        plain_pos
    )
    base = base.withColumn(
        "cls",
        F.expr(
            "CASE WHEN (s + 1) % 4 = 3 AND m >= 44 AND NOT is_control THEN 'tra'"
            " WHEN pk % 37 = 0 THEN 'stray'"
            " WHEN (s + 1) % 4 = 0 AND m >= 42 AND NOT is_control AND ln % 2 = 1 THEN 'del'"
            " ELSE 'plain' END"
        ),
    ).withColumn(
        "isz",
        F.expr("CASE WHEN cls IN ('tra', 'stray') THEN 0 WHEN cls = 'del' THEN 1000 + 4 * q ELSE 200 + 4 * q END"),
    )
    # numbers many columns are made of: as fields of a generated row they are computed once, and a filter on a column
    # of them stays one comparison instead of being written out down to the table's columns
    base = base.withColumn("pos", pos)
    mpos = F.expr(
        "CASE WHEN cls = 'tra' THEN 32 * (50 * (s + 1) + 25) + 1 + pk % 60"
        " WHEN cls = 'stray' THEN 32 * (t div 2) + 1 + pk % 300"
        " WHEN ln % 2 = 1 THEN pos + isz - 100 ELSE GREATEST(1, pos - isz + 100) END"
    )
    flag = F.expr(
        "CAST(1 + IF(cls = 'plain', 2, 0) + IF(pk % 97 = 5, 4, 0)"
        " + IF(pk % 19 = 3 OR (m >= 46 AND pk % 3 = 0), 8, 0) + IF(ln % 2 = 0, 16, 32)"
        " + IF(ln % 2 = 1, 64, 128) + IF(pk % 211 = 7, 512, 0) + IF(pk % 23 = 2, 1024, 0) AS INT)"
    )
    numbers = F.struct(F.col("pos"), F.col("side"), F.col("cls"), F.col("isz"), flag.alias("flag"), mpos.alias("mpos"))
    kept = ["k", "pk", "sk", "ln", "q", "price", "c", "t", "kind", "is_control", "qc", "hk", "dk"]
    base = base.select(*kept, F.inline(F.array(numbers)))
    text = lambda c: F.expr(f"CAST({c} AS STRING)")
    cigar = (
        F.when(F.col("side") == "R", F.concat(text("100 - qc"), F.lit("M"), text("qc"), F.lit("S")))
        .when(F.col("side") == "L", F.concat(text("qc"), F.lit("S"), text("100 - qc"), F.lit("M")))
        .when(F.expr("pk % 11 = 0"), F.lit("60M4D40M"))
        .when(F.expr("pk % 11 = 1"), F.lit("40M6I54M"))
        .when(F.expr("pk % 11 = 2"), F.concat(text("100 - q"), F.lit("M"), text("q"), F.lit("S")))
        .when(F.expr("pk % 11 = 3"), F.concat(text("q"), F.lit("S"), text("100 - q"), F.lit("M")))
        .when(F.expr("pk % 11 = 4"), F.lit("5H100M"))
        .when(F.expr("pk % 11 = 5"), F.lit("20M2D30M1I49M"))
        .when(F.expr("pk % 11 = 6"), F.lit("10S70M20S"))
        .otherwise(F.lit("100M"))
    )
    qc, dk, hk = F.col("qc"), F.col("dk"), F.col("hk")
    clipped, inverted, on_right = F.col("side").isNotNull(), F.col("kind") == 2, F.col("side") == "R"
    # each bulky string is its own column, written once in the plan, and only the bases a read keeps are translated
    behind = on_right == inverted
    bases, at = F.when(clipped, F.lit(READ_LENGTH) - qc).otherwise(F.lit(READ_LENGTH)).cast("int"), F.col("pos") - TILE * F.col("t")
    first = F.when(on_right, 4 * TILE + 1 - bases).when(clipped, F.lit(1)).otherwise(at).cast("int")
    base = (
        base.withColumn("home_key", F.when(on_right, hk - 20).when(clipped, hk).otherwise(F.col("k")))
        .withColumn("home", _digests(F.col("home_key"), 5)).withColumn("home", _translated(F.col("home").substr(first, bases)))
        .withColumn("other_key", F.when(clipped, F.when(behind, dk - 10).otherwise(dk)))
        .withColumn("clip", F.when(clipped, _digests(F.col("other_key"), 2)))
        .withColumn("clip", _translated(F.col("clip").substr(F.when(behind, 2 * TILE + 1 - qc).otherwise(F.lit(1)).cast("int"), qc.cast("int"))))
        .withColumn("clip", F.when(inverted, _revcomp(F.col("clip"))).otherwise(F.col("clip")))
        .withColumn("clip", F.when(F.expr("pk % 29 = 0"), F.expr("concat(left(clip, 4), 'N', substring(clip, 6))")).otherwise(F.col("clip")))
    )
    seq = F.when(on_right, F.concat("home", "clip")).when(clipped, F.concat("clip", "home")).otherwise(F.col("home"))
    chrom = lambda c: F.concat(F.lit("chr"), F.expr(f"CAST({c} + 1 AS STRING)"))
    rid = F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in ("k", "ln", "pk", "sk", "q", "price")]))
    return base.select(
        rid.alias("rid"),
        F.when(F.col("is_control"), F.lit("control")).otherwise(F.lit("case")).alias("sample"),
        F.concat(F.lit("lib"), F.expr("CAST(sk % 2 + 1 AS STRING)")).alias("lib"),
        F.concat(text("k"), F.lit("_"), text("(ln + 1) div 2")).alias("qname"),
        F.col("flag"),
        chrom("c").alias("chrom"),
        F.col("pos"),
        F.expr("CAST(60 - 10 * (pk % 7) AS INT)").alias("mapq"),
        cigar.alias("cigar"),
        F.when(F.col("cls").isin("tra", "stray"), chrom("(c + 1) % 5")).otherwise(chrom("c")).alias("mchrom"),
        F.col("mpos"),
        F.expr("CAST(IF(ln % 2 = 1, isz, -isz) AS INT)").alias("isize"),
        seq.alias("seq"),
        F.lit(READ_LENGTH).alias("qwidth"),
        F.expr("IF(ln % 2 = 1, '+', '-')").alias("strand"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed regions, one per order: ``id, sample, chrom, start, end, svtype, method, score``."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "IF(o_custkey % 3 = 0, 'control', 'case') AS sample",
        "concat('chr', CAST(o_orderkey % 5 + 1 AS STRING)) AS chrom",
        "32 * (o_orderkey div 5) + 1 + o_custkey % 32 AS start",
        "32 * (o_orderkey div 5) + 6 + o_custkey % 32 + o_custkey % 40 AS end",
        "element_at(array('DEL', 'DUP', 'INS', 'INV'), CAST(o_custkey % 4 + 1 AS INT)) AS svtype",
        "element_at(array('sclip', 'cigar', 'seqcbs', 'bigd', 'disc', 'lcd', 'ldx', 'hax', 'cvg'),"
        " CAST(o_custkey % 9 + 1 AS INT)) AS method",
        "CAST(o_custkey % 100 AS DOUBLE) AS score",
    )


def breakends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discordant pairs as breakend rows, ends in read order."""
    return aln(spark, sf_dir).filter("isize = 0 OR abs(isize) >= 1000").selectExpr(
        "chrom AS chr1", "pos AS pos1", "strand = '-' AS goRight1", "mchrom AS chr2", "mpos AS pos2",
        "(flag & 64) <> 0 AS goRight2", "rid AS cid", "concat(rid, '/m') AS mcid",
    )


def anchors(spark: SparkSession, sf_dir: str, sample: str | None = None) -> DataFrame:
    """Discordant pairs as anchors: both reads' strands, chromosomes and extents."""
    reads = aln(spark, sf_dir).filter("isize = 0 OR abs(isize) >= 1000")
    if sample:
        reads = reads.filter(F.col("sample") == sample)
    return reads.selectExpr(
        "strand = '+' AS lfwd", "chrom AS lchr", "pos AS lst", "pos + 99 AS led",
        "(flag & 32) = 0 AS rfwd", "mchrom AS rchr", "mpos AS rst", "mpos + 99 AS red",
    )


def regions_sql() -> str:
    return """
regions AS (
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'control' ELSE 'case' END AS sample,
    'chr' || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS chrom,
    32 * (o_orderkey // 5) + 1 + o_custkey % 32 AS start,
    32 * (o_orderkey // 5) + 6 + o_custkey % 32 + o_custkey % 40 AS "end",
    (['DEL', 'DUP', 'INS', 'INV'])[o_custkey % 4 + 1] AS svtype,
    (['sclip', 'cigar', 'seqcbs', 'bigd', 'disc', 'lcd', 'ldx', 'hax', 'cvg'])[o_custkey % 9 + 1] AS method,
    CAST(o_custkey % 100 AS DOUBLE) AS score
  FROM orders)"""


def breakends_sql() -> str:
    return """
bnd AS (
  SELECT chrom AS chr1, pos AS pos1, strand = '-' AS "goRight1", mchrom AS chr2, mpos AS pos2,
    (flag & 64) <> 0 AS "goRight2", rid AS cid, rid || '/m' AS mcid
  FROM aln WHERE isize = 0 OR abs(isize) >= 1000)"""


def anchors_sql() -> str:
    return """
anchors AS (
  SELECT sample, strand = '+' AS lfwd, chrom AS lchr, pos AS lst, pos + 99 AS led,
    (flag & 32) = 0 AS rfwd, mchrom AS rchr, mpos AS rst, mpos + 99 AS red
  FROM aln WHERE isize = 0 OR abs(isize) >= 1000)"""


def _tile_sql(key: str, first: int, last: int) -> str:
    one = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    return "concat(" + ", ".join(one.format(f"{key} + {5 * i}") for i in range(first, last + 1)) + ")"


def genome_sql() -> str:
    return (
        "genome AS (SELECT 'chr' || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS chrom, o_orderkey // 5 AS tile,"
        f" (o_orderkey // 5) * 32 + 1 AS start, {_tile_sql('o_orderkey', 0, 0)} AS seq FROM orders)"
    )


def contigs_sql() -> str:
    return (
        "contigs AS (SELECT 'chr' || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS chrom,"
        " max(o_orderkey // 5) * 32 + 32 AS length FROM orders GROUP BY 1)"
    )


def gaps_sql() -> str:
    return (
        "gaps AS (SELECT 'chr' || CAST(s_suppkey % 5 + 1 AS VARCHAR) AS chrom, (s_suppkey // 5) * 4800 + 1500 AS start,"
        ' (s_suppkey // 5) * 4800 + 2000 AS "end" FROM supplier)'
    )


def aln_sql() -> str:
    revcomp = "reverse(translate({}, 'ACGT', 'TGCA'))"
    ahead, behind = f"left({_tile_sql('dk', 0, 1)}, qc)", f"right({_tile_sql('dk', -2, -1)}, qc)"
    noisy = "CASE WHEN pk % 29 = 0 THEN left({0}, 4) || 'N' || substr({0}, 6) ELSE {0} END"
    clip_r = noisy.format("clip_r")
    clip_l = noisy.format("clip_l")
    return f"""
aln0 AS (
  SELECT l_orderkey AS k, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln,
         CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
         l_orderkey % 5 AS c, l_orderkey // 5 AS t, (l_orderkey // 5) % 50 AS m, (l_orderkey // 5) // 50 AS s
  FROM lineitem),
aln1 AS (
  SELECT *, s % 4 AS kind, CASE WHEN m IN (0, 1) THEN 0 WHEN m IN (25, 26) THEN 25 END AS site,
         sk % 3 = 0 AS is_control, 34 + pk % 12 AS qc, 5 * (t - t % 25) + c AS hk FROM aln0),
aln2 AS (
  SELECT *, CASE WHEN site IS NULL OR s = 0 OR (is_control AND (s // 4) % 3 <> 0) THEN NULL
                 WHEN kind IN (0, 3) THEN CASE WHEN site = 0 THEN 'R' ELSE 'L' END
                 WHEN kind = 1 THEN CASE WHEN site = 0 THEN 'L' ELSE 'R' END
                 ELSE CASE WHEN ln % 2 = 1 THEN 'R' ELSE 'L' END END AS side,
         5 * (50 * s + 25 - site) + CASE WHEN kind <> 3 THEN c WHEN site = 0 THEN (c + 1) % 5 ELSE (c + 4) % 5 END AS dk,
         CASE WHEN (s + 1) % 4 = 3 AND m >= 44 AND NOT is_control THEN 'tra'
              WHEN pk % 37 = 0 THEN 'stray'
              WHEN (s + 1) % 4 = 0 AND m >= 42 AND NOT is_control AND ln % 2 = 1 THEN 'del' ELSE 'plain' END AS cls
  FROM aln1),
aln3 AS (
  SELECT *, CASE WHEN side = 'R' THEN 32 * (t - t % 25) + 1 - (100 - qc) WHEN side = 'L' THEN 32 * (t - t % 25) + 1
                 ELSE 32 * t + 1 + CASE WHEN pk % 11 = 0 THEN 3 WHEN pk % 11 = 1 THEN 5 ELSE (pk * 7 + ln * 5 + q) % 32 END
            END AS pos,
         CASE WHEN cls IN ('tra', 'stray') THEN 0 WHEN cls = 'del' THEN 1000 + 4 * q ELSE 200 + 4 * q END AS isz,
         CASE WHEN side IS NOT NULL THEN CASE WHEN kind = 2 THEN {revcomp.format(behind)} ELSE {ahead} END END AS clip_r,
         CASE WHEN side IS NOT NULL THEN CASE WHEN kind = 2 THEN {revcomp.format(ahead)} ELSE {behind} END END AS clip_l
  FROM aln2),
aln AS (
  SELECT md5(concat_ws('_', CAST(k AS VARCHAR), CAST(ln AS VARCHAR), CAST(pk AS VARCHAR), CAST(sk AS VARCHAR),
                       CAST(q AS VARCHAR), CAST(price AS VARCHAR))) AS rid,
    CASE WHEN is_control THEN 'control' ELSE 'case' END AS sample,
    'lib' || CAST(sk % 2 + 1 AS VARCHAR) AS lib,
    CAST(k AS VARCHAR) || '_' || CAST((ln + 1) // 2 AS VARCHAR) AS qname,
    CAST(1 + CASE WHEN cls = 'plain' THEN 2 ELSE 0 END + CASE WHEN pk % 97 = 5 THEN 4 ELSE 0 END
      + CASE WHEN pk % 19 = 3 OR (m >= 46 AND pk % 3 = 0) THEN 8 ELSE 0 END + CASE WHEN ln % 2 = 0 THEN 16 ELSE 32 END
      + CASE WHEN ln % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN pk % 211 = 7 THEN 512 ELSE 0 END
      + CASE WHEN pk % 23 = 2 THEN 1024 ELSE 0 END AS INT) AS flag,
    'chr' || CAST(c + 1 AS VARCHAR) AS chrom, pos, CAST(60 - 10 * (pk % 7) AS INT) AS mapq,
    CASE WHEN side = 'R' THEN CAST(100 - qc AS VARCHAR) || 'M' || CAST(qc AS VARCHAR) || 'S'
         WHEN side = 'L' THEN CAST(qc AS VARCHAR) || 'S' || CAST(100 - qc AS VARCHAR) || 'M'
         WHEN pk % 11 = 0 THEN '60M4D40M' WHEN pk % 11 = 1 THEN '40M6I54M'
         WHEN pk % 11 = 2 THEN CAST(100 - q AS VARCHAR) || 'M' || CAST(q AS VARCHAR) || 'S'
         WHEN pk % 11 = 3 THEN CAST(q AS VARCHAR) || 'S' || CAST(100 - q AS VARCHAR) || 'M'
         WHEN pk % 11 = 4 THEN '5H100M' WHEN pk % 11 = 5 THEN '20M2D30M1I49M'
         WHEN pk % 11 = 6 THEN '10S70M20S' ELSE '100M' END AS cigar,
    CASE WHEN cls IN ('tra', 'stray') THEN 'chr' || CAST((c + 1) % 5 + 1 AS VARCHAR)
         ELSE 'chr' || CAST(c + 1 AS VARCHAR) END AS mchrom,
    CASE WHEN cls = 'tra' THEN 32 * (50 * (s + 1) + 25) + 1 + pk % 60
         WHEN cls = 'stray' THEN 32 * (t // 2) + 1 + pk % 300
         WHEN ln % 2 = 1 THEN pos + isz - 100 ELSE greatest(1, pos - isz + 100) END AS mpos,
    CAST(CASE WHEN ln % 2 = 1 THEN isz ELSE -isz END AS INT) AS isize,
    CASE WHEN side = 'R' THEN right({_tile_sql('hk', -4, -1)}, 100 - qc) || {clip_r}
         WHEN side = 'L' THEN {clip_l} || left({_tile_sql('hk', 0, 2)}, 100 - qc)
         ELSE substr({_tile_sql('k', 0, 4)}, pos - 32 * t, 100) END AS seq,
    CAST(100 AS INT) AS qwidth, CASE WHEN ln % 2 = 1 THEN '+' ELSE '-' END AS strand
  FROM aln3)"""
