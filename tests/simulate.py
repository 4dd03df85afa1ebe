"""Simulated read pairs and rearranged genomes for recall checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _uniform(ident: Column, salt: str, seed: int) -> Column:
    """A reproducible uniform number in [0, 1) from a row's id."""
    return (F.pmod(F.xxhash64(ident, F.lit(salt), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


def _normal(ident: Column, salt: str, seed: int) -> Column:
    u, v = F.greatest(_uniform(ident, salt + "u", seed), F.lit(1e-300)), _uniform(ident, salt + "v", seed)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(v * (2.0 * math.pi))


def simulate_pairs(spark: SparkSession, n: int, pairs: int, mu: float, sigma: float, event: str | None = None, at: int = 0, size: int = 0,
                   read_length: int = 100, mix: float = 0.5, fail: float = 0.0, fail_missing: float = 1.0, foreign: bool = True,
                   seed: int = 1) -> DataFrame:
    """Pairs ``id, p_start, m_start, failed, mutated`` on a genome of ``n`` bases.

    A share ``mix`` of pairs comes from a copy with a deletion of ``size`` bases
    after ``at`` or with an insertion of ``size`` bases at ``at``; their reads are
    carried back to genome coordinates.  A read over the junction (or, for foreign
    sequence, inside the insert) is unmapped; with ``foreign`` false a read inside
    the insert lands anywhere else.  A share ``fail`` of pairs loses its minus
    read to a random place or, at rate ``fail_missing``, one of its ends.
    """
    ident = F.col("id")
    length = n - size if event == "deletion" else n + size if event == "insertion" else n
    rows = spark.range(pairs).withColumn("mutated", (F.lit(event is not None)) & (ident < round(pairs * mix)))
    span = F.when(F.col("mutated"), F.lit(length)).otherwise(F.lit(n))
    rows = rows.withColumn("_isize", F.greatest(F.lit(1), F.round(_normal(ident, "size", seed) * sigma + mu)).cast("long"))
    # start uniformly among the places where the pair fits
    rows = rows.withColumn("_p", (F.floor(_uniform(ident, "pos", seed) * F.greatest(F.lit(1), span - F.col("_isize"))) + 1).cast("long"))
    rows = rows.withColumn("_m", F.col("_p") + F.col("_isize"))

    def back(c: str) -> Column:
        x = F.col(c)
        if event == "deletion":
            moved = F.when(x.between(at - read_length, at), None).when(x > at, x + size).otherwise(x)
        elif event == "insertion":
            other = (F.floor(_uniform(ident, c, seed) * n) + 1).cast("long")
            inside = F.lit(None).cast("long") if foreign else other
            moved = F.when((x >= at - read_length) & (x < at + size), inside).when(x >= at + size, x - size).otherwise(x)
        else:
            return x
        return F.when(F.col("mutated"), moved).otherwise(x)

    rows = rows.withColumn("p_start", back("_p")).withColumn("m_start", back("_m"))
    rows = rows.withColumn("failed", _uniform(ident, "fail", seed) < fail)
    roll = _uniform(ident, "kind", seed)
    stray = (F.floor(_uniform(ident, "stray", seed) * n) + 1).cast("long")
    m = F.when(F.col("failed"), F.when(roll < fail_missing / 2, None).otherwise(stray)).otherwise(F.col("m_start"))
    p = F.when(F.col("failed") & (roll > 1 - fail_missing / 2), None).otherwise(F.col("p_start"))
    return rows.select("id", p.alias("p_start"), m.alias("m_start"), "failed", "mutated")


def spike_variant(pieces: DataFrame, chrom: str, pos: int, size: int, inserted: str = "") -> DataFrame:
    """Genome pieces (``chrom, start, seq``) with a deletion of ``size`` bases after ``pos`` or ``inserted`` put there."""
    if size > 0 and inserted:
        raise ValueError("give a deletion size or an inserted sequence, not both")
    here = F.col("chrom") == chrom
    start, end = F.col("start"), F.col("start") + F.length("seq") - 1
    shift = len(inserted) - size
    head = F.struct(start.alias("start"), F.col("seq").substr(F.lit(1), F.greatest(F.lit(0), pos - start + 1).cast("int")).alias("seq"))
    cut = F.greatest(start, F.lit(pos + size + 1))
    tail = F.struct((cut + shift).alias("start"), F.expr(f"substring(seq, CAST(greatest(start, {pos + size + 1}) - start + 1 AS INT))").alias("seq"))
    middle = F.struct(F.lit(pos + 1).cast("long").alias("start"), F.lit(inserted).alias("seq"))
    holds = (start <= pos) & (end >= pos)
    parts = F.when(
        here,
        F.filter(F.array(head, F.when(holds & F.lit(bool(inserted)), middle), F.when(end > pos + size, tail)), lambda x: x.isNotNull() & (F.length(x["seq"]) > 0)),
    ).otherwise(F.array(F.struct(start.alias("start"), F.col("seq").alias("seq"))))
    return pieces.select("chrom", F.explode(parts).alias("x")).select("chrom", "x.start", "x.seq")
