"""Reads and their mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cigar import imputed_isize


def join_mates(first: DataFrame, second: DataFrame, order: str, left: bool | None = None,
               self_side: bool = True) -> DataFrame:
    """Pair reads of ``second`` with the read of ``first`` that has their name.

    When a name repeats in ``first`` its last row by ``order`` counts.  With
    ``left`` given, ``impute_isize`` is added.  Names are reduced to one build
    row each before the join, so repeated names cannot multiply it.
    """
    kept = ["rid", "cigar", "isize"]
    build = first.groupBy("qname").agg(F.max_by(F.struct(*kept), F.col(order)).alias("_own"))
    joined = second.select("qname", *[F.col(c).alias(f"_mate_{c}") for c in kept]).join(build, "qname")
    out = [F.col("_own.rid").alias("self_rid"), F.col("_mate_rid").alias("mate_rid")]
    if left is not None:
        out.append(
            imputed_isize(F.col("_own.isize"), F.col("_own.cigar"), F.col("_mate_isize"), F.col("_mate_cigar"), left, self_side)
            .alias("impute_isize")
        )
    return joined.select("qname", *out)


def first_per_name(aln: DataFrame, order: list[str]) -> DataFrame:
    """The first row of every (chrom, qname) by ``order``."""
    cols = [c for c in aln.columns if c not in ("chrom", "qname")]
    picked = aln.groupBy("chrom", "qname").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return picked.select("chrom", "qname", *[F.col(f"_r.{c}").alias(c) for c in cols])


def map_positions(aln: DataFrame, order: list[str]) -> DataFrame:
    """One row per read name: plus-strand start, minus-strand start, discordance.

    The side of an unmapped read is NULL and so is its discordance.
    """
    one = first_per_name(aln.select("chrom", "qname", "rid", "flag", "pos", "mpos"), order)
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    unmapped, reverse, mate_reverse = bit(4), bit(16), bit(32)
    plus: Column = F.when(unmapped, F.when(~mate_reverse, F.col("mpos"))).when(~reverse, F.col("pos")).otherwise(F.col("mpos"))
    minus: Column = F.when(unmapped, F.when(mate_reverse, F.col("mpos"))).when(~reverse, F.col("mpos")).otherwise(F.col("pos"))
    return one.select(
        "chrom", "qname", plus.alias("p_start"), minus.alias("m_start"),
        F.when(~unmapped, reverse == mate_reverse).alias("discordant"),
    )


def pair_class(p_start: Column, m_start: Column, delta: Column | int) -> Column:
    """``star`` for a proper pair, ``minus``/``plus``/``both`` for the hanging side(s).

    A minus-hanging pair contributes its plus end, a plus-hanging one its minus
    end; a pair that maps too far apart or in reverse order counts for both.
    """
    d = m_start - p_start
    limit = delta if isinstance(delta, Column) else F.lit(delta)
    apart = (d > limit) | (d < 0)
    return (
        F.when(p_start.isNull() & m_start.isNull(), F.lit(None))
        .when(m_start.isNull(), "minus").when(p_start.isNull(), "plus")
        .when(apart, "both").when((d > 0) & (d < limit), "star")
    )
