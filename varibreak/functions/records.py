"""Variant-record text: INFO fields, breakend ALT strings, names and numbers."""

from __future__ import annotations

import os

from pyspark.sql import Column, functions as F


def info_value(info: Column, key: str) -> Column:
    """Value of the last ``key=`` entry of an INFO text, NULL when absent."""
    found = F.regexp_extract_all(info, F.lit(f"(?:^|;){key}=([^;=]*)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def purity(info: Column) -> Column:
    """The PURITY entry of an INFO text as a number; NULL when absent or no number."""
    return info_value(info, "PURITY").try_cast("double")


def breakend_alt(chrom: Column, pos: Column, ref: Column, own_right: Column, mate_right: Column, inserted: Column) -> Column:
    """ALT of one side of a breakend pair whose mate lies at ``chrom:pos``.

    The bracket opens to the side the mate extends to; the reference base
    stands after the bracket when this side extends to the right.
    """
    mark = F.when(mate_right, F.lit("[")).otherwise(F.lit("]"))
    place = F.concat(mark, chrom, F.lit(":"), pos.cast("string"), mark)
    return F.when(own_right, F.concat(place, inserted, ref)).otherwise(F.concat(ref, inserted, place))


def strip_chr(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def is_all_chromosomes(name: str) -> bool:
    return name.lower() in ("a", "all")


def plain_number(x: Column) -> Column:
    """A number without scientific notation or trailing zeros."""
    text = F.regexp_replace(F.format_string("%.6f", x.cast("double")), "0+$", "")
    return F.regexp_replace(text, r"\.$", "")


def percent(x: Column) -> Column:
    return F.concat(F.format_string("%.1f", x * 100.0), F.lit("%"))


def variant_id(sample: Column, chrom: Column, index: Column, alt: Column, ident: Column) -> Column:
    return F.concat_ws(".", sample, chrom, index.cast("string"), alt, ident)


def common_prefix(names: list[str]) -> str:
    return os.path.commonprefix(list(names))


def contig_digest(tiles):
    """``chrom, digest``: MD5 over the MD5s of a contig's regular tiles.

    A contig is never put together in one place; its digest depends on the tile
    size and is therefore comparable only between runs that use the same one.
    """
    per_tile = tiles.select("chrom", F.struct("tile", F.md5("seq").alias("d")).alias("t"))
    return per_tile.groupBy("chrom").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["d"]), "")).alias("digest")
    )
