"""Importers for the text output of other structural-variant callers.

Each takes a DataFrame of lines (``value``) and gives ``chrom, start, end,
svtype, size`` as text-free columns; lines starting with ``#`` are skipped.
``adjust`` shifts coordinates, ``pad`` widens point events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

OTHER = "OTH"


def _fields(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))


def _f(i: int) -> Column:
    return F.get("f", F.lit(i))


def _int(c: Column) -> Column:
    return c.cast("long")


def _word(c: Column, i: int, sep: str = " ") -> Column:
    return F.get(F.split(c, sep), F.lit(i))


def _row(chrom, start, end, svtype, size) -> Column:
    return F.struct(
        chrom.alias("chrom"), start.cast("long").alias("start"), end.cast("long").alias("end"), svtype.alias("svtype"), size.cast("string").alias("size")
    )


def _emit(rows: DataFrame, *cases: Column) -> DataFrame:
    """One output row per non-NULL struct."""
    listed = F.filter(F.array(*cases), lambda x: x.isNotNull())
    return rows.select(F.explode(listed).alias("x")).select("x.*")


def _named(value: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for theirs, ours in names.items():
        out = F.when(value == theirs, F.lit(ours)).otherwise(out)
    return out


def _junction(cond: Column, chrom1, at1, chrom2, at2, adjust: int, size) -> tuple[Column, Column]:
    """A junction between two places as two one-base insertions, one at each end."""
    point = F.lit("INS")
    return (
        F.when(cond, _row(chrom1, at1, at1 + 1 + adjust, point, size)),
        F.when(cond, _row(chrom2, at2 - 1 + adjust, at2, point, size)),
    )


def cnvnator(lines: DataFrame, adjust: int = 0) -> DataFrame:
    f = _fields(lines)
    place = _word(_f(1), 1, ":")
    kind = _named(_f(0), {"deletion": "DEL", "duplication": "DUP", "insertion": "INS", "inversion": "INV"})
    shift = lambda i: _int(_word(place, i, "-")) - 1 + adjust
    return _emit(f, _row(F.regexp_replace(_word(_f(1), 0, ":"), "^[chr]+", ""), shift(0), shift(1), F.coalesce(kind, F.lit(OTHER)), _f(2)))


def breakdancer(lines: DataFrame, adjust: int = 0) -> DataFrame:
    f = _fields(lines)
    start, end, kind = _int(_f(1)) - 1 + adjust, _int(_f(4)) - 1 + adjust, _f(6)
    crossing = kind.isin("ITX", "CTX")
    plain = ~crossing & ~(kind.isin("DEL", "INS") & (end <= start))
    named = F.when(kind.isin("DEL", "DUP", "INS", "INV"), kind).otherwise(OTHER)
    other = F.when(kind == "CTX", _f(3)).otherwise(_f(0))
    return _emit(f, F.when(plain, _row(_f(0), start, end, named, _f(7))), *_junction(crossing, _f(0), start, other, end, adjust, _f(7)))


def pindel(lines: DataFrame, adjust: int = 0, low: int = 50, up: int = 1_000_000) -> DataFrame:
    f = _fields(lines)
    kind, size = _word(_f(1), 0), _word(_f(1), 1)
    length = F.abs(size.cast("double").cast("long"))
    named = F.coalesce(_named(kind, {"D": "DEL", "I": "INS", "INV": "INV", "TD": "DUP"}), F.lit(OTHER))
    row = _row(_word(_f(3), 1), _int(_word(_f(4), 1)) + adjust, _int(_f(5)) + adjust, named, size)
    return _emit(f, F.when(size_between(length, low, up), row))


def size_between(length: Column, low: int, up: int) -> Column:
    return (length >= low) & (length <= up)


def delly(lines: DataFrame, adjust: int = 0) -> DataFrame:
    f = _fields(lines)
    kind = F.regexp_replace(_word(_f(6), 0, "_"), "^>+", "")
    start = _int(_f(1)) - 1 + adjust
    crossing = kind == "Translocation"
    named = F.coalesce(_named(kind, {"Deletion": "DEL", "Duplication": "DUP", "Insertion": "INS", "Inversion": "INV"}), F.lit(OTHER))
    end = F.when(~crossing, _f(2).try_cast("long") - 1 + adjust)
    far = F.when(crossing, _f(3).try_cast("long") - 1 + adjust)
    return _emit(f, F.when(~crossing, _row(_f(0), start, end, named, _f(3))), *_junction(crossing, _f(0), start, _f(2), far, 0, _f(3)))


def lumpy(lines: DataFrame, adjust: int = 0) -> DataFrame:
    f = _fields(lines)
    kind = _word(_f(10), 1, ":")
    start, crossing = _int(_f(1)) - 1 + adjust, kind == "INTERCHROM"
    named = F.coalesce(_named(kind, {"DELETION": "DEL", "DUPLICATION": "DUP", "INSERTION": "INS", "INVERSION": "INV"}), F.lit(OTHER))
    zero, point = F.lit("0"), F.lit("INS")
    return _emit(
        f, F.when(~crossing, _row(_f(0), start, _int(_f(4)) - 1 + adjust, named, zero)),
        F.when(crossing, _row(_f(0), start, _int(_f(2)) + 1 + adjust, point, zero)),
        F.when(crossing, _row(_f(3), _int(_f(4)) + adjust, _int(_f(4)) + 1 + adjust, point, zero)),
    )


def own_bed(lines: DataFrame, adjust: int = 0, pad: int = 0) -> DataFrame:
    """The BED this package writes: type in column 6, size in the fifth INFO entry."""
    f = _fields(lines)
    kind, start = _f(5), _int(_f(1)) - 1 + adjust
    size = _word(_word(_f(8), 4, ";"), 1, "=").try_cast("long")
    sized = kind.isin("DEL", "INV")
    end = F.when(sized, start + size + adjust).when(kind == "DUP", start + 1 + adjust).otherwise(start + 1)
    dup_size = F.lit(2 + adjust)
    out_size = F.when(sized, size).when(kind == "DUP", dup_size).when(kind == "INS", F.lit(2 * pad)).otherwise(F.lit(0))
    named = F.when(kind.isin("DEL", "INV", "DUP", "INS"), kind).otherwise(OTHER)
    low = F.when(kind == "INS", start - pad).otherwise(start)
    return _emit(f, _row(_f(0), low, F.when(kind == "INS", start).otherwise(end), named, out_size))


def _from_vcf(lines: DataFrame, adjust: int, pad: int, sized: dict[str, int], padded: tuple[str, ...], svtype: Column, svlen: Column) -> DataFrame:
    f = _fields(lines).withColumn("k", svtype).withColumn("len", svlen.try_cast("long"))
    kind, start = F.col("k"), _int(_f(1)) - 1 + adjust
    sign = F.lit(None)
    for name, s in sized.items():
        sign = F.when(kind == name, F.lit(s)).otherwise(sign)
    size = F.col("len") * sign
    point = kind.isin(*padded)
    named = F.when(kind.isin(*sized, *[p for p in padded if p != "BND"]), kind).when(kind == "BND", "UNK").otherwise(OTHER)
    low = F.when(point, start - pad).otherwise(start)
    end = F.when(size.isNotNull(), start + size + adjust).when(point, low + pad).otherwise(start + 1)
    return _emit(f, _row(_f(0), low, end, named, F.coalesce(size, F.when(point, F.lit(2 * pad)).otherwise(F.lit(0)))))


def lumpy_vcf(lines: DataFrame, adjust: int = 0, pad: int = 0) -> DataFrame:
    """INFO order is fixed: type first, length third."""
    entry = lambda i: _word(_word(_f(7), i, ";"), 1, "=")
    return _from_vcf(lines, adjust, pad, {"DEL": -1, "INV": 1}, ("BND",), entry(0), entry(2))


def manta_vcf(lines: DataFrame, adjust: int = 0, pad: int = 0) -> DataFrame:
    from ..functions.records import info_value

    info = _f(7)
    return _from_vcf(lines, adjust, pad, {"DEL": -1, "INV": 1, "DUP": 1}, ("INS", "BND"), info_value(info, "SVTYPE"), info_value(info, "SVLEN"))


FORMATS: dict[str, Callable[..., DataFrame]] = {
    "CN": cnvnator, "BD": breakdancer, "PD": pindel, "DL": delly, "LP": lumpy, "SW": own_bed, "LP-VCF": lumpy_vcf, "MT-VCF": manta_vcf,
}


def read_calls(lines: DataFrame, fmt: str, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(FORMATS)}")
    return FORMATS[fmt](lines, **options)
