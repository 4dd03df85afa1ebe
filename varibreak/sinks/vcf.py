"""Variant records and their files."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import VCF_ALT, VCF_FORMAT, VCF_INFO, VCF_OWN_INFO
from ..functions.records import breakend_alt, info_value, variant_id
from .onefile import tab_line, write_lines

FIELDS = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]


def header_lines(date: datetime.date | None = None, extra: list[str] = (), contigs: list[tuple[str, int]] = (), columns: list[str] = FIELDS) -> list[str]:
    """The header of a VCF: it defines every INFO key, ALT name and FORMAT key that the records of this module use."""
    day = (date or datetime.date.today()).strftime("%Y%m%d")
    lines = ["##fileformat=VCFv4.1", f"##filedate={day}"]
    lines += [f"##contig=<ID={name},length={length}>" for name, length in contigs]
    lines += [f'##INFO=<ID={i},Number={n},Type={t},Description="{text}">' for i, n, t, text in (*VCF_INFO, *VCF_OWN_INFO)]
    lines += [f'##ALT=<ID={i},Description="{text}">' for i, text in VCF_ALT]
    if "FORMAT" in columns:
        lines += [f'##FORMAT=<ID={i},Number={n},Type={t},Description="{text}">' for i, n, t, text in VCF_FORMAT]
    return [*lines, *extra, "#" + "\t".join(columns)]


def call_records(calls: DataFrame, somatic: bool = True) -> DataFrame:
    """VCF rows of region calls (``chrom, start, end, svtype, id, ref``; optional ``imprecise, cipos, ciend, purity, qual, filter``)."""
    has = lambda c: c in calls.columns
    optional = lambda c, text: [F.when(F.col(c).isNotNull(), text)] if has(c) else []
    bounds = lambda c, name: optional(c, F.concat(F.lit(f"{name}="), F.get(F.col(c), F.lit(0)).cast("string"), F.lit(","), F.get(F.col(c), F.lit(1)).cast("string"))) if has(c) else []
    info = F.concat_ws(
        ";", *([F.when(F.col("imprecise"), "IMPRECISE")] if has("imprecise") else []),
        F.concat(F.lit("SVTYPE="), "svtype"), F.concat(F.lit("END="), F.col("end").cast("string")),
        F.concat(F.lit("SVLEN="), (F.col("end") - F.col("start")).cast("string")),
        *bounds("cipos", "CIPOS"), *bounds("ciend", "CIEND"),
        *(optional("purity", F.concat(F.lit("PURITY="), F.col("purity").cast("string"))) if has("purity") else []),
        *([F.lit("SOMATIC")] if somatic else []),
    )
    given = lambda c, default: F.col(c).cast("string") if has(c) else F.lit(default)
    return calls.select(
        F.col("chrom").alias("CHROM"), F.col("start").alias("POS"), F.col("id").cast("string").alias("ID"), given("ref", ".").alias("REF"),
        F.concat(F.lit("<"), "svtype", F.lit(">")).alias("ALT"), given("qual", "100").alias("QUAL"), given("filter", "PASS").alias("FILTER"), info.alias("INFO"),
    )


def breakend_records(bnd: DataFrame, somatic: bool = True) -> DataFrame:
    """Two mated BND rows per breakend (``id`` and optional ``ref1, ref2, inserted``)."""
    given = lambda c, default: F.col(c) if c in bnd.columns else F.lit(default)

    def side(own: str, mate: str) -> Column:
        ref = given(f"ref{own}", "N")
        info = F.concat(F.lit("SVTYPE=BND;MATEID="), "id", F.lit(f"_{mate}" + (";SOMATIC" if somatic else "")))
        return F.struct(
            F.col(f"chr{own}").alias("CHROM"), F.col(f"pos{own}").alias("POS"), F.concat("id", F.lit(f"_{own}")).alias("ID"), ref.alias("REF"),
            breakend_alt(F.col(f"chr{mate}"), F.col(f"pos{mate}"), ref, F.col(f"goRight{own}"), F.col(f"goRight{mate}"), given("inserted", "")).alias("ALT"),
            F.lit(".").alias("QUAL"), F.lit("PASS").alias("FILTER"), info.alias("INFO"),
        )

    return bnd.select(F.explode(F.array(side("1", "2"), side("2", "1"))).alias("x")).select("x.*")


def event_records(events: DataFrame, support: DataFrame, somatic: bool = True) -> DataFrame:
    """VCF rows of typed breakends.

    ``support`` gives ``cid, nreads`` of the clip clusters.  An inversion and its
    partner become one row at their mean ends; insertion-type pairs keep a row
    each that names the other; everything else is one row.
    """
    reads = lambda key, name: support.select(F.col("cid").alias(key), F.col("nreads").alias(name))
    known = events.filter("EventType IS NOT NULL").join(reads("cid", "_n1"), "cid", "left").join(reads("mcid", "_n2"), "mcid", "left")
    known = known.withColumn("nsclip", F.coalesce("_n1", F.lit(0)) + F.coalesce("_n2", F.lit(0)))
    mate = events.select(F.col("row").alias("Partner"), F.col("pos1").alias("_p1"), F.col("pos2").alias("_p2"), F.col("cid").alias("_c"), F.col("mcid").alias("_m"))
    known = known.join(mate, "Partner", "left")
    inv = F.col("EventType") == "INV"
    known = known.filter(~inv | (F.col("row") < F.col("Partner")))
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    tag = F.lit("SOMATIC;" if somatic else "")
    st, ed = F.bround((F.col("pos1") + F.col("_p1")) / 2.0).cast("long"), F.bround((F.col("pos2") + F.col("_p2")) / 2.0).cast("long")
    svtype = F.when(F.col("EventType") == "TANDEM.DUP", "DUP").otherwise(F.col("EventType"))
    tail = F.concat(F.lit(";NSCLIP="), text("nsclip"))
    fold = F.concat(F.lit(";FOLDCHANGE="), F.coalesce(text(F.round("FoldChange", 6)), F.lit("NA")))
    span = F.concat(F.lit(";END="), text("pos2"), F.lit(";SVLEN="), F.coalesce(text("Distance"), F.lit("NA")))
    partner = F.when(F.col("Partner").isNotNull(), F.concat(F.lit(";PARTNERID="), F.concat_ws(".", "EventType", "_c", "_m"))).otherwise("")
    simple = F.concat(span, partner, F.lit(";BNDNUM="), text("row"), fold, tail)
    turned = F.concat(
        F.lit(";END="), text(ed), F.lit(";SVLEN="), text(ed - st), F.lit(";BNDNUM="), text("row"), F.lit(","), text("Partner"),
        F.lit(";CIPOS="), text(F.least("pos1", "_p1") - st), F.lit(","), text(F.greatest("pos1", "_p1") - st),
        F.lit(";CIEND="), text(F.least("pos2", "_p2") - ed), F.lit(","), text(F.greatest("pos2", "_p2") - ed), tail,
    )
    away = F.concat(F.lit(";MATEPOS="), text("pos2"), F.lit(";MATECHR="), "chr2", F.lit(";BNDNUM="), text("row"), tail)
    rest = F.when(inv, turned).when(F.col("EventType") == "INTERCHROMOSOMAL", away).otherwise(simple)
    return known.select(
        F.col("chr1").alias("CHROM"), F.when(inv, st).otherwise(F.col("pos1")).alias("POS"), F.concat_ws(".", "EventType", "cid", "mcid").alias("ID"),
        F.lit(".").alias("REF"), F.concat(F.lit("<"), svtype, F.lit(">")).alias("ALT"), F.lit("100").alias("QUAL"), F.lit("PASS").alias("FILTER"),
        F.concat(tag, F.lit("SVTYPE="), svtype, rest).alias("INFO"),
    )


def name_records(records: DataFrame, sample: str) -> DataFrame:
    """Sorted rows get ``sample.chrom.index.alt.id`` as ID."""
    from ..operators.breakends import global_rank

    ranked = global_rank(records, ["CHROM", "POS", "ID", "ALT", "INFO"], "_i")
    return ranked.withColumn("ID", variant_id(F.lit(sample), F.col("CHROM"), F.col("_i"), F.col("ALT"), F.col("ID"))).drop("_i")


def genotype_records(records: DataFrame, genotypes: DataFrame, sample: str) -> DataFrame:
    """Rows with positions, INFO values, FORMAT and sample column taken from genotypes.

    ``genotypes`` has ``ID, gt, gq, dp, Lbr, Rbr`` and optional ``ref``.  END,
    SVLEN, DP and AF are replaced where the INFO text carries them.
    """
    held = records.join(genotypes, "ID", "left")
    got = F.col("Lbr").isNotNull()
    info = F.when(F.col("INFO").endswith(";"), F.col("INFO")).otherwise(F.concat("INFO", F.lit(";")))
    info = F.concat(F.lit(";"), info)
    number = "[NA0-9.-]+"
    put = lambda text, key, value: F.regexp_replace(text, F.lit(f";{key}={number};"), F.concat(F.lit(f";{key}="), value, F.lit(";")))
    depth = F.coalesce(F.col("dp").cast("string"), F.lit("."))
    info = put(info, "END", F.col("Rbr").cast("string"))
    info = put(info, "SVLEN", (F.col("Rbr") - F.col("Lbr")).cast("string"))
    info = put(info, "DP", depth)
    share = F.when(F.col("gt") == "0/1", "0.5").when(F.col("gt") == "1/1", "1.0")
    info = F.when(share.isNotNull(), put(info, "AF", share)).otherwise(info)
    cols = ["CHROM", F.when(got, F.col("Lbr")).otherwise(F.col("POS")).alias("POS"), F.when(got, F.col("Rbr")).alias("END"), "ID",
            (F.coalesce("ref", "REF") if "ref" in genotypes.columns else F.col("REF")).alias("REF"), "ALT", "QUAL", "FILTER"]
    return held.select(*cols, F.when(got, F.substring(info, 2, 1 << 30)).otherwise(F.col("INFO")).alias("INFO"), F.lit("GT:GQ:DP").alias("FORMAT"),
                       F.concat_ws(":", "gt", "gq", depth).alias(sample))


def write_vcf(records: DataFrame, path: str, header: list[str] | None = None, contigs: list[tuple[str, int]] = ()) -> None:
    """Write a VCF as one file, sorted by ``CHROM, POS`` (contigs in the given order, others behind them by name).

    Genotyped records keep END for sorting and INFO only; it is no column of the format.
    """
    columns = [c for c in records.columns if c != "END"]
    place = [F.when(F.col("CHROM") == name, i) for i, (name, _) in enumerate(contigs)]
    order = [F.coalesce(*place, F.lit(len(contigs)))] if place else []
    rows = records.select(*columns).orderBy(*order, "CHROM", "POS", "ID", "ALT", "INFO")
    write_lines(rows.select(tab_line(rows).alias("value")), path, header or header_lines(contigs=contigs, columns=columns))


def record_bed(records: DataFrame) -> DataFrame:
    """``CHROM, POS, END, ALT, ID`` of VCF rows, the END taken from INFO and the ALT without brackets."""
    end = F.coalesce(info_value(F.col("INFO"), "END").try_cast("long"), F.col("POS"))
    return records.select("CHROM", "POS", end.alias("END"), F.regexp_replace("ALT", "[<>]", "").alias("ALT"), "ID")


def write_bed(calls: DataFrame, path: str, columns: list[str]) -> None:
    """Headerless TSV in one file, sorted by all its columns."""
    rows = calls.select(*columns).orderBy(*columns)
    write_lines(rows.select(tab_line(rows).alias("value")), path)


def _decimals(x: Column, digits: int) -> Column:
    """Decimals that show a number with ``digits`` significant digits, without zeros at the end."""
    size = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
    shown = F.format_string(f"%.{digits - 1}e", x.cast("double"))
    kept = F.length(F.regexp_replace(F.regexp_extract(shown, "\\.([0-9]*)e", 1), "0+$", ""))
    exponent = F.coalesce(F.regexp_extract(shown, "e([-+][0-9]+)$", 1).try_cast("int"), size)
    return F.greatest(F.lit(0), kept - exponent)


def short_numbers(table: DataFrame, digits: int = 2) -> DataFrame:
    """All columns as text: numbers with as many decimals as the column's neediest value has at ``digits`` significant digits.

    No scientific notation; NULL and NaN are ``NA``, truth values upper case.
    """
    kinds = dict(table.dtypes)
    real = [c for c, t in kinds.items() if t in ("double", "float") or t.startswith("decimal")]
    fine = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
    most = table.agg(F.lit(0).alias("_"), *[F.coalesce(F.max(_decimals(fine(c), digits)), F.lit(0)).alias(c) for c in real]).first().asDict()
    out = []
    for c, kind in kinds.items():
        if c in real:
            text = F.format_string(f"%.{most[c]}f", F.col(c).cast("double"))
            out.append(F.when(fine(c).isNotNull(), text).otherwise("NA").alias(c))
        elif kind == "boolean":
            out.append(F.coalesce(F.upper(F.col(c).cast("string")), F.lit("NA")).alias(c))
        else:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c))
    return table.select(*out)


def write_stat(stats: DataFrame, path: str, keys: list[str] = ("sample", "lib")) -> None:
    """Library statistics as ``path.stat`` and one ``path.<sample>.<lib>.stat`` per library (a row each), two digits."""
    names = stats.select(*keys).distinct().orderBy(*keys).collect()  # one row per library
    head = ["\t".join(stats.columns)]

    def put(rows: DataFrame, file: str) -> None:
        shown = short_numbers(rows.orderBy(*keys))
        write_lines(shown.select(tab_line(shown, "NA").alias("value")), f"{file}.stat", head)

    put(stats, path)
    for name in names:
        row = stats
        for key in keys:
            row = row.filter(F.col(key) == name[key])
        put(row, ".".join([path, *(str(name[k]) for k in keys)]))


def type_folder(svtype: Column) -> Column:
    return F.when(svtype.isin("DEL", "DUP", "INS", "INV"), F.lower(svtype)).otherwise("oth")


def write_typed_bed(variants: DataFrame, path: str) -> None:
    """One gzip TSV folder per variant type."""
    (variants.withColumn("kind", type_folder(F.col("svtype")))
     .write.mode("overwrite").partitionBy("kind").option("sep", "\t").option("compression", "gzip").csv(path))


def write_table(df: DataFrame, path: str, gzip: bool = False) -> None:
    """TSV with a header; several parts when the table is large."""
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)
