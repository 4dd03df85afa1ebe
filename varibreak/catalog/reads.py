"""Read scans and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import cigar, density, dna, flags, records
from ..operators import match, regions
from ..operators.libstats import index_counts, sample_reads
from .registry import query
from .shared import SOFT_CLIP_SQL


@query("src01_region_scan", "aln gaps", """
spans AS (SELECT rid, chrom, pos, cigar, pos + greatest(CASE WHEN (flag & 4) = 0 THEN CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MX=DN]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) ELSE 1 END, 1) - 1 AS last FROM aln)
SELECT rid, s.chrom, pos, cigar, g.start AS region_start, g."end" AS region_end FROM spans s JOIN gaps g ON g.chrom = s.chrom AND s.pos <= g."end" AND s.last >= g.start WHERE s.pos > 0""")
def region_scan(spark, d):
    """Reads overlapping any gap region, those that begin before it included."""
    return regions.reads_in_regions(views.aln(spark, d), views.gaps(spark, d)).select("rid", "chrom", "pos", "cigar", "region_start", "region_end")


@query("src02_projected_scan", "aln", "SELECT qname, flag, pos, mapq FROM aln")
def projected_scan(spark, d):
    return views.aln(spark, d).select("qname", "flag", "pos", "mapq")


@query("src03_flag_filtered_scan", "aln", "SELECT rid, flag FROM aln WHERE (flag & 1536) = 0")
def flag_filtered_scan(spark, d):
    return views.aln(spark, d).filter(flags.usable(F.col("flag"))).select("rid", "flag")


@query("src04_contigs", "contigs", "SELECT chrom, length FROM contigs")
def contig_list(spark, d):
    return views.contigs(spark, d)


@query("src05_index_counts", "aln", "SELECT chrom, count(*) AS nreads FROM aln WHERE (flag & 4) = 0 GROUP BY chrom")
def chrom_counts(spark, d):
    return index_counts(views.aln(spark, d), ["chrom"])


@query("src06_sampled_reads", "aln", """
share AS (SELECT lib, least(1.0, 10000.0 / count(*)) * 1000000 AS cut FROM aln GROUP BY lib)
SELECT rid, lib FROM aln JOIN share USING (lib)
WHERE CAST(('0x' || substr(md5(qname), 1, 8)) AS BIGINT) % 1000000 < cut""")
def sampled(spark, d):
    return sample_reads(views.aln(spark, d), 10_000, ["lib"]).select("rid", "lib")


@query("src07_library_union", "aln", "SELECT lib, chrom, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM aln GROUP BY lib, chrom")
def library_union(spark, d):
    reads = views.aln(spark, d)
    one, two = reads.filter("lib = 'lib1'"), reads.filter("lib = 'lib2'")
    return one.unionByName(two).groupBy("lib", "chrom").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


@query("src08_sample_scan", "aln", "SELECT sample, count(*) AS n, count(DISTINCT qname) AS names FROM aln GROUP BY sample")
def sample_scan(spark, d):
    return views.aln(spark, d).groupBy("sample").agg(F.count("*").alias("n"), F.countDistinct("qname").alias("names"))


@query("src09_reference_scan", "genome", "SELECT chrom, CAST(sum(length(seq)) AS BIGINT) AS length, CAST(sum(length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) AS BIGINT) AS gc FROM genome GROUP BY chrom")
def reference_scan(spark, d):
    gc = F.length("seq") - F.length(F.translate("seq", "GC", ""))
    return views.genome_tiles(spark, d).groupBy("chrom").agg(F.sum(F.length("seq")).alias("length"), F.sum(gc).alias("gc"))


TILE, OVERLAP = 1024, 2100


@query("src10_subsequence", "genome gaps", """
bits AS (SELECT g.chrom, g.start, t.start AS ts,
    substr(t.seq, greatest(g.start - t.start, 0) + 1, least(g.start + 59, t.start + 31) - greatest(g.start, t.start) + 1) AS s
  FROM gaps g JOIN genome t ON t.chrom = g.chrom AND t.start <= g.start + 59 AND t.start + 31 >= g.start)
SELECT chrom, start, string_agg(s, '' ORDER BY ts) AS subseq FROM bits GROUP BY chrom, start""")
def subsequence(spark, d):
    tiles = match.reference_tiles(views.genome_tiles(spark, d), TILE, OVERLAP)
    asked = views.gaps(spark, d).select("chrom", "start", (F.col("start") + 59).alias("stop"))
    return match.fetch_subsequence(asked, tiles, TILE, "start", "stop").select("chrom", "start", "subseq").filter("length(subseq) > 0")


@query("src11_chromosome_expansion", "contigs", "SELECT chrom, CAST(1 AS BIGINT) AS scan_start, CAST(length AS BIGINT) AS scan_end FROM contigs")
def chromosome_expansion(spark, d):
    return regions.scan_ranges(views.contigs(spark, d), "all")


@query("src11_listed_chromosomes", "contigs", "SELECT chrom, CAST(1 AS BIGINT) AS scan_start, CAST(length AS BIGINT) AS scan_end FROM contigs WHERE chrom IN ('chr4', 'chr2')")
def listed_chromosomes(spark, d):
    return regions.scan_ranges(views.contigs(spark, d), "chr4,chr2,none")


@query("src11_clamped_range", "contigs", "SELECT chrom, CAST(501 AS BIGINT) AS scan_start, CAST(length AS BIGINT) AS scan_end FROM contigs WHERE chrom = 'chr3'")
def clamped_range(spark, d):
    return regions.scan_ranges(views.contigs(spark, d), "chr3", 501, 3_000_000_000)


@query("src17_region_loader", "aln gaps", """
SELECT g.chrom, g.start, count(*) AS n, count(*) FILTER ((flag & 16) <> 0) AS reverse, count(*) FILTER ((flag & 1024) <> 0) AS duplicates
FROM gaps g JOIN aln a ON a.chrom = g.chrom AND a.pos BETWEEN g.start AND g."end" GROUP BY g.chrom, g.start""")
def region_loader(spark, d):
    from ..operators.intervals import island_of_points

    reads = views.aln(spark, d).select("chrom", "pos", *flags.flag_columns(F.col("flag")))
    held = island_of_points(reads, views.gaps(spark, d), ["chrom"], "pos", {"gap": F.col("start")}).filter("gap IS NOT NULL")
    return held.groupBy("chrom", F.col("gap").alias("start")).agg(
        F.count("*").alias("n"), F.count_if("QStrand").alias("reverse"), F.count_if("Duplicate").alias("duplicates")
    )


@query("src19_library_split", "aln", "SELECT lib, sample, count(*) AS n, CAST(sum(mapq) AS BIGINT) AS mapq_sum FROM aln GROUP BY lib, sample")
def library_split(spark, d):
    return views.aln(spark, d).groupBy("lib", "sample").agg(F.count("*").alias("n"), F.sum("mapq").alias("mapq_sum"))


@query("src20_reads_by_name", "aln", "SELECT rid, qname FROM aln WHERE qname IN (SELECT qname FROM aln WHERE (flag & 13) = 9)")
def reads_by_name(spark, d):
    reads = views.aln(spark, d)
    names = reads.filter(flags.hanging(F.col("flag"))).select("qname").distinct()
    return reads.select("rid", "qname").join(names, "qname", "left_semi").select("rid", "qname")


@query("scf01_cigar_ops", "aln", """
ops AS (SELECT unnest(regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1)) AS op,
               unnest(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1)) AS len FROM aln)
SELECT op, count(*) AS n, CAST(sum(CAST(len AS BIGINT)) AS BIGINT) AS bases FROM ops GROUP BY op""")
def cigar_operations(spark, d):
    ops = views.aln(spark, d).select(F.explode(cigar.cigar_ops(F.col("cigar"))).alias("o"))
    return ops.groupBy(F.col("o.op").alias("op")).agg(F.count("*").alias("n"), F.sum("o.len").alias("bases"))


@query("scf02_flag_bits", "aln", "SELECT chrom, " + ", ".join(
    f'count(*) FILTER ((flag & {1 << i}) <> 0) AS "{n}"' for i, n in enumerate(flags.FLAG_NAMES)) + " FROM aln GROUP BY chrom")
def flag_bits(spark, d):
    bits = views.aln(spark, d).select("chrom", *flags.flag_columns(F.col("flag")))
    return bits.groupBy("chrom").agg(*[F.count_if(n).alias(n) for n in flags.FLAG_NAMES])


@query("scf03_aligned_length", "aln", """
SELECT rid, CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MX=IN]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS read_len,
  CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MX=DN]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS ref_len FROM aln""")
def aligned_lengths(spark, d):
    c = F.col("cigar")
    return views.aln(spark, d).select("rid", cigar.aligned_length(c).alias("read_len"), cigar.aligned_length(c, cigar.REFERENCE_LENGTH_CLASS).alias("ref_len"))


@query("scf04_first_number", "aln", """
SELECT rid, CASE WHEN regexp_matches(cigar, '^[0-9]+S') THEN regexp_extract(cigar, '^([0-9]+)S', 1) ELSE '0' END AS head,
  CASE WHEN regexp_matches(cigar, '[0-9]+S$') THEN regexp_extract(cigar, '([0-9]+)S$', 1) ELSE '0' END AS tail FROM aln""")
def first_numbers(spark, d):
    c = F.col("cigar")
    return views.aln(spark, d).select("rid", cigar.first_number(c, "^([0-9]+)S").alias("head"), cigar.first_number(c, "([0-9]+)S$").alias("tail"))


@query("scf05_soft_clip_tuple", "aln", SOFT_CLIP_SQL + "\nSELECT rid, n_left, n_match, to_right, n_right FROM soft")
def soft_clip_tuple(spark, d):
    return views.aln(spark, d).select("rid", cigar.soft_clip(F.col("cigar")).alias("c")).select("rid", "c.n_left", "c.n_match", "c.to_right", "c.n_right")


@query("scf06_cigar_indels", "aln", """
ops AS (SELECT rid, regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1) AS op,
     list_transform(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1), lambda x: CAST(x AS BIGINT)) AS len FROM aln),
flat AS (SELECT rid, unnest(range(1, len(op) + 1)) AS i, op, len FROM ops)
SELECT rid, op[i] AS op, CAST(len[i] AS INT) AS length,
  CAST(coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN op[j] IN ('M', 'D', '=', 'X') THEN len[j] ELSE 0 END)), 0) AS INT) AS "offset"
FROM flat WHERE op[i] IN ('I', 'D')""")
def cigar_indels(spark, d):
    reads = views.aln(spark, d)
    part = lambda letter, found: reads.select("rid", F.lit(letter).alias("op"), F.explode(found).alias("x"))
    both = part("I", cigar.insertions(F.col("cigar"))).unionByName(part("D", cigar.deletions(F.col("cigar"))))
    return both.select("rid", "op", "x.length", "x.offset")


@query("scf07_clip_positions", "aln", SOFT_CLIP_SQL + """
SELECT rid, CASE WHEN n_left > 0 THEN pos END AS left_clip, CASE WHEN n_right > 0 THEN pos + to_right END AS right_clip
FROM soft WHERE n_left > 0 OR n_right > 0""")
def clip_positions(spark, d):
    c = views.aln(spark, d).select("rid", "pos", cigar.soft_clip(F.col("cigar")).alias("c"))
    return c.filter("c.n_left > 0 OR c.n_right > 0").select(
        "rid", F.when(F.col("c.n_left") > 0, F.col("pos")).alias("left_clip"),
        F.when(F.col("c.n_right") > 0, F.col("pos") + F.col("c.to_right")).alias("right_clip"),
    )


@query("scf08_base_codes", "aln", """
b AS (SELECT chrom, unnest(string_split(seq, '')) AS base FROM aln)
SELECT chrom, CAST(CASE upper(base) WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 3 WHEN 'T' THEN 4 ELSE 5 END AS INT) AS code, count(*) AS n
FROM b WHERE base <> '' GROUP BY ALL""")
def base_codes(spark, d):
    bases = views.aln(spark, d).select("chrom", F.explode(F.split("seq", "")).alias("base")).filter("base <> ''")
    counted = bases.groupBy("chrom", "base").agg(F.count("*").alias("n"))
    return counted.groupBy("chrom", dna.base_code(F.col("base")).alias("code")).agg(F.sum("n").alias("n"))


@query("scf09_reverse_complement", "aln", "SELECT rid, reverse(seq) AS reversed, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp FROM aln")
def reverse_complements(spark, d):
    return views.aln(spark, d).select("rid", F.reverse("seq").alias("reversed"), dna.reverse_complement(F.col("seq")).alias("revcomp"))


@query("scf16_density_ratio", "aln", """
SELECT isize, count(*) AS n, round(exp((isize - 300e0) * (100e0 / 10000e0) - 10000e0 / 20000e0), 6) AS ratio_del,
  round(exp((isize - 300e0) * (-100e0 / 10000e0) - 10000e0 / 20000e0), 6) AS ratio_ins
FROM aln WHERE isize > 0 GROUP BY isize""")
def density_ratio(spark, d):
    sizes = views.aln(spark, d).filter("isize > 0").groupBy("isize").agg(F.count("*").alias("n"))
    ratio = lambda w: F.round(density.shifted_ratio(F.col("isize"), w, 300, 100), 6)
    return sizes.select("isize", "n", ratio(100).alias("ratio_del"), ratio(-100).alias("ratio_ins"))


@query("scf18_capped_density", "aln", """
SELECT isize, count(*) AS n, round(least(exp((isize - 300e0) * (100e0 / 10000e0) - 10000e0 / 20000e0), 20e0), 6) AS capped,
  round(ln(0.5e0 + 0.5e0 * least(exp((isize - 300e0) * (100e0 / 10000e0) - 10000e0 / 20000e0), 20e0)), 6) AS term
FROM aln WHERE isize > 0 GROUP BY isize""")
def capped_density(spark, d):
    sizes = views.aln(spark, d).filter("isize > 0").groupBy("isize").agg(F.count("*").alias("n"))
    capped = density.shifted_ratio(F.col("isize"), 100, 300, 100, cap=20.0)
    return sizes.select("isize", "n", F.round(capped, 6).alias("capped"), F.round(density.mixture_term(capped, 0.5), 6).alias("term"))


@query("scf17_right_tail", "aln", """
sizes AS (SELECT isize, count(*) AS n FROM aln WHERE isize > 0 GROUP BY isize),
nodes AS (SELECT isize, n, k, greatest((isize - 300e0) / 100e0, -12e0) AS z FROM sizes, range(0, 401) AS r(k)),
steps AS (SELECT isize, n, (least(z, 0e0) + 12e0 - z) / 400e0 AS h, z + k * ((least(z, 0e0) + 12e0 - z) / 400e0) AS u, CASE WHEN k IN (0, 400) THEN 1e0 WHEN k % 2 = 1 THEN 4e0 ELSE 2e0 END AS wt
  FROM (SELECT isize, n, k, least(z, 11e0) AS z FROM nodes))
SELECT isize, any_value(n) AS n, round(sum(wt * exp(-u * u / 2e0)) * any_value(h) / 3e0 / sqrt(2e0 * pi()), 6) AS tail FROM steps GROUP BY isize""")
def right_tails(spark, d):
    """Every insert size; the SQL sums the normal density by Simpson's rule."""
    sizes = views.aln(spark, d).filter("isize > 0").groupBy("isize").agg(F.count("*").alias("n"))
    return sizes.select("isize", "n", F.round(density.right_tail_column(F.col("isize"), 300, 100), 6).alias("tail"))


@query("scf20_contig_digest", "genome", """
big AS (SELECT chrom, tile // 32 AS block, md5(string_agg(seq, '' ORDER BY tile)) AS digest FROM genome GROUP BY ALL)
SELECT chrom, md5(string_agg(digest, '' ORDER BY block)) AS digest FROM big GROUP BY chrom""")
def contig_digest(spark, d):
    return records.contig_digest(match.reference_tiles(views.genome_tiles(spark, d), TILE, 0))


@query("scf21_number_text", "regions", """
SELECT id, regexp_replace(regexp_replace(printf('%.6f', score * 12345.5e0), '0+$', ''), '\\.$', '') AS plain, printf('%.1f', score / 100e0 * 100e0) || '%' AS pct FROM regions""")
def number_text(spark, d):
    return views.regions(spark, d).select("id", records.plain_number(F.col("score") * 12345.5).alias("plain"), records.percent(F.col("score") / 100.0).alias("pct"))


@query("scf23_chromosome_names", "regions", "SELECT replace(chrom, 'chr', '') AS name, count(*) AS n FROM regions GROUP BY 1")
def chromosome_names(spark, d):
    return views.regions(spark, d).groupBy(records.strip_chr(F.col("chrom")).alias("name")).agg(F.count("*").alias("n"))


@query("prj01_range_clamp", "regions contigs", """
SELECT id, greatest(1, start - 1000) AS lo, least(length, "end" + 1000) AS hi FROM regions JOIN contigs USING (chrom)""")
def range_clamp(spark, d):
    held = views.regions(spark, d).join(views.contigs(spark, d), "chrom")
    return held.select("id", F.greatest(F.lit(1), F.col("start") - 1000).alias("lo"), F.least("length", F.col("end") + 1000).alias("hi"))


@query("flt01_clip_usable", "aln", "SELECT rid FROM aln WHERE (flag & 1540) = 0")
def clip_usable(spark, d):
    return views.aln(spark, d).filter(flags.clip_usable(F.col("flag"))).select("rid")


@query("flt02_has_clip", "aln", "SELECT cigar, count(*) AS n FROM aln WHERE contains(cigar, 'S') GROUP BY cigar")
def has_clip(spark, d):
    return views.aln(spark, d).filter(cigar.has_clip(F.col("cigar"))).groupBy("cigar").agg(F.count("*").alias("n"))


@query("srt01_coordinate_sort", "aln", "SELECT chrom, pos, rid FROM aln ORDER BY chrom, pos, rid")
def coordinate_sort(spark, d):
    return views.aln(spark, d).select("chrom", "pos", "rid").orderBy("chrom", "pos", "rid")
