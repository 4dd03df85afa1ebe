"""Command line: ``python -m varibreak.cli <stat|scan|clip|join> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .config import ClipOptions, JoinOptions, ScanOptions, StatOptions, parse_int_pair
from .plans import pipelines
from .session import build_session, cut_lineage
from .sinks import vcf
from .sources.alignments import read_samples, register
from .sources.tables import read_gaps


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="varibreak")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str):
        p = sub.add_parser(name, help=text)
        p.add_argument("reads", help="libraries: control1,control2:case1 (BAM, SAM or Parquet)")
        p.add_argument("--reference", required=True, help="FASTA with .fai, or Parquet pieces (chrom, start, seq)")
        p.add_argument("--out", required=True)
        p.add_argument("-c", "--chromosomeName", default="a")
        p.add_argument("--by-read-group", action="store_true", help="a library is the LB of a read's group, not its file")
        return p

    stat = command("stat", "library statistics")
    stat.add_argument("-y", "--yield", dest="yield_reads", type=int, default=StatOptions.yield_reads)
    scan = command("scan", "window score tracks")
    scan.add_argument("-u", "--scanStart", type=int, default=1)
    scan.add_argument("-v", "--scanEnd", type=int, default=ScanOptions.end)
    scan.add_argument("-r", "--mixingRate", type=float, default=ScanOptions.mixing_rate)
    scan.add_argument("-w", "--windowWidth", type=int, default=ScanOptions.width)
    scan.add_argument("-s", "--stepSize", type=int, default=ScanOptions.step)
    clip = command("clip", "soft-clip clusters, breakends and events")
    clip.add_argument("-n", "--gapfile")
    clip.add_argument("-i", "--minReadPerCluster", default="3:5")
    clip.add_argument("-j", "--minBasePerCluster", default="30:50")
    clip.add_argument("-x", "--hotspot", default="10000:3")
    clip.add_argument("-y", "--insparam", default="0:0")
    clip.add_argument("-b", "--minGapPair", type=int, default=25)
    clip.add_argument("-g", "--gapdist", type=int, default=100_000)
    clip.add_argument("--nobam", action="store_true", help="no coverage checks")
    join = command("join", "merge all evidence into calls")
    join.add_argument("-u", "--track_opt", dest="tracks", default=JoinOptions.tracks)
    join.add_argument("-v", "--bigd_opt", dest="big", default=JoinOptions.big)
    join.add_argument("--disc_opt", dest="discordant", default=JoinOptions.discordant, help="wrongly oriented pairs; empty: none")
    join.add_argument("--seqcbs_opt", dest="change_point", default=JoinOptions.change_point, help="change points of case against control; empty: none")
    join.add_argument("--cvg_opt", dest="coverage", default=JoinOptions.coverage, help="binned coverage; empty: none")
    join.add_argument("--hang_opt", dest="hanging", default=JoinOptions.hanging, help="hanging reads from both sides; empty: none")
    join.add_argument("-r", "--confirm", default=JoinOptions.confirm)
    join.add_argument("-p", "--sample", default=JoinOptions.sample)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    spark = build_session(f"varibreak {args.command}")
    register(spark)
    aln = read_samples(spark, args.reads, args.by_read_group)
    pieces = spark.read.format("fasta").load(args.reference) if not args.reference.endswith(".parquet") else spark.read.parquet(args.reference)
    contigs = pieces.groupBy("chrom").agg(F.max(F.col("start") + F.length("seq") - 1).alias("length"))
    lengths = [(r.chrom, r.length) for r in contigs.orderBy("chrom").collect()]  # one row per contig
    stats = pipelines.library_table(aln, contigs, StatOptions(chromosome=args.chromosomeName, yield_reads=getattr(args, "yield_reads", StatOptions.yield_reads)))
    if args.command == "stat":
        vcf.write_stat(cut_lineage(stats), args.out)
        return
    stats = cut_lineage(stats)  # one row per library, read by every step below
    scan_options = ScanOptions(
        chromosome=args.chromosomeName, start=getattr(args, "scanStart", 1), end=getattr(args, "scanEnd", ScanOptions.end),
        mixing_rate=getattr(args, "mixingRate", ScanOptions.mixing_rate), width=getattr(args, "windowWidth", ScanOptions.width), step=getattr(args, "stepSize", ScanOptions.step),
    )
    if args.command == "scan":
        vcf.write_table(pipelines.scan_libraries(aln, stats, scan_options), args.out, gzip=True)
        return
    # coverage of case and control over all their libraries, and the longest mean read length of the case
    case, control = (stats.filter(f"sample {sign} 'case'").agg(F.sum("cvg").alias("cvg"), F.max("rl").alias("rl")).first() for sign in ("=", "<>"))
    clip_options = ClipOptions(
        chromosome=args.chromosomeName, min_reads=parse_int_pair(getattr(args, "minReadPerCluster", "3:5")), min_bases=parse_int_pair(getattr(args, "minBasePerCluster", "30:50")),
        hotspot=parse_int_pair(getattr(args, "hotspot", "10000:3")), insertion=parse_int_pair(getattr(args, "insparam", "0:0")),
        min_separation=getattr(args, "minGapPair", 25), gap_distance=getattr(args, "gapdist", 100_000), coverage=not getattr(args, "nobam", False),
    )
    gaps = read_gaps(spark, args.gapfile) if getattr(args, "gapfile", None) else None
    events, clusters = pipelines.clip_events(aln, pieces, gaps, case["cvg"], int(case["rl"]), clip_options, control_coverage=control["cvg"])
    if args.command == "clip":
        events.write.mode("overwrite").parquet(f"{args.out}/events")
        vcf.write_vcf(vcf.event_records(events, clusters.select("cid", "nreads")), f"{args.out}/events.vcf", contigs=lengths)
        return
    score_tracks = pipelines.scan_libraries(aln, stats, scan_options)
    raw, confirmed = pipelines.join_calls(aln, score_tracks, events, scan_options.step, options=JoinOptions(
        tracks=args.tracks, big=args.big, discordant=args.discordant, change_point=args.change_point, coverage=args.coverage, hanging=args.hanging, confirm=args.confirm),
                                         libraries=stats, scan_options=scan_options)
    sample = args.sample.split(",")[0]
    for name, regions in (("raw", raw), ("conf", confirmed)):
        records = cut_lineage(vcf.name_records(vcf.call_records(regions, somatic=False), sample))
        vcf.write_vcf(records, f"{args.out}/{name}.vcf", contigs=lengths)
        vcf.write_bed(vcf.record_bed(records), f"{args.out}/{name}.bed", ["CHROM", "POS", "END", "ALT", "ID"])


if __name__ == "__main__":
    main()
