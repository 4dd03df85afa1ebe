"""The commands as DataFrame pipelines: statistics, scan, clips, joining.

Inputs are the alignment schema (``sample, lib, rid, ...``), ``contigs``
(``chrom, length``), genome pieces (``chrom, start, seq``) and gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..config import ClipOptions, JoinOptions, ScanOptions, StatOptions, checked, parse_confirm, parse_pairs, parse_sample_pairs, parse_tracks
from ..functions.density import unscaled
from ..functions.discrete import min_insertion_reads
from ..functions.records import is_all_chromosomes
from ..operators import breakends as be
from ..operators import calls, changepoint, clips, intervals, libstats, match, scan, tracks
from ..operators.pairedscan import paired_event_scan
from ..operators.regions import last_base
from ..operators.thresholds import sample_thresholds
from ..session import cut_lineage, small

HANG_LIMIT = 0.1  # largest hang or clip rate of a usable library (chosen here)
LEAST_HANG = 1e-6  # stands for a hang rate of zero, whose logarithm has no value
TRACK_WORDS = {"track", "method", "thresh", "sup", "gap", "cvg"}
BIG_WORDS = {"minmpr", "maxins"}
CHANGE_WORDS = {"minstat", "sup", "gap", "expand", "good"}
COVERAGE_WORDS = {"width", "gap", "sup"}
HANGING_WORDS = {"width", "minfwd", "minrev"}
METHODS = ("empr", "robust", "boot", "theo", "value")
CONFIRM_WORDS = {"dedup", "nostrict"}


def on_chromosomes(df: DataFrame, names: str) -> DataFrame:
    return df if is_all_chromosomes(names) else df.filter(F.col("chrom").isin(*names.split(",")))


def library_table(aln: DataFrame, contigs: DataFrame, options: StatOptions = StatOptions()) -> DataFrame:
    """One row per sample and library: read length, coverage, hang/clip rates, insert model and track fitness."""
    keys = ["sample", "lib"]
    reads, chosen = on_chromosomes(aln, options.chromosome), on_chromosomes(contigs, options.chromosome)
    sampled = reads if options.yield_reads is None else libstats.sample_reads(reads, options.yield_reads, keys)
    stats = libstats.read_stats(sampled, keys)
    model = libstats.library_parameters(sampled, keys)
    cover = libstats.mean_coverage(reads, chosen, keys).drop("rl")
    ok = lambda c: F.col(c) <= HANG_LIMIT
    return stats.join(cover, keys).join(model, keys).select(
        *keys, "rl", "cvg", "p_left", "p_right", "q_right", "q_left", "nreads", "is", "sdR", "sdL",
        F.col("good_for_deletion").alias("lCd"), F.col("good_for_insertion").alias("lCi"),
        ok("p_left").alias("lDl"), ok("p_right").alias("lDr"), ok("q_left").alias("lSl"), ok("q_right").alias("lSr"),
    )


def scan_tracks(aln: DataFrame, options: ScanOptions) -> DataFrame:
    """Score tracks per window: ``sample, chrom, t, lCd, lCi, lDl, lDr, cvg``, all reads by the one model in ``options``."""
    return _window_totals(_window_terms(aln, options))


def library_models(libraries: DataFrame, options: ScanOptions) -> DataFrame:
    """``sample, lib, rl, mu, sd, p_left, p_right, delta, big``: the model each library is scored by.

    A value set in ``options`` stands before the one learned.
    """
    given = lambda value, learned: learned if value is None else F.lit(float(value))
    rate = lambda c: F.greatest(F.col(c), F.lit(LEAST_HANG))
    left = given(options.prob_hang, rate("p_left"))
    right = given(options.prob_hang_right, given(options.prob_hang, rate("p_right")))
    mu, sd = given(options.insert_size, F.col("is").cast("double")), given(options.insert_sd, F.col("sdR").cast("double"))
    return libraries.select("sample", "lib", F.floor(given(options.read_length, F.col("rl"))).cast("long").alias("rl"), mu.alias("mu"), sd.alias("sd"), left.alias("p_left"), right.alias("p_right")).select(
        "*", F.floor(given(options.delta, F.col("mu") + 6 * F.col("sd"))).cast("long").alias("delta"),
        F.floor(given(options.big_deletion, F.col("mu") + 3 * F.col("sd"))).cast("long").alias("big"))


def scan_libraries(aln: DataFrame, libraries: DataFrame, options: ScanOptions) -> DataFrame:
    """As ``scan_tracks``, the sum over the libraries of each sample, each scored by its own model.

    ``libraries`` is the library table.  Its models are joined to the reads (few rows, counted before they are
    broadcast), so all libraries are one pass over the reads.
    """
    models = small(library_models(libraries, options))
    keys, own, w, step = ["sample", "chrom"], ["sample", "lib"], options.width, options.step
    reads = on_chromosomes(aln, options.chromosome).filter(F.col("pos").between(options.start, options.end) & (F.col("flag").bitwiseAND(C.DUPLICATE + C.QC_FAIL + C.UNMAPPED) == 0))
    pairs = reads.join(models.select(*own, F.col("rl").alias("_rl"), "mu", "sd", "big"), own)
    proper = pairs.filter((F.col("isize") > 2 * F.col("_rl")) & (F.col("mchrom") == F.col("chrom")) & (F.col("isize") < F.col("big")))
    term = lambda shift: scan.scaled(scan.mixture_term(scan.shifted_ratio(F.col("isize"), shift, F.col("mu"), F.col("sd")), options.mixing_rate))
    frags = proper.select(*keys, (F.col("pos") + F.col("_rl")).alias("start"), (F.col("pos") + F.col("isize") - F.col("_rl") - 1).alias("end"), term(w).alias("d"), term(-w).alias("i"))
    cut = scan.windows_within(frags, F.col("start"), F.col("end"), w, step, options.start)
    runs = scan.window_sums(cut, keys, {"lCd": F.col("d"), "lCi": F.col("i"), "cvg": F.lit(1)})
    rows = scan.to_windows(runs, keys, ["lCd", "lCi", "cvg"], step, options.start)
    hang = reads.filter(F.col("flag").bitwiseAND(1 + C.UNMAPPED + C.MATE_UNMAPPED) == 1 + C.MATE_UNMAPPED)
    for strand, before, name, rate in (("+", True, "lDl", "p_left"), ("-", False, "lDr", "p_right")):
        part = scan.hanging_scores_by_model(hang.filter(F.col("strand") == strand), models, own, keys, "pos", before, w, step, options.mixing_rate, rate, options.start)
        rows = rows.unionByName(part.select(*keys, "t", F.col("score").alias(name)), allowMissingColumns=True)
    return _window_totals(rows)


def _window_totals(rows: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("sample", "chrom", "t").agg(*[unscaled(total(c)).alias(c) for c in ("lCd", "lCi", "lDl", "lDr")], total("cvg").alias("cvg"))


def _window_terms(aln: DataFrame, options: ScanOptions) -> DataFrame:
    """Scaled integer terms per window, several rows per window.

    Straddling terms use proper plus-strand pairs, hanging terms reads whose mate is unmapped.
    """
    if options.insert_size is None or options.insert_sd is None:
        raise ValueError("insert size and its deviation come from the library table")
    keys, w, step = ["sample", "chrom"], options.width, options.step
    rl, mu, sd = options.read_length or 100, options.insert_size, options.insert_sd
    delta = options.delta or int(mu + 6 * sd)
    big_deletion = options.big_deletion or int(mu + 3 * sd)
    reads = on_chromosomes(aln, options.chromosome).filter(F.col("pos").between(options.start, options.end) & (F.col("flag").bitwiseAND(C.DUPLICATE + C.QC_FAIL + C.UNMAPPED) == 0))
    proper = reads.filter((F.col("isize") > 2 * rl) & (F.col("mchrom") == F.col("chrom")) & (F.col("isize") < big_deletion))
    frags = proper.select(*keys, (F.col("pos") + rl).alias("start"), (F.col("pos") + F.col("isize") - rl - 1).alias("end"), "isize")
    term = lambda shift: scan.scaled(scan.mixture_term(scan.shifted_ratio(F.col("isize"), shift, mu, sd), options.mixing_rate))
    cut = scan.windows_within(frags.withColumn("d", term(w)).withColumn("i", term(-w)), F.col("start"), F.col("end"), w, step, options.start)
    runs = scan.window_sums(cut, keys, {"lCd": F.col("d"), "lCi": F.col("i"), "cvg": F.lit(1)})
    rows = scan.to_windows(runs, keys, ["lCd", "lCi", "cvg"], step, options.start)
    hang = reads.filter(F.col("flag").bitwiseAND(1 + C.UNMAPPED + C.MATE_UNMAPPED) == 1 + C.MATE_UNMAPPED)
    left = options.prob_hang or 0.05
    for strand, before, name, rate in (("+", True, "lDl", left), ("-", False, "lDr", options.prob_hang_right or left)):
        part = scan.hanging_scores(hang.filter(F.col("strand") == strand), keys, "pos", before, w, step, delta, options.mixing_rate, rate, mu, sd, options.start)
        rows = rows.unionByName(part.select(*keys, "t", F.col("score").alias(name)), allowMissingColumns=True)
    return rows


def clip_events(aln: DataFrame, pieces: DataFrame, gaps: DataFrame | None, coverage: float, read_length: int,
                options: ClipOptions = ClipOptions(), tile: int = 4096, control_coverage: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed breakends with insertion rows, and the case clusters they rest on.

    With control reads the fold change compares case with control, scaled by
    ``coverage`` over ``control_coverage`` (1 when not given).  ``tile`` must be at least the longest consensus; control clusters and gap
    regions are removed before remapping, hotspots, near-duplicates and short
    pairs before typing.
    """
    keys = ["chrom"]
    reads = on_chromosomes(aln, options.chromosome)
    case = reads.filter(F.col("sample") == "case")
    control = reads.filter(F.col("sample") != "case")
    both = clips.clip_clusters(reads.withColumn("sample", F.when(F.col("sample") == "case", "case").otherwise("control")), ["sample", "chrom"],
                               min(options.min_reads), min(options.min_bases))
    strong = lambda s, i: both.filter((F.col("sample") == s) & (F.col("nreads") >= options.min_reads[i]) & (F.col("nbases") >= options.min_bases[i])).drop("sample")
    kept = clips.remove_control(strong("case", 1), strong("control", 0))
    if gaps is not None:
        kept = intervals.points_in(kept, gaps, keys, "position", keep=False)
    kept = cut_lineage(kept)
    tiles = cut_lineage(match.reference_tiles(pieces, tile, 2 * C.HOME_WINDOW + 100))
    rows = match.remap_clusters(kept, tiles, tile, C.MAX_MATCHES, C.MAX_CLUSTER_DISTANCE, C.MIN_CONSENSUS_LENGTH, C.HOME_WINDOW)
    rows = cut_lineage(be.canonical(rows.drop("rc")))
    rows = be.hotspots(rows, ["chr1"], "pos1", *options.hotspot).filter(~F.col("hot")).drop("hot")
    rows = be.separated(be.drop_near_duplicates(rows, read_length), options.min_separation)
    span = lambda df: df.select("chrom", F.col("pos").alias("start"), last_base(F.col("pos"), F.col("cigar"), F.col("flag")).alias("end"))
    has_control = control.limit(1).count() > 0
    scale = coverage / control_coverage if control_coverage else 1.0
    events = be.classify(
        cut_lineage(be.number_rows(rows)), read_length, span(case) if options.coverage else None, span(control) if has_control else None, scale,
        options.del_threshold, options.dup_threshold, options.max_fold, options.min_fold,
    )
    named = kept.withColumn("cid", F.concat_ws(":", "side", "chrom", F.col("position").cast("string")))
    calm = be.hotspots(named, ["chrom", "side"], "position", *options.hotspot).filter(~F.col("hot")).drop("hot")
    side = lambda s: calm.filter(F.col("side") == s).select("chrom", "position", "nreads", "mismatch", "cid")
    max_gap, min_reads = options.insertion
    found = be.call_insertions(side("L"), side("R"), read_length, min_reads or min_insertion_reads(coverage), max_gap or None)
    found = found.drop("reads").withColumn("EventStart", F.col("pos1")).withColumn("EventEnd", F.col("pos2"))
    out = events.unionByName(found, allowMissingColumns=True)
    return (be.away_from_gaps(out, gaps, options.gap_distance) if gaps is not None else out), named


def event_regions(events: DataFrame) -> DataFrame:
    """Typed breakends on one chromosome as region calls."""
    kind = F.regexp_replace("EventType", r"\.INV$", "")
    kind = F.when(kind == "TANDEM.DUP", "DUP").when(kind.isin("INS.DUP", "DOM.INS"), "INS").otherwise(kind)
    one = events.filter("EventType IS NOT NULL AND EventStart IS NOT NULL AND (chr1 = chr2 OR EventType <> 'INTERCHROMOSOMAL')")
    return one.select(F.col("chr1").alias("chrom"), F.least("EventStart", "EventEnd").alias("start"), F.greatest("EventStart", "EventEnd").alias("end"), kind.alias("svtype"), F.lit("sclip").alias("method"))


def big_deletion_limit(options: ScanOptions, mu: Column, sd: Column) -> Column:
    """The insert size from which a pair is a big deletion and no longer scored."""
    return F.lit(options.big_deletion) if options.big_deletion else F.floor(mu + 3 * sd)


def _from_big_deletion(aln: DataFrame, libraries: DataFrame | None, options: ScanOptions) -> DataFrame:
    """The reads at or above their library's limit, by the same values as the scan."""
    given = lambda value, learned: F.lit(float(value)) if value is not None else F.col(learned)
    if libraries is None:
        libraries = libstats.library_parameters(aln, ["sample", "lib"])
    limit = big_deletion_limit(options, given(options.insert_size, "is"), given(options.insert_sd, "sdR"))
    limits = libraries.select("sample", "lib", limit.alias("_limit"))
    return aln.join(small(limits), ["sample", "lib"]).filter(F.col("isize") >= F.col("_limit")).drop("_limit")  # one row per library


def _margin(score_tracks: DataFrame, parts: list[str], spec: dict[str, str], step: int, libraries: DataFrame | None, scan_options: ScanOptions) -> DataFrame:
    """The tracks with ``_s``: how far the weakest of the named tracks is above its threshold."""
    level, method = spec.get("thresh", "level3"), spec.get("method", "robust")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known are {METHODS}")
    joint = score_tracks.withColumn("_j", F.least(*[F.col(p) for p in parts]) if len(parts) > 1 else F.col(parts[0]))
    if not level.startswith("level") or method == "value":
        return joint.withColumn("_s", F.col("_j") - float(level.removeprefix("level")))
    number = float(level.removeprefix("level"))
    if method in ("empr", "robust"):
        limit = tracks.robust_threshold(joint, ["sample"], "_j", number)
    elif method == "boot":
        delta = scan_options.delta or 1000
        limit = tracks.bootstrap_threshold(joint, ["sample"], "_j", step, max(1, round(2 * delta / step)), tracks.level_alpha(number)).select("sample", "threshold")
    else:
        if libraries is None:
            raise ValueError("thresholds by theory need the library table")
        by_sample: dict[str, list[dict]] = {}
        for row in libraries.collect():  # one row per library
            by_sample.setdefault(row["sample"], []).append(row.asDict())
        windows = {r["sample"]: r["n"] for r in joint.groupBy("sample").agg(F.count("*").alias("n")).collect()}
        rows = []
        for sample, n in windows.items():
            found = sample_thresholds(by_sample.get(sample, []), tracks.level_alpha(number), n, scan_options.width, scan_options.mixing_rate, scan_options.delta)
            rows.append((sample, *[float(found[p]) for p in parts]))
        limits = joint.sparkSession.createDataFrame(rows, ", ".join(["sample string", *(f"_t{i} double" for i in range(len(parts)))]))
        held = joint.join(small(limits), "sample")
        gaps = [F.col(p) - F.col(f"_t{i}") for i, p in enumerate(parts)]
        return held.withColumn("_s", F.least(*gaps) if len(gaps) > 1 else gaps[0])
    return joint.join(small(limit), "sample").withColumn("_s", F.col("_j") - F.col("threshold"))  # one row per sample


def discordant_regions(aln: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Pairs of one chromosome in a wrong orientation: both ends one way round are INV, ends facing away DUP (semantics chosen here)."""
    usable = F.col("flag").bitwiseAND(1 + C.UNMAPPED + C.MATE_UNMAPPED + C.QC_FAIL + C.DUPLICATE) == 1
    ahead, back = F.col("flag").bitwiseAND(16) == 0, F.col("flag").bitwiseAND(32) != 0
    kind = F.when(ahead != back, "INV").when(~ahead, "DUP")
    left = aln.filter(usable & (F.col("mchrom") == F.col("chrom")) & (F.col("pos") < F.col("mpos"))).withColumn("svtype", kind).filter("svtype IS NOT NULL")
    pairs = left.select("sample", "chrom", "svtype", (F.col("pos") + F.col("qwidth") - 1).alias("start"), F.col("mpos").alias("end")).filter("start <= end")
    found = calls.call_big_deletions(pairs.withColumnRenamed("svtype", "_kind"), ["sample", "chrom", "_kind"], int(spec["minmpr"]), int(spec["maxins"]))
    return found.select("sample", "chrom", "start", "end", F.col("_kind").alias("svtype"), F.lit("disc").alias("method"))


def coverage_regions(spans: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Runs of bins whose smoothed depth is under 0.9 or over 1.1 of the sample's mean bin."""
    width = int(spec.get("width", C.COVERAGE_BIN))
    bins = cut_lineage(tracks.coverage_bins(spans, ["sample", "chrom"], width))
    mean = small(bins.groupBy("sample").agg(F.avg("n").alias("_mean")))
    smooth = tracks.running_median3(bins, ["sample", "chrom"], "bin", "n", "_rm").join(mean, "sample")
    return tracks.call_coverage(smooth, ["sample", "chrom"], "_rm", F.col("_mean"), width, 1, int(spec.get("gap", 0)), int(spec.get("sup", 0)))


def hanging_regions(aln: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Forward hanging reads followed by reverse ones, as insertions between them (semantics chosen here)."""
    hang = aln.filter(F.col("flag").bitwiseAND(1 + C.UNMAPPED + C.MATE_UNMAPPED + C.QC_FAIL + C.DUPLICATE) == 1 + C.MATE_UNMAPPED)
    width = int(spec.get("width", 250))
    found = paired_event_scan(hang.filter("strand = '+'"), hang.filter("strand = '-'"), ["sample", "chrom"], "pos", width, int(spec.get("minfwd", 2)), int(spec.get("minrev", 2)))
    return found.select("sample", "chrom", F.col("first_x").alias("start"), (F.col("first_x") + 2 * width).alias("end"), F.lit("INS").alias("svtype"), F.lit("hax").alias("method"))


def change_point_regions(aln: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Gains and losses of the case against the control between change points."""
    usable = aln.filter((F.col("flag").bitwiseAND(C.UNMAPPED + C.QC_FAIL + C.DUPLICATE) == 0) & F.col("chrom").isNotNull())
    found = changepoint.segments(usable.select("chrom", "pos", (F.col("sample") == "case").alias("is_case")))
    made = changepoint.change_point_calls(found, float(spec.get("minstat", 0)), int(spec.get("sup", 1500)), int(spec.get("gap", 1000)), int(spec.get("expand", 2000)), float(spec.get("good", 4)))
    return made.select("chrom", "start", "end", "svtype", "method")


def join_calls(aln: DataFrame, score_tracks: DataFrame, events: DataFrame | None, step: int, origin: int = 1,
               options: JoinOptions = JoinOptions(), libraries: DataFrame | None = None, scan_options: ScanOptions = ScanOptions()) -> tuple[DataFrame, DataFrame]:
    """Raw and confirmed region calls from every kind of evidence.

    Pairs count as big deletions from the size at which the scan leaves them out: the option, or the limit of their
    library in ``libraries`` (the library table).  Without that table the libraries are learned from
    the reads; a model set in ``scan_options`` stands before the one learned, as in ``scan_libraries``.

    With a control each evidence keeps the case regions that overlap no control
    region.  Options may be given per sample, ``control:case``; both must name
    the same tracks.  An evidence whose option text is empty is left out; change points need a control.

    A track's ``method`` sets how ``thresh=levelN`` becomes a threshold: ``robust`` (and ``empr``) the median plus N
    scaled deviations; ``boot`` the resampled quantile of window maxima and ``theo`` the scan's theory, summed over the
    fit libraries, both at the error rate 10 ** -N; ``value``, or a plain number, is taken as it is.  Other methods are errors.
    Small insertions and deletions need ``cvg`` reads and ``sup`` per cent of the reads over their first base.
    """
    per_sample = [[checked(spec, TRACK_WORDS) for spec in part] for part in parse_tracks(options.tracks)]
    if len(per_sample) > 2 or [s["track"] for s in per_sample[0]] != [s["track"] for s in per_sample[-1]]:
        raise ValueError("track options are control:case with the same tracks in the same order")
    wanted = parse_confirm(options.confirm)
    if unknown := wanted - CONFIRM_WORDS:
        raise ValueError(f"unknown confirmation {sorted(unknown)}; known are {sorted(CONFIRM_WORDS)}")
    found = []
    is_case = F.col("sample") == "case"

    def add(regions, control: dict[str, str], case: dict[str, str]) -> None:
        """``regions`` gives the regions of all samples by one sample's options."""
        cols = ["chrom", "start", "end", "svtype", "method"]
        ours, theirs = (regions(spec).filter(kept).select(*cols) for spec, kept in ((case, is_case), (control, ~is_case)))
        found.append(calls.region_difference(ours, theirs, ["chrom"]))

    def track_regions(spec: dict[str, str]) -> DataFrame:
        name, gap, support = spec["track"], int(spec.get("gap", 100)), int(spec.get("sup", 100))
        if name in ("ins", "del"):
            held = clips.indel_calls(aln, ["sample", "chrom"], int(spec.get("cvg", 5))).filter(F.col("svtype") == name.upper())
            over = intervals.count_overlaps(held, spans, ["sample", "chrom"], "start", "start", "start", "end", "_depth")
            return over.filter(F.col("nreads") * 100 >= F.col("_depth") * int(spec.get("sup", 0)))
        parts = name.split("+")
        return tracks.call_track(_margin(score_tracks, parts, spec, step, libraries, scan_options), ["sample", "chrom"], "_s", F.lit(0.0), step, origin, gap, support,
                                 "DEL", "lcd" if name == "lCd" else "ldx")

    spans = aln.filter(F.col("flag").bitwiseAND(C.UNMAPPED) == 0).select("sample", "chrom", F.col("pos").alias("start"), last_base(F.col("pos"), F.col("cigar"), F.col("flag")).alias("end"))
    for control, case in zip(per_sample[0], per_sample[-1]):
        add(track_regions, control, case)
    over = _from_big_deletion(aln, libraries, scan_options).filter(F.col("mchrom") == F.col("chrom")).select(
        "sample", "chrom", (F.col("pos") + F.col("qwidth") - 1).alias("start"), (F.col("pos") + F.col("isize") - F.col("qwidth")).alias("end")
    ).filter(F.col("start") <= F.col("end"))
    big_regions = lambda spec: calls.call_big_deletions(over, ["sample", "chrom"], int(spec["minmpr"]), int(spec["maxins"]))
    add(big_regions, *parse_sample_pairs(options.big, BIG_WORDS))
    for text, words, regions in ((options.discordant, BIG_WORDS, lambda spec: discordant_regions(aln, spec)), (options.coverage, COVERAGE_WORDS, lambda spec: coverage_regions(spans, spec)),
                                 (options.hanging, HANGING_WORDS, lambda spec: hanging_regions(aln, spec))):
        if text:
            add(regions, *parse_sample_pairs(text, words))
    if options.change_point:
        spec = checked(parse_pairs(options.change_point), CHANGE_WORDS)
        if aln.filter(~is_case).limit(1).count():
            found.append(change_point_regions(aln, spec))
    if events is not None:
        found.append(event_regions(events).select("chrom", "start", "end", "svtype", "method"))
    raw = found[0]
    for part in found[1:]:
        raw = raw.unionByName(part)
    raw = cut_lineage(raw.withColumn("id", F.concat_ws(":", "method", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "svtype")).distinct())
    return raw, calls.deduplicate(raw, strict="nostrict" not in wanted) if "dedup" in wanted else raw
