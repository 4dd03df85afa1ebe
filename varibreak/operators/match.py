"""Finding short patterns in a tiled genome with at most one mismatch.

A pattern with one mismatch keeps one of its halves intact.  Both half seeds are
equi-joined with the genome's k-mers and every candidate place is then verified
over the full pattern, so nothing is missed and nothing is aligned by scanning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut_lineage, dealt, shuffled, small, stored
from ..functions.dna import reverse_complement, within_one_mismatch
from .intervals import nearest_within, tile_of
from .words import LONGEST, asked_places, chunks, word_number

SEED = 15


def reference_tiles(pieces: DataFrame, size: int, overlap: int) -> DataFrame:
    """Regular tiles ``chrom, tile, start, seq`` of ``size`` bases plus ``overlap`` bases of what follows.

    ``pieces`` has ``chrom, start, seq`` in any cut (1-based start).  Every piece
    is spread over the tiles it reaches and each tile glues its own pieces.
    """
    end = F.col("start") + F.length("seq") - 1
    first, last = tile_of(F.col("start") - 1 - overlap, size), tile_of(end - 1, size)
    spread = pieces.withColumn("tile", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    lo, hi = F.col("tile") * size + 1, (F.col("tile") + 1) * size + overlap
    begin = F.greatest("start", lo)
    cut = F.col("seq").substr((begin - F.col("start") + 1).cast("int"), (F.least(end, hi) - begin + 1).cast("int"))
    parts = spread.select("chrom", "tile", F.struct(begin.alias("at"), cut.alias("s")).alias("p"))
    # a tile holds size + overlap bases, so its list of pieces is bounded
    glued = parts.groupBy("chrom", "tile").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return glued.select("chrom", "tile", (F.col("tile") * size + 1).alias("start"), F.array_join(F.transform("ps", lambda x: x["s"]), "").alias("seq"))


def fetch_subsequence(regions: DataFrame, tiles: DataFrame, size: int, start: str, end: str, name: str = "subseq") -> DataFrame:
    """Bases ``start..end`` of each region; tiles must overlap by the longest region."""
    lo = F.greatest(F.col(start), F.lit(1))
    asked = regions.withColumn("tile", tile_of(lo - 1, size))
    found = asked.join(shuffled(tiles.select("chrom", "tile", F.col("start").alias("_ts"), F.col("seq").alias("_seq"))), ["chrom", "tile"], "left")
    cut = F.col("_seq").substr((lo - F.col("_ts") + 1).cast("int"), (F.col(end) - lo + 1).cast("int"))
    return found.withColumn(name, cut).drop("_ts", "_seq", "tile")


def find_matches(patterns: DataFrame, tiles: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """All places of each pattern with at most one mismatch: ``pid, chrom, mstart, mend``.

    ``patterns`` has ``pid, pattern`` of at least two bases; the seeds of one shorter than ``2 * seed`` bases are its
    halves.  Tiles must overlap by the longest pattern.  Equal patterns are searched once.
    """
    text = patterns.select("pattern").distinct()
    half = F.floor(F.length("pattern") / 2).cast("int")
    text = text.filter(F.when(half >= 1, True).otherwise(F.raise_error(F.lit("a pattern has two bases at least")).cast("boolean")))
    text = text.withColumn("_k", F.least(half, F.lit(min(seed, LONGEST))))
    seeds = text.select("pattern", "_k", F.explode(F.array(F.lit(0), half)).alias("off")).select(
        "pattern", "off", "_k", F.col("pattern").substr(F.col("off") + 1, F.col("_k")).alias("kmer")
    )
    lengths = F.array(*[F.lit(r["_k"]) for r in text.select("_k").distinct().collect()] or [F.lit(seed)])  # ``seed`` numbers at most
    own = F.sequence(F.lit(1), F.least(F.lit(size), F.length("seq") - (F.col("_k") - 1)))
    # words of the four letters are looked up where the tiles are read; what is spread out below has others
    seeds, odd = cut_lineage(seeds), F.col("kmer").rlike("[^ACGT]")
    asked = seeds.filter(~odd).withColumn("number", word_number(F.col("kmer"))).select("pattern", "off", F.col("_k").cast("int").alias("k"), "number")
    kmers = tiles.filter(F.col("seq").rlike("[^ACGT]")).select("chrom", "start", "seq", F.explode(lengths).alias("_k")).filter(F.length("seq") >= F.col("_k"))
    kmers = kmers.select("chrom", F.col("start").alias("_ts"), "seq", "_k", F.explode(own).alias("_i")).select(
        "chrom", (F.col("_ts") + F.col("_i") - 1).alias("at"), "_k", F.col("seq").substr(F.col("_i"), F.col("_k")).alias("kmer")
    )
    # only k-mers that some pattern asks for travel on
    met = [shuffled(asked_places(tiles, size, asked)).join(small(asked), ["k", "number"]), shuffled(kmers.filter(odd)).join(small(seeds.filter(odd)), ["_k", "kmer"])]
    places = [df.select("pattern", "chrom", (F.col("at") - F.col("off")).alias("mstart")) for df in met]
    places = places[0].unionByName(places[1]).filter("mstart >= 1").distinct()
    sized = places.withColumn("mend", F.col("mstart") + F.length("pattern") - 1)
    seen = fetch_subsequence(sized, tiles, size, "mstart", "mend")
    verified = seen.filter(within_one_mismatch(F.col("subseq"), F.col("pattern"))).select("pattern", "chrom", "mstart", "mend")
    return patterns.join(verified, "pattern").select("pid", "chrom", "mstart", "mend")


def keep_rare(matches: DataFrame, below: int) -> DataFrame:
    """Matches of patterns with fewer than ``below`` matches in total.

    The count is an aggregate joined back, not a window, so a repetitive pattern
    never collects in one task.
    """
    rare = matches.groupBy("pid").agg(F.count("*").alias("n_match")).filter(F.col("n_match") < below)
    return matches.join(rare, "pid")


@F.pandas_udf(StructType([StructField("n", IntegerType()), StructField("at", IntegerType())]))
def _occurrences(text: pd.Series, pattern: pd.Series) -> pd.DataFrame:
    """How often, and first where (from 1), a pattern stands in a text with at most one mismatch."""
    letters = lambda s: np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
    found = []
    for whole, part in zip(text, pattern):
        places = 0 if whole is None or part is None else len(whole) - len(part) + 1
        if places < 1:
            found.append((0, None))
            continue
        whole, differing = letters(whole), np.zeros(places, dtype=np.int32)
        for i, letter in enumerate(letters(part)):
            differing += whole[i:i + places] != letter
        hits = np.flatnonzero(differing <= 1)
        found.append((len(hits), int(hits[0]) + 1 if len(hits) else None))
    n, at = zip(*found) if found else ((), ())
    return pd.DataFrame({"n": pd.array(n, dtype="Int32"), "at": pd.array(at, dtype="Int32")})


def count_in_window(queries: DataFrame, tiles: DataFrame, size: int, center: str, pattern: str, window: int) -> DataFrame:
    """Occurrences with at most one mismatch inside ``center +- window``: adds ``n_remap, remap_at``.

    ``remap_at`` is the 1-based place inside the window of the first occurrence.
    Tiles must overlap by ``2 * window + 1`` bases.
    """
    asked = queries.withColumn("_lo", F.col(center) - window).withColumn("_hi", F.col(center) + window)
    held = fetch_subsequence(asked, tiles, size, "_lo", "_hi", "_home")
    cut = F.greatest(F.lit(0), 1 - F.col("_lo"))  # bases missing before the contig
    held = held.withColumn("_hits", _occurrences("_home", pattern))
    return held.withColumn("n_remap", F.col("_hits.n")).withColumn("remap_at", F.col("_hits.at") + cut).drop("_lo", "_hi", "_home", "_hits")


def remap_clusters(clusters: DataFrame, tiles: DataFrame, size: int, max_matches: int, max_distance: int, min_length: int,
                   window: int) -> DataFrame:
    """Breakends from clip clusters whose consensus maps elsewhere and whose target maps back.

    ``clusters`` has ``chrom, side, position, consensus``.  The consensus itself
    is matched against the opposite side's clusters near the end of the match,
    its reverse complement against the same side's near the start.  The target
    consensus (reverse-complemented in the second case) must then occur exactly
    once within ``window`` of the home position.
    """
    cid = F.concat_ws(":", "side", "chrom", F.col("position").cast("string"))
    home = clusters.withColumn("cid", cid).filter(F.length("consensus") > min_length)
    wanted = home.select(
        "cid", "chrom", "side", "position",
        F.explode(F.array(
            F.struct(F.lit(False).alias("rc"), F.col("consensus").alias("pattern")),
            F.struct(F.lit(True).alias("rc"), reverse_complement(F.col("consensus")).alias("pattern")),
        )).alias("_o"),
    ).select(F.struct("cid", "_o.rc").alias("pid"), F.col("chrom").alias("home_chrom"), F.col("side").alias("home_side"),
             F.col("position").alias("home_pos"), "_o.pattern")
    # genome-wide matches are counted, placed and looked up: written once
    places = keep_rare(cut_lineage(find_matches(wanted.select("pid", "pattern"), tiles, size)), max_matches)
    placed = places.join(wanted.drop("pattern"), "pid")
    rc = F.col("pid.rc")
    opposite = F.when(F.col("home_side") == "L", F.lit("R")).otherwise(F.lit("L"))
    placed = placed.withColumn("side", F.when(rc, F.col("home_side")).otherwise(opposite)).withColumn(
        "target", F.when(rc, F.col("mstart")).otherwise(F.col("mend"))
    )
    targets = clusters.withColumn("cid", cid)
    near = nearest_within(placed, targets, ["chrom", "side"], "target", "position", max_distance - 1,
                          {"mcid": F.col("cid"), "mconsensus": F.col("consensus")}).filter("dist IS NOT NULL")
    back = cut_lineage(near).select(
        F.col("pid.cid").alias("cid"), rc.alias("rc"), F.col("home_chrom").alias("chrom"), "home_pos", "home_side",
        F.col("chrom").alias("chr2"), F.col("target").alias("pos2"), "mcid", "dist",
        F.when(rc, reverse_complement(F.col("mconsensus"))).otherwise(F.col("mconsensus")).alias("_dest"),
    )
    unique = count_in_window(back, tiles, size, "home_pos", "_dest", window).filter("n_remap = 1")
    left = F.col("home_side") == "L"
    return unique.select(
        F.col("chrom").alias("chr1"), F.col("home_pos").alias("pos1"), left.alias("goRight1"), "chr2", "pos2",
        F.when(F.col("rc"), left).otherwise(~left).alias("goRight2"), "cid", "mcid", "rc",
    )



WORD_LETTERS = 18  # the longest word whose letters, as decimal digits, fit a long
PART_WORDS = 1_000_000  # of a part that counts
WORDS_KEPT = 4_000_000  # counted words a task holds before it sums them up
_WORDS = ("codes", "firsts", "lasts", "ns")


def _count_words(codes, firsts, lasts, ns):
    """Equal codes as one: sorted codes, first and last places, counts."""
    if not len(codes):
        return codes, firsts, lasts, ns
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return (codes[heads], np.minimum.reduceat(firsts[order], heads), np.maximum.reduceat(lasts[order], heads), np.add.reduceat(ns[order], heads))


def _planes(numbers) -> bytes:
    """Longs as all their first bytes, then all second ones and so on: bytes they share lie together and compress away."""
    return numbers.astype(">i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes):
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(">i8").ravel().astype(np.int64)


def _pack_words(size: int, word: int, buckets: int):
    """Tiles of the four letters into rows per chromosome and bucket of codes, some ``LETTERS`` letters at a time."""

    def pack(batches):
        schema = pa.schema([("chrom", pa.string()), ("_bucket", pa.int64()), *[(n, pa.binary()) for n in _WORDS]])
        for batch in batches:
            chroms, starts = np.array(batch["chrom"].to_pylist()), batch["start"].to_numpy()
            for chrom in np.unique(chroms):
                mine = np.flatnonzero(chroms == chrom)
                for first, chunk in chunks(batch["seq"].take(pa.array(mine)).to_pylist()):
                    begins = chunk.whole(size, word)
                    code = np.zeros(len(begins), np.int64)
                    for i in range(word):
                        code = code * 10 + chunk.digits[begins + i]
                    at = starts[mine[first + chunk.row[begins]]] + chunk.place[begins]
                    del chunk, begins
                    counted = _count_words(code, at, at, np.ones(len(at), np.int64))
                    order = np.argsort(counted[0] % buckets, kind="stable")
                    counted = [v[order] for v in counted]
                    edges = np.searchsorted(counted[0] % buckets, np.arange(buckets + 1))
                    rows = {n: [] for n in schema.names}
                    for b in np.flatnonzero(edges[1:] > edges[:-1]):
                        one = [v[edges[b]:edges[b + 1]] for v in counted]
                        single = one[3].max() == 1
                        rows["chrom"].append(str(chrom))
                        rows["_bucket"].append(int(b))
                        for n, v in zip(_WORDS, one):
                            rows[n].append(b"" if single and n in ("lasts", "ns") else _planes(v))
                    yield pa.RecordBatch.from_pydict(rows, schema)

    return pack


def _repeated_codes(batches):
    """Sums up the rows of ``_pack_words`` in a part that holds all of its buckets; words found once are left out."""
    held, waiting = {}, {}
    for batch in batches:
        for row in batch.to_pylist():
            codes, firsts = _numbers(row["codes"]), _numbers(row["firsts"])
            lasts = _numbers(row["lasts"]) if row["lasts"] else firsts
            ns = _numbers(row["ns"]) if row["ns"] else np.ones(len(codes), np.int64)
            held.setdefault(row["chrom"], []).append((codes, firsts, lasts, ns))
            waiting[row["chrom"]] = waiting.get(row["chrom"], 0) + len(codes)
            if waiting[row["chrom"]] > WORDS_KEPT:
                held[row["chrom"]] = [_count_words(*map(np.concatenate, zip(*held[row["chrom"]])))]
                waiting[row["chrom"]] = 0
    for chrom, parts in held.items():
        codes, firsts, lasts, ns = _count_words(*map(np.concatenate, zip(*parts)))
        kept = np.flatnonzero(ns > 1)
        for i in range(0, len(kept), 50_000):
            own = kept[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(own), pa.string()), *[pa.array(v[own]) for v in (codes, ns, firsts, lasts)]],
                                             names=["chrom", "_code", "n", "first_at", "last_at"])


def repeated_words(tiles: DataFrame, size: int, word: int) -> DataFrame:
    """Words occurring more than once per chromosome with their count and outer places; tiles overlap by ``word - 1``."""
    places = F.least(F.lit(size), F.length("seq") - (word - 1))
    # read for the number of words and for either kind of them
    tiles = stored(tiles.filter(F.length("seq") >= word).select("chrom", "start", "seq"))
    # four letters as digits: up to ``WORD_LETTERS`` of them read as one decimal number, which travels in few bytes
    digits, number = F.translate("seq", "ACGT0123", "0123____"), "^[0-3]+$"
    whole = digits.rlike(number)
    at = (F.col("start") + F.col("_i") - 1).alias("at")
    cut = lambda text: F.col(text).substr(F.col("_i"), F.lit(word))
    spread = lambda df: df.select("chrom", "start", "seq", "_digits", "_whole", F.explode(F.sequence(F.lit(1), places)).alias("_i"))
    coded = tiles.withColumn("_digits", digits).withColumn("_whole", whole if word <= WORD_LETTERS else F.lit(False))
    is_number = (F.col("_whole") | cut("_digits").rlike(number)) if word <= WORD_LETTERS else F.lit(False)
    other = spread(coded.filter("NOT _whole")).filter(~is_number).select("chrom", cut("seq").alias("kmer"), at)
    repeated = other.groupBy("chrom", "kmer").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).filter("n > 1")
    if word > WORD_LETTERS:
        return repeated
    # whole tiles are counted in arrays, a batch at a time; buckets of words meet in parts of bounded length
    words = tiles.agg(F.sum(places)).first()[0] or 0
    buckets = 4 * -(-words // PART_WORDS) + 64
    packed = coded.filter("_whole").select("chrom", "start", "seq").mapInArrow(
        _pack_words(size, word, buckets), "chrom string, _bucket long, " + ", ".join(f"{n} binary" for n in _WORDS))
    numbers = spread(coded.filter("NOT _whole")).filter(is_number).select("chrom", cut("_digits").cast("long").alias("_code"), at)
    eight = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    nothing = F.unhex(F.lit(""))
    single = numbers.select(
        "chrom", F.pmod("_code", F.lit(buckets)).cast("long").alias("_bucket"), eight(F.col("_code")).alias("codes"),
        eight(F.col("at").cast("long")).alias("firsts"), nothing.alias("lasts"), nothing.alias("ns"))
    counted = dealt(packed.unionByName(single), words, "_bucket", most=PART_WORDS).mapInArrow(
        _repeated_codes, "chrom string, _code long, n long, first_at long, last_at long")
    letters = F.translate(F.lpad(F.col("_code").cast("string"), word, "0"), "0123", "ACGT")
    return counted.select("chrom", letters.alias("kmer"), "n", "first_at", "last_at").unionByName(repeated)
