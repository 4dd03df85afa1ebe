"""Exact matches of sequences of any length, maximal exact seeds, and alignments with gaps grown from them.

A maximal match of ``least`` bases or more is a run of consecutive shared words of that length on one diagonal (place in
the genome less place in the sequence), so seeds are an equi-join of words followed by gaps and islands along diagonals;
a partition of that window holds at most as many rows as the sequence has bases.  Words with other letters than A, C, G, T
match nothing.  Nothing is capped: a word that occurs everywhere meets every place, and skewed joins split its rows.

Seeds near each other are chained (growing in both sequences, diagonals within a band), and each best chain is aligned
end to end by affine-gap dynamic programming inside a band around its diagonals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cigar import REFERENCE_LENGTH_CLASS, aligned_length
from ..functions.dna import reverse_complement
from ..session import cut_lineage, dealt, shuffled, small
from .intervals import tile_of
from .words import LONGEST, asked_places, chunks, packed, word_number

SEED = 20


def fetch_long(regions: DataFrame, tiles: DataFrame, size: int, start: str, end: str, key: list[str], name: str = "subseq") -> DataFrame:
    """``key`` with the bases ``start..end`` of each region, of any length; bases that the reference lacks are left out.

    ``key`` tells regions apart; each is put together from the ``size`` own bases of the tiles it touches.
    """
    lo = F.greatest(F.col(start), F.lit(1))
    asked = regions.filter(F.col(end) >= lo).select(*key, "chrom", lo.alias("_lo"), F.col(end).alias("_hi"))
    asked = asked.withColumn("tile", F.explode(F.sequence(tile_of(F.col("_lo") - 1, size), tile_of(F.col("_hi") - 1, size))))
    found = asked.join(shuffled(tiles.select("chrom", "tile", F.col("start").alias("_ts"), "seq")), ["chrom", "tile"])
    begin = F.greatest("_lo", "_ts")
    count = F.least(F.col("_hi"), F.col("_ts") + size - 1) - begin + 1
    piece = F.substring("seq", (begin - F.col("_ts") + 1).cast("int"), count.cast("int"))
    glued = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("tile", piece.alias("s")))).alias("_p"))
    return glued.select(*key, F.array_join(F.transform("_p", lambda x: x["s"]), "").alias(name))


def _words(tiles: DataFrame, size: int, lengths: list[int]) -> DataFrame:
    """``chrom, at, k, word`` of every place; tiles overlap by the longest word less one."""
    n = F.array(*map(F.lit, lengths))
    own = tiles.select("chrom", F.col("start").alias("_ts"), "seq", F.explode(n).alias("k")).filter(F.length("seq") >= F.col("k"))
    own = own.select("chrom", "_ts", "seq", "k", F.explode(F.sequence(F.lit(1), F.least(F.lit(size), F.length("seq") - F.col("k") + 1))).alias("_i"))
    words = own.select("chrom", (F.col("_ts") + F.col("_i") - 1).alias("at"), "k", F.substring("seq", F.col("_i"), F.col("k")).alias("word"))
    return words.filter(~F.col("word").rlike("[^ACGT]"))


def exact_matches(patterns: DataFrame, tiles: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """``pid, chrom, mstart, mend`` of every place of each pattern (``pid, pattern``; one base or more, A, C, G, T).

    The first ``seed`` bases (all of a shorter pattern) find the places, the whole pattern is then compared.  Equal
    patterns are searched once; tiles must overlap by ``seed - 1`` bases at least.
    """
    text = patterns.filter(F.length("pattern") > 0).select("pattern").distinct()
    text = text.select(F.md5("pattern").alias("tid"), "pattern", F.least(F.length("pattern"), F.lit(min(seed, LONGEST))).alias("k"))
    lengths = sorted(r.k for r in text.select("k").distinct().collect())  # at most ``seed`` numbers
    if not lengths:
        return patterns.select("pid", F.lit("").alias("chrom"), F.lit(0).cast("long").alias("mstart"), F.lit(0).cast("long").alias("mend")).limit(0)
    asked = text.select("tid", "k", F.length("pattern").alias("m"), F.substring("pattern", F.lit(1), F.col("k")).alias("word"))
    asked = cut_lineage(asked.filter(~F.col("word").rlike("[^ACGT]")).withColumn("number", word_number(F.col("word"))))
    places = shuffled(asked_places(tiles, size, asked)).join(small(asked), ["k", "number"]).select("tid", "chrom", F.col("at").alias("mstart"), (F.col("at") + F.col("m") - 1).alias("mend"), (F.col("m") > F.col("k")).alias("open"))
    places = cut_lineage(places)
    seen = fetch_long(places.filter("open"), tiles, size, "mstart", "mend", ["tid", "chrom", "mstart", "mend"])
    whole = seen.join(text.select("tid", "pattern"), "tid").filter(F.col("subseq") == F.col("pattern")).select("tid", "chrom", "mstart", "mend")
    found = whole.unionByName(places.filter("NOT open").select("tid", "chrom", "mstart", "mend"))
    return patterns.select("pid", F.md5("pattern").alias("tid")).join(found, "tid").select("pid", "chrom", "mstart", "mend")


def maximal_matches(patterns: DataFrame, tiles: DataFrame, size: int, least: int = SEED, both_strands: bool = True) -> DataFrame:
    """``tid, strand, chrom, qstart, rstart, length`` of all maximal exact matches of ``least`` bases or more.

    ``tid`` is the MD5 of the pattern; with strand "-" places count in its reverse complement.  Tiles must overlap by
    ``least - 1`` bases at least.  A match cannot be made longer at either end.
    """
    text = patterns.select("pattern").distinct().select(F.md5("pattern").alias("tid"), "pattern")
    sides = [F.struct(F.lit("+").alias("strand"), F.col("pattern").alias("s"))]
    if both_strands:
        sides.append(F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("pattern")).alias("s")))
    own = text.select("tid", F.explode(F.array(*sides)).alias("x")).select("tid", "x.strand", "x.s").filter(F.length("s") >= least)
    own = own.select("tid", "strand", "s", F.explode(F.sequence(F.lit(1), F.length("s") - least + 1)).alias("q"))
    own = own.select("tid", "strand", "q", F.substring("s", F.col("q"), F.lit(least)).alias("word")).filter(~F.col("word").rlike("[^ACGT]"))
    if least <= LONGEST:
        own = cut_lineage(own.select("tid", "strand", "q", F.lit(least).alias("k"), word_number(F.col("word")).alias("number")))
        met = shuffled(asked_places(tiles, size, own)).join(small(own), "number")
    else:
        met = shuffled(_words(tiles, size, [least])).join(small(own), "word")
    hits = met.select("tid", "strand", "chrom", (F.col("at") - F.col("q")).alias("diag"), "q")
    order = Window.partitionBy("tid", "strand", "chrom", "diag").orderBy("q")
    runs = hits.withColumn("_run", F.col("q") - F.row_number().over(order))
    return runs.groupBy("tid", "strand", "chrom", "diag", "_run").agg(F.min("q").alias("qstart"), F.count("*").alias("n")).select(
        "tid", "strand", "chrom", "qstart", (F.col("diag") + F.col("qstart")).alias("rstart"), (F.col("n") + least - 1).cast("int").alias("length"))


def similar_words(tiles: DataFrame, contigs: DataFrame, size: int, word: int = 36, mismatches: int = 4, middle: int = 5) -> DataFrame:
    """``chrom, word_at, at, differing``: where a contig's words stand again with a few mismatches (a self-similarity plot).

    Words are those at places 1, 1 + ``word``, 1 + 2 ``word`` and so on, of which at least one base follows; every place
    of the contig is compared.  The ``middle`` bases from place ``word // 2 - 2`` of a word must agree.  The other bases are
    cut into ``mismatches + 1`` blocks, one of which agrees, so words meet under a block with the middle; a pair counts
    under its first agreeing block only.  Words with other letters than A, C, G, T are left out; tiles must overlap by
    ``word - 1`` bases.

    A contig's asking words and its places meet stretch by stretch (``PART_WORDS``, ``PART_PLACES``), every stretch with
    every other of the contig; their texts travel and words are made where they meet.
    """
    first = word // 2 - 2  # 1-based
    others = [i for i in range(1, word + 1) if not first <= i < first + middle]
    cut = [others[len(others) * k // (mismatches + 1) : len(others) * (k + 1) // (mismatches + 1)] for k in range(mismatches + 1)]
    texts = tiles.select("chrom", F.col("start").cast("long").alias("start"), F.substring("seq", 1, size + word - 1).alias("seq"))
    texts = texts.filter((F.length("seq") >= word) & F.col("chrom").isNotNull())
    # both sides of a pair of stretches are texts; words are made of them where they meet
    ends = cut_lineage(texts.groupBy("chrom").agg(F.max("start").alias("_end"), F.sum(F.length("seq")).alias("_letters")))
    letters = ends.agg(F.sum("_letters")).first()[0] or 0
    part = min(max(letters // (2 * tiles.sparkSession.sparkContext.defaultParallelism), PART_PLACES[0]), PART_PLACES[1])
    many = lambda last, step: F.sequence(F.lit(0).cast("long"), F.floor(last / step).cast("long"))
    asks = word * PART_WORDS
    block = lambda step: F.floor(F.col("start") / step).cast("long")
    own = texts.join(small(contigs.select("chrom", F.col("length").cast("long").alias("_n"))), "chrom").join(small(ends), "chrom")
    own = own.select("chrom", block(asks).alias("_own"), F.explode(many(F.col("_end"), part)).alias("_part"), F.lit(0).alias("_kind"), "start", "_n", "seq")
    met = texts.join(small(ends), "chrom").select(
        "chrom", F.explode(many(F.col("_end"), asks)).alias("_own"), block(part).alias("_part"), F.lit(1).alias("_kind"), "start", F.lit(None).cast("long").alias("_n"), "seq")
    pairs = ["chrom", "_own", "_part"]
    # a pair of stretches is in one part: its asking texts come first, what they are compared with streams
    held = own.unionByName(met)
    parts = max(1, (ends.select(F.sum((F.floor(F.col("_end") / part) + 1) * (F.floor(F.col("_end") / asks) + 1))).first()[0] or 0))
    dealt = held.repartition(int(min(4 * parts, 10_000)), *pairs).sortWithinPartitions(*pairs, "_kind")
    kind = dict(tiles.dtypes)["start"]
    found = dealt.mapInArrow(_similar(size, word, mismatches, [range(first - 1, first - 1 + middle), *[[i - 1 for i in k] for k in cut]]),
                             "chrom string, word_at long, at long, differing int")
    return found.select("chrom", F.col("word_at").cast(kind).alias("word_at"), F.col("at").cast(kind).alias("at"), "differing")


PART_PLACES = (1 << 20, 1 << 24)  # compared at least and at most in a pair of stretches
PART_WORDS = 1 << 21  # that ask in a pair of stretches
PAIRS_AT_ONCE = 1 << 20


def _limbs(chunk, begins, word):
    """Words as numbers of 32 letters, two bits a letter."""
    return [packed(np.append(chunk.digits[i:], np.zeros(i, np.uint8)), min(32, word - i))[begins] for i in range(0, word, 32)]


def _similar(size: int, word: int, mismatches: int, agreeing: list):
    """Finds the pairs of one stretch's asking words and another's places; ``agreeing`` has the places of the middle and of the blocks."""
    limbs = range(0, word, 32)
    mask = lambda places: [np.uint64(sum(1 << 2 * (p - i) for p in places if i <= p < i + 32)) for i in limbs]
    middle, *blocks = map(mask, agreeing)
    odd = [np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

    def hashes(own, block, bits):
        """Equal for words that agree in the middle and the block."""
        total = np.zeros(len(own[0]), np.uint64)
        for i, x in enumerate(own):
            total += (x & ((middle[i] | block[i]) * np.uint64(3))) * odd[i % 4]
            total ^= total >> np.uint64(29)
        return (total * odd[1]) >> np.uint64(64 - bits)

    def asking(starts, lengths, texts):
        for first, chunk in chunks(texts):
            begins = chunk.whole(size, word)
            places = starts[first + chunk.row[begins]] + chunk.place[begins]
            mine = (places % word == 1) & (places <= lengths[first + chunk.row[begins]] - word)
            yield places[mine], *_limbs(chunk, begins[mine], word)

    def index(words):
        """Words that ask, and for each block the words ordered by hash with the first of every hash."""
        at, *own = map(np.concatenate, zip(*words)) if words else (np.zeros(0, np.int64), *[np.zeros(0, np.uint64) for _ in limbs])
        bits = min(max((2 * len(at)).bit_length(), 8), 22)
        order = []
        for block in blocks:
            h = hashes(own, block, bits)
            order.append((np.argsort(h, kind="stable").astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(h.astype(np.int64), minlength=1 << bits))]).astype(np.int32)))
        return at, own, bits, order

    def compare(held, starts, texts):
        at, own, bits, order = held
        for first, chunk in chunks(texts):
            begins = chunk.whole(size, word)
            here = _limbs(chunk, begins, word)
            for k, block in enumerate(blocks):
                sorted_words, heads = order[k]
                h = hashes(here, block, bits).astype(np.int64)
                low, n = heads[h].astype(np.int64), (heads[h + 1] - heads[h]).astype(np.int64)
                some = np.flatnonzero(n)
                low, n = low[some], n[some]
                upto = np.cumsum(n)
                total = int(upto[-1]) if len(upto) else 0
                for lo in range(0, total, PAIRS_AT_ONCE):
                    hi = min(lo + PAIRS_AT_ONCE, total)
                    a, b = np.searchsorted(upto, lo, "right"), np.searchsorted(upto, hi - 1, "right") + 1
                    before = upto[a:b] - n[a:b]
                    skip, end = np.maximum(before, lo), np.minimum(upto[a:b], hi)
                    count = end - skip
                    run = np.repeat(low[a:b] + skip - before, count) + np.arange(hi - lo) - np.repeat(np.cumsum(count) - count, count)
                    place, asked = np.repeat(some[a:b], count), sorted_words[run]
                    apart = []
                    for x, y in zip(here, own):
                        d = x[place] ^ y[asked]
                        apart.append((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555))
                    differing = sum(np.bitwise_count(d) for d in apart)
                    agrees = lambda places: ~np.logical_or.reduce([(d & m) != 0 for d, m in zip(apart, places)])
                    keep = (differing <= mismatches) & agrees(middle) & agrees(block)
                    for earlier in blocks[:k]:
                        keep &= ~agrees(earlier)
                    if keep.any():
                        found = begins[place[keep]]
                        yield at[asked[keep]], starts[first + chunk.row[found]] + chunk.place[found], differing[keep].astype(np.int32)

    def find(batches):
        pair, words, held = None, [], None
        for batch in batches:
            columns = {n: batch[n] for n in ("chrom", "_own", "_part", "_kind")}
            keys = list(zip(*(c.to_pylist() for c in columns.values())))
            starts, lengths = (batch[n].to_numpy(zero_copy_only=False) for n in ("start", "_n"))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                *now, kind = keys[a]
                if now != pair:
                    pair, words, held = now, [], None
                texts = batch["seq"].slice(a, b - a).to_pylist()
                if kind == 0:
                    words.extend(asking(starts[a:b], lengths[a:b], texts))
                    continue
                if held is None:
                    held, words = index(words), []
                if len(held[0]):
                    for word_at, at, differing in compare(held, starts[a:b], texts):
                        yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(at), pa.string()), pa.array(word_at), pa.array(at), pa.array(differing)], ["chrom", "word_at", "at", "differing"])

    return find


# ---------------------------------------------------------------- chains and alignment

# scores of a base that agrees or not, of opening a gap and of each of its bases
AGREE, DIFFER, OPEN, EXTEND = 1, -4, -6, -1
ALIGNED = 5_000  # places that a task aligns


def best_chain(seeds: list[tuple[int, int, int]], band: int) -> list[tuple[int, int, int]]:
    """The seeds (place in the sequence, in the genome, length) of most bases that grow in both and stay within a band.

    Overlapping seeds count their new bases only; of equal chains the one that ends first is taken.
    """
    seeds = sorted(seeds)
    score, back = [s[2] for s in seeds], [-1] * len(seeds)
    for j, (q, r, n) in enumerate(seeds):
        for i in range(j):
            qi, ri, ni = seeds[i]
            if q > qi and r > ri and abs((r - q) - (ri - qi)) <= band:
                new = n - max(0, qi + ni - q, ri + ni - r)
                if new > 0 and score[i] + new > score[j]:
                    score[j], back[j] = score[i] + new, i
    at = max(range(len(seeds)), key=lambda j: (score[j], -j))
    chain = []
    while at >= 0:
        chain.append(seeds[at])
        at = back[at]
    return chain[::-1]


def align_banded(query: str, ref: str, low: int, high: int) -> tuple[int, int, str] | None:
    """Best score, first reference place (from 0) and CIGAR of the whole query against a part of ``ref``.

    Only cells whose reference place less query place lies in ``low..high`` count.  Gaps are affine; a row's cells are
    computed at once, the gaps along it by running maxima.  Ties prefer a diagonal step, then a deletion, then an
    insertion, and the leftmost end.  None if no cell of the last row lies in the band.
    """
    # where every base agrees no path scores more, and the leftmost such place is the leftmost end
    at = ref.find(query, max(low, 0)) if query and not query.strip("ACGT") else -1
    if 0 <= at <= high:
        return AGREE * len(query), at, f"{len(query)}M"
    return _banded(query, ref, low, high)


def _banded(query: str, ref: str, low: int, high: int) -> tuple[int, int, str] | None:
    """``align_banded`` by its table."""
    m, n = len(query), len(ref)
    q, r = np.frombuffer(query.encode(), np.uint8), np.frombuffer(ref.encode(), np.uint8)
    width = high - low + 1
    none = -(1 << 40)
    col = np.arange(width)
    # cell k of row i is the state before reference place i + low + k, the query's first i bases used
    best = np.full((m + 1, width), none, dtype=np.int64)
    ins = np.full(width, none, dtype=np.int64)  # gap in the reference, for the row at hand
    gone = np.zeros((m + 1, width), dtype=np.int64)  # bases deleted to reach a cell, 0 where none
    kept_ins = np.zeros((m + 1, width), dtype=np.int64)  # bases inserted to reach a cell
    how = np.zeros((m + 1, width), dtype=np.int8)  # 0 diagonal, 1 deletion, 2 insertion
    first = low + col
    best[0, (first >= 0) & (first <= n)] = 0
    run = np.zeros(width, dtype=np.int64)
    for i in range(1, m + 1):
        place = i + low + col
        inside = (place >= 0) & (place <= n)
        diagonal = np.full(width, none, dtype=np.int64)
        ok = inside & (place >= 1)
        agree = r[place[ok] - 1] == q[i - 1] if n else np.zeros(0, bool)
        letter = q[i - 1] in (65, 67, 71, 84)
        diagonal[ok] = best[i - 1, ok] + np.where(agree & letter, AGREE, DIFFER)
        # an insertion comes from the same reference place in the row before, which is one cell to the right
        above, longer = np.append(best[i - 1, 1:], none) + OPEN + EXTEND, np.append(ins[1:], none) + EXTEND
        run = np.where(longer > above, np.append(run[1:], 0) + 1, 1)
        ins = np.where(inside, np.maximum(above, longer), none)
        state = np.maximum(diagonal, ins)
        # a deletion comes from a cell to the left: best over k' < k of state[k'] + OPEN + EXTEND * (k - k')
        lifted = state - EXTEND * col
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.where(np.append(True, reach[1:] > reach[:-1]), col, 0), 0))
        gap = np.full(width, none, dtype=np.int64)
        gap[1:] = reach[:-1] + OPEN + EXTEND * col[1:]
        gap = np.where(inside & (gap > none // 2), gap, none)
        row = np.maximum(state, gap)
        best[i] = row
        how[i] = np.where(row == diagonal, 0, np.where(row == gap, 1, 2))
        gone[i, 1:] = (col[1:] - source[:-1])
        kept_ins[i] = run
    last = best[m]
    if last.max() <= none // 2:
        return None
    k = int(last.argmax())
    score, i, steps = int(last[k]), m, []
    came = None  # a deletion ends in the state it came from, which is no deletion
    while i > 0:
        kind = int(how[i, k]) if came is None else came
        came = None
        if kind == 0:
            steps.append((1, "M"))
            i -= 1
        elif kind == 1:
            size = int(gone[i, k])
            steps.append((size, "D"))
            k -= size
            came = 2 if how[i, k] == 2 else 0 if how[i, k] == 0 else None
        else:
            size = int(kept_ins[i, k])
            steps.append((size, "I"))
            i -= size
            k += size
    merged: list[list] = []
    for size, op in reversed(steps):
        if merged and merged[-1][1] == op:
            merged[-1][0] += size
        else:
            merged.append([size, op])
    return score, low + k, "".join(f"{size}{op}" for size, op in merged)


def align_with_gaps(patterns: DataFrame, tiles: DataFrame, size: int, least: int = SEED, band: int = 32, min_score: int = 0) -> DataFrame:
    """``pid, strand, chrom, mstart, mend, cigar, score`` of each pattern at every place where seeds chain.

    Seeds of a sequence no further apart on the genome than its length plus the band form a place; its best chain sets
    the band.  The whole pattern is aligned, so the CIGAR has no clips; N agrees with nothing.
    """
    text = cut_lineage(patterns.select("pattern").distinct().select(F.md5("pattern").alias("tid"), "pattern", F.length("pattern").alias("m")))
    seeds = cut_lineage(maximal_matches(patterns, tiles, size, least).join(text.select("tid", "m"), "tid"))
    keys = ["tid", "strand", "chrom"]
    step = F.coalesce(F.col("rstart") - F.lag("rstart").over(Window.partitionBy(*keys).orderBy("rstart", "qstart")) > F.col("m") + band, F.lit(True))
    # a sequence's seeds on one contig are ordered in one window: as many as it has maximal matches there
    placed = seeds.withColumn("_new", step.cast("int")).withColumn(
        "place", F.sum("_new").over(Window.partitionBy(*keys).orderBy("rstart", "qstart").rowsBetween(Window.unboundedPreceding, 0)))
    grouped = placed.groupBy(*keys, "m", "place").agg(F.collect_list(F.struct(F.col("qstart").cast("long"), F.col("rstart").cast("long"), F.col("length").cast("long"))).alias("seeds"))

    def chain(batches):
        for batch in batches:
            low, high = [], []
            for seeds in batch.column(5).to_pylist():
                diagonals = [s[1] - s[0] for s in best_chain([tuple(s.values()) for s in seeds], band)]
                low.append(min(diagonals) - band)
                high.append(max(diagonals) + band)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["tid", "strand", "chrom", "m", "place", "low", "high"])

    chains = cut_lineage(grouped.select(*keys, "m", "place", "seeds").mapInArrow(chain, "tid string, strand string, chrom string, m int, place long, low long, high long"))
    spans = chains.select(*keys, "place", F.greatest(F.col("low") + 1, F.lit(1)).alias("_s"), (F.col("high") + F.col("m")).alias("_e"))
    windows = fetch_long(spans, tiles, size, "_s", "_e", [*keys, "place", "_s"])
    ready = chains.join(windows, [*keys, "place"]).join(text.select("tid", "pattern"), "tid")
    ready = ready.select(*keys, "low", "high", "_s", F.when(F.col("strand") == "-", reverse_complement(F.col("pattern"))).otherwise(F.col("pattern")).alias("query"), "subseq")

    def align(batches):
        for batch in batches:
            rows = []
            for tid, strand, chrom, low, high, start, query, ref in zip(*(c.to_pylist() for c in batch.columns)):
                # diagonals count from place 1 of the sequence and of the genome, the window begins at ``start``
                found = align_banded(query, ref, low - start + 1, high - start + 1)
                if found and found[0] >= min_score:
                    score, first, cigar = found
                    rows.append((tid, strand, chrom, start + first, cigar, score))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["tid", "strand", "chrom", "mstart", "cigar", "score"])

    # by rows: texts of some bytes take long to align
    ready = dealt(ready, chains.count(), *keys, "_s", "low", "high", most=ALIGNED)
    aligned = ready.mapInArrow(align, "tid string, strand string, chrom string, mstart long, cigar string, score long").distinct()
    named = patterns.select("pid", F.md5("pattern").alias("tid")).join(aligned, "tid")
    end = F.col("mstart") + F.coalesce(aligned_length(F.col("cigar"), REFERENCE_LENGTH_CLASS), F.lit(0)) - 1
    return named.select("pid", "strand", "chrom", "mstart", end.alias("mend"), "cigar", "score")
