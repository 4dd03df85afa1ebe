"""Exact matches of any length, maximal seeds and gapped alignment against brute force."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varibreak.operators import match, seeds, words
from varibreak.sources.bam import CIGAR_PART

SIZE = 64


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def genome():
    draw = random.Random(6)
    text = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    repeat = text(300)
    return {"a": text(900) + repeat + "N" * 30 + text(200) + repeat, "b": "A" * 120 + text(2500) + "ACAC" * 40}


@pytest.fixture(scope="module")
def tiles(spark, genome):
    pieces = [(c, i + 1, s[i : i + 90]) for c, s in genome.items() for i in range(0, len(s), 90)]
    df = match.reference_tiles(spark.createDataFrame(pieces, "chrom string, start long, seq string"), SIZE, 40)
    return df.cache()


def test_exact_matches_of_any_length(spark, genome, tiles):
    draw = random.Random(7)
    pats = ["A", "AC", "ACACACACAC", genome["b"][300:2300], "G" * 40, genome["a"][950:1100], genome["b"][2600:]]
    for m in (3, 10, 12, 19, 20, 21, 64, 65, 300, 2000):
        at = draw.randrange(0, len(genome["b"]) - m)
        pats.append(genome["b"][at : at + m])
    pats += [pats[2], "ACGTN"]
    df = spark.createDataFrame(list(enumerate(pats)), "pid int, pattern string")
    got = sorted((r.pid, r.chrom, r.mstart, r.mend) for r in seeds.exact_matches(df, tiles, SIZE).collect())
    want = sorted((i, c, k + 1, k + len(p)) for i, p in enumerate(pats) if "N" not in p for c, s in genome.items() for k in range(len(s) - len(p) + 1) if s.startswith(p, k))
    assert got == want
    assert seeds.exact_matches(df.limit(0), tiles, SIZE).count() == 0


def test_one_mismatch_of_short_patterns(spark, genome, tiles):
    draw = random.Random(9)
    pats = []
    for m in (2, 5, 12, 20, 28, 29, 30, 37):
        at = draw.randrange(200, 2000)
        p = list(genome["b"][at : at + m])
        p[draw.randrange(m)] = draw.choice("ACGT")
        pats.append("".join(p))
    df = spark.createDataFrame(list(enumerate(pats)), "pid int, pattern string")
    got = sorted((r.pid, r.chrom, r.mstart) for r in match.find_matches(df, tiles, SIZE).collect())
    near = lambda a, b: sum(x != y for x, y in zip(a, b)) <= 1
    want = sorted((i, c, k + 1) for i, p in enumerate(pats) for c, s in genome.items() for k in range(len(s) - len(p) + 1) if near(s[k : k + len(p)], p))
    assert got == want


def test_genome_words_are_not_broadcast(spark, genome, tiles):
    df = spark.createDataFrame([("p", genome["a"][5:60])], "pid string, pattern string")
    for found in (match.find_matches(df, tiles, SIZE), seeds.maximal_matches(df, tiles, SIZE)):
        # what is sent around is the patterns, which were counted, never words or tiles of the genome
        plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
        sent = [line for line in plan if "BroadcastHashJoin" in line and ("_ts" in line or "tile" in line)]
        assert not sent
    assert seeds.exact_matches(df, tiles, SIZE).count() >= 1


def test_maximal_matches(spark, genome, tiles):
    other = "A" if genome["a"][960] == "T" else "T"
    p = genome["a"][905:960] + other + genome["a"][961:1000] + revcomp(genome["b"][500:560])
    got = {(r.strand, r.chrom, r.qstart, r.rstart, r.length) for r in seeds.maximal_matches(spark.createDataFrame([(1, p), (2, p)], "pid int, pattern string"), tiles, SIZE, 12).collect()}
    want = set()
    for strand, q in (("+", p), ("-", revcomp(p))):
        for c, s in genome.items():
            for i in range(len(q)):
                for j in range(len(s)):
                    if q[i] == s[j] != "N" and (i == 0 or j == 0 or q[i - 1] != s[j - 1]):
                        n = 0
                        while i + n < len(q) and j + n < len(s) and q[i + n] == s[j + n] != "N":
                            n += 1
                        if n >= 12:
                            want.add((strand, c, i + 1, j + 1, n))
    assert got == want and len(want) > 4


def best_score(query, ref):
    """Whole query against any part of ref, by the plain three-matrix recurrence."""
    none = -(10**9)
    m, n = len(query), len(ref)
    h = [[none] * (n + 1) for _ in range(m + 1)]
    e = [[none] * (n + 1) for _ in range(m + 1)]
    f = [[none] * (n + 1) for _ in range(m + 1)]
    h[0] = [0] * (n + 1)
    for i in range(1, m + 1):
        for j in range(n + 1):
            e[i][j] = max(h[i - 1][j] + seeds.OPEN, e[i - 1][j]) + seeds.EXTEND
            if j:
                f[i][j] = max(h[i][j - 1] + seeds.OPEN, f[i][j - 1]) + seeds.EXTEND
                same = query[i - 1] == ref[j - 1] and query[i - 1] in "ACGT"
                h[i][j] = h[i - 1][j - 1] + (seeds.AGREE if same else seeds.DIFFER)
            h[i][j] = max(h[i][j], e[i][j], f[i][j])
    return max(h[m])


def score_of(query, ref, cigar):
    total, i, j = 0, 0, 0
    for n, op in CIGAR_PART.findall(cigar):
        n = int(n)
        if op == "M":
            total += sum(seeds.AGREE if query[i + k] == ref[j + k] and query[i + k] in "ACGT" else seeds.DIFFER for k in range(n))
            i, j = i + n, j + n
        else:
            total += seeds.OPEN + seeds.EXTEND * n
            i, j = i + n * (op == "I"), j + n * (op == "D")
    assert i == len(query)
    return total


def mutate(draw, s):
    out = list(s)
    for _ in range(draw.randrange(4)):
        at = draw.randrange(len(out))
        kind = draw.randrange(3)
        n = draw.randrange(1, 9)
        if kind == 0:
            out[at] = draw.choice("ACGTN")
        elif kind == 1:
            del out[at : at + n]
        else:
            out[at:at] = [draw.choice("ACGT") for _ in range(n)]
    return "".join(out)


def test_banded_alignment_is_optimal():
    draw = random.Random(12)
    for _ in range(150):
        ref = "".join(draw.choice("ACGT" if draw.random() < 0.9 else "A") for _ in range(draw.randrange(0, 70)))
        query = mutate(draw, ref[10:50]) if len(ref) > 60 else "".join(draw.choice("ACGTN") for _ in range(draw.randrange(1, 30)))
        if not query:
            continue
        got = seeds.align_banded(query, ref, -len(query), len(ref))
        assert got[0] == best_score(query, ref) == score_of(query, ref[got[1] :], got[2]), (query, ref, got)
    assert seeds.align_banded("ACGT", "ACGT", 50, 60) is None


def test_alignment_finds_planted_indels(spark, genome, tiles):
    draw = random.Random(13)
    rows = []
    for i in range(12):
        at = draw.randrange(200, 2200)
        s = mutate(draw, genome["b"][at : at + 150])
        rows.append((i, revcomp(s) if i % 2 else s))
    rows += [(50, "A" * 5), (51, rows[0][1])]
    got = seeds.align_with_gaps(spark.createDataFrame(rows, "pid int, pattern string"), tiles, SIZE, 16).collect()
    for pid, pattern in rows[:12] + [rows[-1]]:
        mine = [r for r in got if r.pid == pid]
        query = lambda r: pattern if r.strand == "+" else revcomp(pattern)
        top = max(mine, key=lambda r: r.score)
        ref = genome[top.chrom]
        assert top.score == score_of(query(top), ref[top.mstart - 1 :], top.cigar) == max(best_score(query(top), ref[max(0, r.mstart - 60) : r.mend + 60]) for r in mine)
        assert top.mend - top.mstart + 1 == sum(int(n) for n, o in CIGAR_PART.findall(top.cigar) if o in "MD")
    assert not [r for r in got if r.pid == 50]


def test_similar_words(spark, genome, tiles):
    contigs = spark.createDataFrame([(c, len(s)) for c, s in genome.items()], "chrom string, length long")
    for word, wrong, middle in ((20, 3, 5), (21, 4, 3)):
        got = sorted(tuple(r) for r in seeds.similar_words(tiles, contigs, SIZE, word, wrong, middle).collect())
        first = word // 2 - 3
        want = []
        for c, s in genome.items():
            for a in range(0, len(s) - word, word):
                for b in range(len(s) - word + 1):
                    x, y = s[a : a + word], s[b : b + word]
                    if x[first : first + middle] == y[first : first + middle] and "N" not in x + y:
                        differing = sum(p != q for p, q in zip(x, y))
                        if differing <= wrong:
                            want.append((c, a + 1, b + 1, differing))
        assert got == sorted(want) and len(got) > len(genome["b"]) // word


def test_similar_words_of_many_stretches(spark, genome, tiles, monkeypatch):
    contigs = spark.createDataFrame([(c, len(s)) for c, s in genome.items()], "chrom string, length long")
    whole = sorted(tuple(r) for r in seeds.similar_words(tiles, contigs, SIZE, 20, 3, 5).collect())
    for name, value in (("PART_PLACES", (300, 300)), ("PART_WORDS", 16), ("PAIRS_AT_ONCE", 7)):
        monkeypatch.setattr(seeds, name, value)
    found = seeds.similar_words(tiles, contigs, SIZE, 20, 3, 5)
    assert sorted(tuple(r) for r in found.collect()) == whole
    # a word at every place is many times the genome: texts travel, never words
    moved = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert moved and not [line for line in moved if "key" in line]
    assert seeds.similar_words(tiles.limit(0), contigs, SIZE, 20, 3, 5).count() == 0


def test_words_are_packed_in_bounded_batches(monkeypatch):
    draw = random.Random(21)
    starts = list(range(1, 40 * SIZE, SIZE))
    texts = ["".join(draw.choice("ACGT") for _ in range(SIZE + 11)) for _ in starts]
    batch = pa.RecordBatch.from_pydict({"chrom": ["a", "b"] * 20, "start": starts, "seq": texts})
    monkeypatch.setattr(words, "LETTERS", 4 * SIZE)
    found = list(match._pack_words(SIZE, 12, 8)(iter([batch])))
    sizes = [sum(len(c) // 8 for c in b["codes"].to_pylist()) for b in found]
    assert len(found) > 5 and max(sizes) <= 4 * SIZE and sum(sizes) == sum(len({t[i : i + 12] for i in range(SIZE)}) for t in texts)


def test_words_are_looked_up_where_tiles_are_read(spark, genome, tiles, monkeypatch):
    """Only places that were found leave a task; asked words are held some at a time."""
    monkeypatch.setattr(words, "ASKED", 5)
    draw = random.Random(23)
    asked = {genome[c][at : at + k] for c in genome for k in (1, 3, 12, 31) for at in [draw.randrange(100, 800) for _ in range(4)]} | {"G" * 31}
    df = spark.createDataFrame([(len(w), w) for w in asked], "k int, word string")
    found = words.asked_places(tiles, SIZE, df.withColumn("number", words.word_number(F.col("word")))).join(df.withColumn("number", words.word_number(F.col("word"))), ["k", "number"])
    want = sorted((c, i + 1, w) for w in asked if "N" not in w for c, s in genome.items() for i in range(len(s)) if s.startswith(w, i))
    assert sorted((r.chrom, r.at, r.word) for r in found.collect()) == want
    monkeypatch.setattr(seeds, "_words", None)
    p = spark.createDataFrame([(1, genome["b"][300:380]), (2, "ACGT")], "pid int, pattern string")
    assert seeds.exact_matches(p, tiles, SIZE).filter("pid = 1").count() == 1


def test_maximal_seeds_spread_no_words_of_the_genome(spark, genome, tiles, monkeypatch):
    monkeypatch.setattr(seeds, "_words", None)
    p = spark.createDataFrame([(1, genome["b"][300:380]), (2, "ACGT")], "pid int, pattern string")
    assert [(r.strand, r.chrom, r.rstart, r.length) for r in seeds.maximal_matches(p, tiles, SIZE).collect()] == [("+", "b", 301, 80)]
    assert [r.cigar for r in seeds.align_with_gaps(p, tiles, SIZE).collect()] == ["80M"]


def test_mismatch_seeds_spread_only_tiles_of_other_letters(spark, genome, tiles, monkeypatch):
    asked = []
    true = match.asked_places if hasattr(match, "asked_places") else None
    monkeypatch.setattr(match, "asked_places", lambda *a: asked.append(1) or true(*a), raising=False)
    pats = [genome["a"][1190:1225], genome["b"][400:433] + "A", genome["a"][1195:1230]]
    got = sorted((r.pid, r.chrom, r.mstart) for r in match.find_matches(spark.createDataFrame(list(enumerate(pats)), "pid int, pattern string"), tiles, SIZE).collect())
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 1
    assert got == sorted((i, c, k + 1) for i, p in enumerate(pats) for c, s in genome.items() for k in range(len(s)) if near(s[k : k + len(p)], p)) and asked


def test_whole_agreement_needs_no_table():
    draw = random.Random(31)
    for _ in range(400):
        unit = "".join(draw.choice("ACGTN" if draw.random() < 0.2 else "AC") for _ in range(draw.randrange(1, 6)))
        ref = unit * draw.randrange(1, 8) + "".join(draw.choice("ACGT") for _ in range(draw.randrange(5)))
        at = draw.randrange(len(ref))
        query = ref[at : at + draw.randrange(1, 15)]
        low = draw.randrange(-6, len(ref))
        high = low + draw.randrange(12)
        assert seeds.align_banded(query, ref, low, high) == seeds._banded(query, ref, low, high), (query, ref, low, high)
    long = "ACGGT" * 40_000  # a table would have 200,000 rows
    assert seeds.align_banded(long, "T" + long, -40, 40) == (200_000, 1, "200000M")


def test_alignments_are_dealt_by_rows(spark, genome, tiles, monkeypatch):
    monkeypatch.setattr(seeds, "ALIGNED", 1)
    rows = [(i, genome["b"][300 + 90 * i : 340 + 90 * i]) for i in range(20)]
    found = seeds.align_with_gaps(spark.createDataFrame(rows, "pid int, pattern string"), tiles, SIZE, 16)
    assert sorted((r.pid, r.cigar) for r in found.collect()) == [(i, "40M") for i in range(20)]
