import random

from pyspark.sql import functions as F

from varibreak.operators import anchors as an
from varibreak.operators.pairedscan import paired_event_scan

ANCHOR = "lfwd boolean, lchr string, lst long, led long, rfwd boolean, rchr string, rst long, red long"


def contigs(spark):
    return spark.createDataFrame([("chr1", 10), ("chr2", 20), ("chr3", 30)], "chrom string, length long")


def test_offsets_and_coordinates(spark):
    off = {(r["chrom"], r["fwd"]): r["off"] for r in an.strand_offsets(contigs(spark)).collect()}
    assert off["chr2", True] == 10 and off["chr2", False] == 70
    rows = [(True, "chr2", 10, 15, False, "chr2", 15, 20), (True, "chr2", 15, 20, True, "chr3", 15, 20)]
    line = an.to_line(spark.createDataFrame(rows, ANCHOR), an.strand_offsets(contigs(spark)))
    assert sorted((r["lst"], r["red"]) for r in line.collect()) == [(20, 90), (25, 50)]
    back = an.from_line(line, an.strand_offsets(contigs(spark))).select(*[c.split()[0] for c in ANCHOR.split(", ")])
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_both_overlap(spark):
    cases = [((2, 5, 11, 15), (3, 6, 10, 14), True), ((2, 5, 11, 15), (1, 7, 12, 13), True), ((2, 5, 11, 15), (3, 4, 6, 7), False),
             ((2, 5, 11, 15), (6, 7, 12, 13), False), ((2, 5, 11, 15), (6, 7, 8, 9), False)]
    for a, b, want in cases:
        pair = "struct<lst:long,led:long,rst:long,red:long>"
        df = spark.createDataFrame([(a, b)], f"a {pair}, b {pair}")
        assert df.select(an.both_overlap("a", "b")).first()[0] is want


def test_three_anchors_make_two_clusters(spark):
    rows = [(True, "chr2", 10, 15, False, "chr2", 15, 20), (True, "chr2", 15, 20, True, "chr3", 15, 20), (True, "chr2", 10, 15, False, "chr2", 15, 20)]
    got = an.cluster_anchors(spark.createDataFrame(rows, ANCHOR), contigs(spark))
    assert sorted(r["sup"] for r in got.collect()) == [1, 2]


def greedy(items):
    """The sweep as a loop over events: ins before outs at one place, ins in key order."""
    events = sorted([(a[0], 0, a) for a in items] + [(a[3], 1, a) for a in items])
    active, cluster = {}, {}
    for _, out, a in events:
        if out:
            active.pop(a, None)
            continue
        hit = next((b for b in sorted(active) if a[1] >= b[0] and b[1] >= a[0] and a[3] >= b[2] and b[3] >= a[2]), None)
        cluster[a] = cluster[hit] if hit else a
        active[a] = True
    return cluster


def test_sweep_equals_greedy_walk(spark):
    rng = random.Random(11)
    items = set()
    for _ in range(250):
        s, t = rng.randrange(300), rng.randrange(300, 900)
        items.add((s, s + rng.randrange(1, 60), t, t + rng.randrange(1, 60)))
    line = spark.createDataFrame(sorted(items), "lst long, led long, rst long, red long")
    got = {(r["lst"], r["led"], r["rst"], r["red"]): tuple(r["root"]) for r in an.sweep_clusters(line, cell=64).collect()}
    assert got == greedy(sorted(items))


def walk(x, y, w, mx, my):
    """The paired-event scan over whole lists, one event at a time."""
    x, y, hits, i, j, start = sorted(x), sorted(y), [], 0, 0, sorted(x)[0]
    while True:
        while j < len(y) and y[j] <= start:
            j += 1
        if j == len(y):
            return hits
        if y[j] - start <= 2 * w:
            cx = cy = 0
            while i < len(x) and x[i] - start < w:
                cx, i = cx + 1, i + 1
            while j < len(y) and y[j] - x[i - 1] < 1:
                j += 1
            while j < len(y) and y[j] - start < 2 * w:
                cy, j = cy + 1, j + 1
            if cx >= mx and cy >= my:
                hits.append((start, cx, cy))
            if i == len(x) or j == len(y):
                return hits
            start = x[i]
        else:
            while start < y[j] - 2 * w:
                i += 1
                if i == len(x):
                    return hits
                start = x[i]


def test_paired_events_equal_the_walk(spark):
    rng = random.Random(2)
    for n in (30, 300):
        x, y = ([rng.choice([500, rng.randrange(8000)]) for _ in range(n)] for _ in range(2))
        frame = lambda v: spark.createDataFrame([("c", p) for p in v], "chrom string, pos long")
        got = paired_event_scan(frame(x), frame(y), ["chrom"], "pos", 40, 2, 1)
        assert sorted((r["first_x"], r["count_x"], r["count_y"]) for r in got.collect()) == walk(x, y, 40, 2, 1)


def test_one_call_walks_the_stretches_of_a_tile(spark):
    rng = random.Random(4)
    spots = [0, 500, 999_000, 1_000_100, 2_500_000]
    x, y = ([rng.choice(spots) + rng.randrange(1, 300) for _ in range(200)] for _ in range(2))
    frame = lambda v: spark.createDataFrame([("c", p) for p in v], "chrom string, pos long")
    got = paired_event_scan(frame(x), frame(y), ["chrom"], "pos", 40, 2, 1)
    assert sorted((r["first_x"], r["count_x"], r["count_y"]) for r in got.collect()) == walk(x, y, 40, 2, 1)
    grouped = got._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "FlatMapGroupsInPandas" in grouped and "_sid" not in grouped.split("]")[0]


def test_contrast_keeps_case_only_clusters(spark):
    mk = lambda s, n: [(True, "chr3", s + i, s + i + 5, False, "chr3", s + 10, s + 15) for i in range(n)]
    case, control = mk(1, 4) + mk(14, 3), mk(14, 3)
    got = an.contrast_clusters(spark.createDataFrame(case, ANCHOR), spark.createDataFrame(control, ANCHOR), contigs(spark), 3, 2)
    assert [(r["lst"], r["sup"]) for r in got.select("lst", F.col("sup")).collect()] == [(1, 4)]
