import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from varibreak.operators import breakends as be
from varibreak.operators import intervals as iv
from varibreak.operators.quantiles import grouped_quantiles
from varibreak.session import dealt

TILE = 64


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    make = lambda n, span: [(i, rng.choice("ab"), s, s + rng.randrange(span)) for i in range(n) for s in [rng.choice([100, 127, 128, rng.randrange(1, 900)])]]
    return make(120, 150), make(60, 40)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, chrom string, start long, end long")


def overlap(a, b):
    return a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]


def test_runs_match_base_counts(spark, data):
    rows, _ = data
    depth = Counter((c, p) for _, c, s, e in rows for p in range(s, e + 1))
    for merge in (False, True):
        runs = iv.interval_runs(frame(spark, rows), ["chrom"], "start", "end", {"d": F.lit(1)}, tile=TILE, merge=merge).collect()
        got = Counter()
        for r in runs:
            for p in range(r["start"], r["end"] + 1):
                assert (r["chrom"], p) not in got
                got[r["chrom"], p] = r["d"]
        assert got == depth
    joined = {(r["chrom"], r["start"]): r for r in runs}
    assert not [r for r in runs if (r["chrom"], r["end"] + 1) in joined and joined[r["chrom"], r["end"] + 1]["d"] == r["d"]]


def test_runs_of_values_that_cancel_and_their_parts(spark, data):
    rows = [(c, s, e, v) for i, (_, c, s, e) in enumerate(data[0]) for v in ([0], [2], [1, -1])[i % 3]]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, v long")
    value = {}
    for c, s, e, v in rows:
        for p in range(s, e + 1):
            value[c, p] = value.get((c, p), 0) + v
    runs = iv.interval_runs(df, ["chrom"], "start", "end", {"v": F.col("v")}, tile=TILE, merge=True).collect()
    assert {(r.chrom, p): r.v for r in runs for p in range(r.start, r.end + 1)} == value
    after = {(r.chrom, r.start): r.v for r in runs}
    assert not [r for r in runs if after.get((r.chrom, r.end + 1)) == r.v]
    # parts follow the rows, not the bytes of the shuffle
    cores = spark.sparkContext.defaultParallelism
    assert [dealt(df, n, "chrom").rdd.getNumPartitions() for n in (10, 100 * 500_000)] == [cores, 100]


@pytest.mark.parametrize("step", [0, 1, 9])
def test_islands(spark, data, step):
    rows, _ = data[1], None
    want = []
    for c in "ab":
        cur = None
        for i, _, s, e in sorted((r for r in data[1] if r[1] == c), key=lambda r: r[2]):
            if cur and s - cur[2] <= step:
                cur[2], cur[3] = max(cur[2], e), cur[3] + 1
            else:
                cur = [c, s, e, 1]
                want.append(cur)
    got = iv.islands(frame(spark, data[1]), ["chrom"], "start", "end", step, {"n": ("sum", F.lit(1))}, tile=TILE)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_overlap_reduce_and_counts(spark, data):
    left, right = data
    a, b = frame(spark, left), frame(spark, right)
    got = {r["id"]: (r["first"], r["n"]) for r in iv.overlap_reduce(a, b, ["chrom"], "start", "end", {"first": ("min", F.col("id")), "n": ("sum", F.lit(1))}, levels=12).collect()}
    for row in left:
        hits = [r[0] for r in right if overlap(row, r)]
        assert got[row[0]] == ((min(hits), len(hits)) if hits else (None, None))
    counted = {r["id"]: r["n"] for r in iv.count_overlaps(a, b, ["chrom"], "start", "end", "start", "end", tile=TILE).collect()}
    assert counted == {row[0]: sum(overlap(row, r) for r in right) for row in left}
    assert {r["id"] for r in iv.overlapping(a, b, ["chrom"], keep=False).collect()} == {row[0] for row in left if not any(overlap(row, r) for r in right)}


def test_exploded_blocks_are_not_broadcast(spark, data):
    a, b = frame(spark, data[0]), frame(spark, data[1])
    plan = iv.overlap_reduce(a, b, ["chrom"], "start", "end", {"n": ("sum", F.lit(1))})._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "_lv" in line and "Join" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)


def test_points_and_distances(spark, data):
    left, right = data
    points = frame(spark, left).select("id", "chrom", F.col("start").alias("pos"))
    inside = {r["id"] for r in iv.points_in(points, frame(spark, right), ["chrom"], "pos", tile=TILE).collect()}
    assert inside == {row[0] for row in left if any(r[1] == row[1] and r[2] <= row[2] <= r[3] for r in right)}
    few = [r for r in right if r[1] == "a"][:5]
    dist = {r["id"]: r["gap_distance"] for r in iv.distance_to(points, frame(spark, few), ["chrom"], "pos", tile=TILE).collect()}
    for i, c, s, _ in left:
        want = min((0 if f[2] <= s <= f[3] else min(abs(f[2] - s), abs(f[3] - s)) for f in few if f[1] == c), default=None)
        assert dist[i] == want


@pytest.mark.parametrize("low,band", [(None, 20), (-1, 30)])
def test_nearest_within(spark, data, low, band):
    left, right = data
    targets = frame(spark, right).groupBy("chrom", F.col("start").alias("at")).agg(F.min("id").alias("tid"))
    points = frame(spark, left).select("id", "chrom", F.col("start").alias("pos"))
    got = {r["id"]: r["dist"] for r in iv.nearest_within(points, targets, ["chrom"], "pos", "at", band, {"tid": F.col("tid")}, low=low, tile=TILE).collect()}
    for i, c, s, _ in left:
        d = [r[2] - s for r in right if r[1] == c and (-band if low is None else low) <= r[2] - s <= band]
        assert got[i] == (min(d, key=lambda x: (abs(x), x)) if d else None)


def test_range_sums(spark, data):
    left, right = data
    events = frame(spark, right).select("chrom", F.col("start").alias("pos"), F.lit(1).cast("long").alias("w"))
    got = {r["id"]: r["w"] for r in iv.range_sums(frame(spark, left), events, ["chrom"], "start", "end", "pos", ["w"], tile=TILE).collect()}
    assert got == {row[0]: sum(r[1] == row[1] and row[2] <= r[2] <= row[3] for r in right) for row in left}


def test_near_duplicates_and_hotspots(spark):
    rng = random.Random(3)
    rows = [("a", rng.randrange(400), rng.random() < 0.5, rng.choice("ab"), rng.randrange(400), True, str(i), "m") for i in range(150)]
    bnd = spark.createDataFrame(rows, "chr1 string, pos1 long, goRight1 boolean, chr2 string, pos2 long, goRight2 boolean, cid string, mcid string")
    order = sorted(rows, key=lambda r: (r[1], r[4], r[6], r[7]))
    want = {j[6] for n, j in enumerate(order) if not any(i[2] == j[2] and i[3] == j[3] and abs(i[1] - j[1]) < 30 and abs(i[4] - j[4]) < 30 for i in order[:n])}
    assert {r["cid"] for r in be.drop_near_duplicates(bnd, 30).collect()} == want
    hot = {r["cid"] for r in be.hotspots(bnd, ["chr1"], "pos1", 4, 3).filter("hot").collect()}
    runs, cur = [], []
    for r in sorted(rows, key=lambda r: r[1]):
        if cur and r[1] - cur[-1][1] >= 4:
            runs.append(cur)
            cur = []
        cur.append(r)
    runs.append(cur)
    assert hot == {r[6] for run in runs if len(run) > 5 for r in run}
    numbered = {r["cid"]: r["row"] for r in be.number_rows(bnd).collect()}
    by_all = sorted(rows, key=lambda r: (r[0], r[1], r[3], r[4], r[2], r[5], r[6], r[7]))
    assert numbered == {r[6]: n + 1 for n, r in enumerate(by_all)}


def test_quantiles_on_skewed_values(spark):
    rng = random.Random(5)
    values = defaultdict(list)
    for _ in range(3000):
        values[rng.choice("xyy")].append(rng.choice([5, 5, 5, rng.randrange(100000)]))
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v int")
    got = {r["k"]: (r["a"], r["b"]) for r in grouped_quantiles(df, ["k"], F.col("v"), {"a": 0.5, "b": 0.93}).collect()}
    for k, vs in values.items():
        vs.sort()
        for p, g in zip((0.5, 0.93), got[k]):
            h = (len(vs) - 1) * p
            lo = int(h)
            assert g == pytest.approx(vs[lo] + (vs[min(lo + 1, len(vs) - 1)] - vs[lo]) * (h - lo))
