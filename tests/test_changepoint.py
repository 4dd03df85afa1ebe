"""Change points against a recursive search, and planted gains and losses."""

import math
import random

from varibreak.operators import changepoint


def ll(x, y):
    t = lambda n: n * math.log(n) if n else 0.0
    return t(x) + t(y) - t(x + y)


def recurse(events, penalty, least):
    """Segments of one contig's sorted (pos, case, control) by plain recursion."""
    cx, cy = sum(e[1] for e in events), sum(e[2] for e in events)
    need = penalty * math.log(cx + cy)
    out = []

    def split(part):
        x1, y1 = sum(e[1] for e in part), sum(e[2] for e in part)
        best, x, y = None, 0, 0
        for k, (_, a, b) in enumerate(part):
            x, y = x + a, y + b
            if x + y >= least and x1 + y1 - x - y >= least:
                s = round(2 * (ll(x, y) + ll(x1 - x, y1 - y) - ll(x1, y1)), 9)
                if best is None or s > best[0]:
                    best = (s, k)
        if best and best[0] > need:
            split(part[: best[1] + 1])
            split(part[best[1] + 1 :])
        else:
            out.append((part[0][0], part[-1][0], x1, y1))

    split(events)
    return out


def planted():
    draw = random.Random(3)
    reads = []
    for chrom, changes in (("a", [(5000, 8000, 0.25), (12_000, 15_000, 3.0)]), ("b", []), ("c", [(1, 4000, 4.0)])):
        for _ in range(6000 if chrom != "c" else 900):
            pos = draw.randrange(1, 20_000)
            fold = next((f for s, e, f in changes if s <= pos < e), 1.0)
            reads.append((chrom, pos, False))
            reads += [(chrom, pos + draw.randrange(3), True)] * (draw.random() < fold % 1 or 0) + [(chrom, pos, True)] * int(fold)
    reads += [("b", 7000, k % 2 == 0) for k in range(3000)]  # a hot place
    return reads


def test_segments_match_recursion(spark):
    reads = planted()
    df = spark.createDataFrame(reads, "chrom string, pos long, is_case boolean").repartition(5)
    got = sorted((r.chrom, r.start, r.end, r.case_reads, r.control_reads) for r in changepoint.segments(df, 2.0, 5, tile=700).collect())
    want = []
    for chrom in "abc":
        at = {}
        for c, pos, case in reads:
            if c == chrom:
                at.setdefault(pos, [0, 0])[0 if case else 1] += 1
        want += [(chrom, *s) for s in recurse([(p, *v) for p, v in sorted(at.items())], 2.0, 5)]
    assert got == sorted(want) and len([g for g in got if g[0] == "a"]) >= 5
    assert changepoint.segments(df.limit(0)).count() == 0


def test_calls_of_planted_changes(spark):
    df = spark.createDataFrame(planted(), "chrom string, pos long, is_case boolean")
    found = changepoint.segments(df)
    calls = {(r.chrom, r.svtype): r for r in changepoint.change_point_calls(found, expand=0).collect()}
    assert set(calls) >= {("a", "DEL"), ("a", "DUP"), ("c", "DUP")} and not any(c == "b" for c, _ in calls)
    lost = calls["a", "DEL"]
    assert abs(lost.start - 5000) < 150 and abs(lost.end - 8000) < 150 and lost.method == "seqcbs"
    wide = {(r.chrom, r.svtype): r for r in changepoint.change_point_calls(found, expand=500, good=100.0).collect()}
    assert wide["a", "DEL"].start == lost.start - 500 and not wide["a", "DEL"].good
    sure = {(r.chrom, r.svtype): r for r in changepoint.change_point_calls(found, expand=500, good=2.0).collect()}
    assert sure["a", "DEL"].good and sure["a", "DEL"].start == lost.start
    assert changepoint.change_point_calls(found, min_stat=1e9).count() == 0 and changepoint.change_point_calls(found, support=10**6).count() == 0
