"""Whitening against plain integer sums and numpy's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from varibreak.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, X string"


def brute(rows, keep=4):
    held = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in held), default=0)
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (width - len(v))) for i, v in held]
    fit = sorted({x for _, x in xs})
    n = len(fit)
    sums = [sum(x[d] for x in fit) for d in range(width)]
    cov = np.array([[float(Fraction(sum(n * x[i] * x[j] for x in fit) - sums[i] * sums[j], n * n)) for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:keep], vectors[:, ::-1][:, :keep]
    out = []
    for i, x in xs:
        z = (np.array(x) - np.array(sums) / n) @ vectors
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), z / np.sqrt(values), values / np.trace(cov)))
    return out


def test_whitening_matches_plain_sums(spark):
    draw = np.random.default_rng(5)
    mix = draw.normal(size=(6, 6)) * [3.0, 1.5, 0.8, 0.4, 0.2, 0.1]
    rows = [(i, [float(v) for v in np.float32(draw.normal(size=6) @ mix.T)], 1, "x") for i in range(400)]
    rows += [rows[7], rows[7], (None, rows[9][1], 1, "x"), (900, rows[3][1], None, None)]
    rows += [(901, None, 1, "x"), (902, [1.0, None], 1, "x"), (903, [math.nan] * 6, 1, "x"), (904, [math.inf], 1, "x"), (905, [], 1, "x"), (906, [-0.0, 0.5], 1, "x")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = brute(rows)
    assert len(got) == 4 * len(want) and {r.n for r in got} == {want[0][1]}
    key = lambda i: (i is None, i or 0)
    table = {}
    for r in got:
        table.setdefault(r.component, []).append(r)
    for c in range(1, 5):
        mine = sorted(table[c], key=lambda r: (key(r.vec_id), r.deviation, abs(r.whitened)))
        ref = sorted(want, key=lambda w: (key(w[0]), w[2], abs(w[3][c - 1])))
        assert [r.vec_id for r in mine] == [w[0] for w in ref] and [r.deviation for r in mine] == [w[2] for w in ref]
        assert [int(r.deviation_exact) for r in mine] == [w[2] for w in ref]
        a, b = np.array([r.whitened for r in mine]), np.array([w[3][c - 1] for w in ref])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(abs(r.explained / ref[0][4][c - 1] - 1) < 1e-9 for r in mine)
    assert all(r.identity_error < 1e-9 for r in got)


def test_bit_sliced_products_are_exact():
    draw = np.random.default_rng(2)
    for rows, width, span in ((1, 3, 5), (63, 4, 9), (64, 2, 1 << 30), (200, 5, 1 << 51)):
        x = draw.integers(-span, span, size=(rows, width))
        sums, products = whitening.cross_products(x)
        wide = x.astype(object)
        assert sums == [int(v) for v in wide.sum(axis=0)]
        assert products == [[int(wide[:, i] @ wide[:, j]) for j in range(i, width)] for i in range(width)]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == [] and whitening.whiten(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 1, "") for i in range(5)], SCHEMA)).collect()
    assert len(same) == 10 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.identity_error is None for r in same)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0], 1, "") for i in range(3)], SCHEMA)).collect()
    first = sorted((r.vec_id, round(abs(r.whitened), 9)) for r in line if r.component == 1)
    assert first == [(0, round(1.5 ** 0.5, 9)), (1, 0.0), (2, round(1.5 ** 0.5, 9))] and all(r.whitened is None for r in line if r.component == 2)
    huge = whitening.whiten(spark.createDataFrame([(1, [2.0 ** 40], 1, ""), (2, [-(2.0 ** 40)], 1, "")], SCHEMA)).collect()
    assert {int(r.deviation_exact) for r in huge} == {(1 << 49) ** 2} and all(r.deviation is None for r in huge)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [2.0 ** 50], 1, "")], SCHEMA)).collect()
