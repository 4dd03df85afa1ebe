"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on counts of a text gives the evidence of the document itself: its log odds less those of
the sample it was fitted on.  Hosts (``source``) and paths below them (``source`` and ``lang``) get posterior
rates of good documents by grouped sums: a host's rate is shrunk toward the global rate and a path's rate toward
its host's, each with a strength estimated from the spread between hosts, or between paths within hosts, so sites
with few documents stay near their prior.  A document is kept when evidence plus the log odds of its path is at
least zero.

The regression is fitted on the labelled rows whose ids hash lowest, ``LABELLED`` at most; all sums cover all
documents.  Defined cases: NULL text is empty; an empty or unlabelled corpus, or one with a single class, gives
every document the evidence 0 and keeps it; NULL sources and languages are sites of their own; repeated rows count
each; of contradicting labels of a document the lowest counts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import fresh, words

LABELLED = 20_000
RIDGE = 1.0
BROADCAST_SITES = 100_000
STRENGTH = (2.0, 1e6)
BOUND = 0.999


def with_features(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, counts of a text as shares: marks, capitals, table bars, repeated neighbours, distinct words, word length.

    The words are a column of their own, read several times, so that the optimizer splits a text once.
    """
    own, bare = fresh(rows, "_own", "_bare")
    rows = rows.withColumn(bare, F.coalesce(F.col(text), F.lit(""))).withColumn(own, words(F.col(text)))
    n = F.size(own).cast("double")
    chars = F.greatest(F.length(bare), F.lit(1)).cast("double")
    left = lambda dropped: F.length(F.regexp_replace(F.col(bare), dropped, "")).cast("double")
    neighbours = F.zip_with(F.slice(own, 1, F.size(own) - 1), F.slice(own, 2, F.size(own)), lambda a, b: a == b)
    again = F.size(F.array_remove(neighbours, False))
    return rows.withColumn(out, F.array(
        left("[^%*#$&!]+") / n, left(r"[^\p{Lu}]+") / chars, left("[^|]+") / n, again / n,
        F.size(F.array_distinct(F.col(own))) / n, F.least(chars / n, F.lit(40.0)) / 10.0, F.log1p(n) / 10.0,
        left(r"[\p{L}\p{N}\s]+") / chars,
    )).drop(own, bare)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.c_[(x - center) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / scale
    return np.r_[slope, w[-1] - slope @ center]


def train(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> np.ndarray | None:
    """Coefficients of the evidence, or None where the labelled rows do not hold both classes."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # limit rows at most
    rows = with_features(rows, "text", "x").select("good", "x").dropDuplicates().collect()
    y = np.array([r.good for r in rows], dtype=float)
    if len(rows) < 10 or y.min() == y.max():
        return None
    x = np.array([r.x for r in rows], dtype=float)
    order = np.lexsort(np.c_[x, y].T)  # the sums do not depend on the order rows came in
    coefficients = fit_logistic(x[order], y[order])
    rate = y.mean()
    coefficients[-1] -= math.log(rate / (1 - rate))
    return coefficients


def with_evidence(rows: DataFrame, text: str, coefficients: np.ndarray | None, out: str) -> DataFrame:
    """Add ``out``, the log likelihood ratio of good against bad for one text.

    It is declared never NULL: otherwise the optimizer tests that first and computes it twice.
    """
    if coefficients is None:
        return rows.withColumn(out, F.lit(0.0))
    [counts] = fresh(rows, "_counts")
    total = F.lit(float(coefficients[-1]))
    for place, weight in enumerate(coefficients[:-1]):
        total = total + F.lit(float(weight)) * F.get(F.col(counts), F.lit(place))
    return with_features(rows, text, counts).withColumn(out, F.coalesce(total, F.lit(0.0))).drop(counts)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1 - BOUND)), F.lit(BOUND))
    return F.log(p / (1 - p))


def _strength(mean, spread) -> float:
    """Prior counts of a beta distribution with this mean and variance."""
    if mean is None or spread is None or spread <= 0:
        return STRENGTH[1]
    return float(min(max(mean * (1 - mean) / spread - 1, STRENGTH[0]), STRENGTH[1]))


def site_posteriors(scored: DataFrame, rate: float) -> DataFrame:
    """``source, lang, prior``: log odds of a good document per path, of ``source, lang, evidence``."""
    good = 1.0 / (1.0 + F.exp(-(F.col("evidence") + math.log(rate / (1 - rate)))))
    paths = cut_lineage(scored.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.round(good, 9)).alias("g")))
    hosts = cut_lineage(paths.groupBy("source").agg(F.sum("n").alias("hn"), F.sum("g").alias("hg")))
    # between-host variance less the binomial noise, weighted by size; one row of sums
    def spread(table: DataFrame, g: str, n: str, center: Column):
        off = F.pow(F.col(g) / F.col(n) - center, 2) - center * (1 - center) / F.col(n)
        return table.agg(F.sum(off * F.col(n)) / F.sum(n)).first()[0]

    total = hosts.agg(F.sum("hn"), F.sum("hg")).first()
    mean = (total[1] / total[0]) if total[0] else rate
    mean = min(max(mean, 1 - BOUND), BOUND)
    k_host = _strength(mean, spread(hosts, "hg", "hn", F.lit(mean)))
    hosts = hosts.select(F.col("source").alias("_s"), ((F.col("hg") + k_host * mean) / (F.col("hn") + k_host)).alias("h"))
    paths = paths.join(hosts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    k_path = _strength(mean, spread(paths, "g", "n", F.col("h")))
    return cut_lineage(paths.select("source", "lang", _logit((F.col("g") + k_path * F.col("h")) / (F.col("n") + k_path)).alias("prior")))


def global_rate(labels: DataFrame) -> float:
    row = labels.filter("quality IN (0, 1)").agg(F.avg("quality")).first()
    return min(max(row[0] if row[0] is not None else 0.5, 1 - BOUND), BOUND)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, source, lang, evidence, prior, probability, keep`` of every document."""
    coefficients, rate = train(docs, labels), global_rate(labels)
    slim = with_evidence(docs.select("doc_id", "source", "lang", "text"), "text", coefficients, "evidence")
    slim = cut_lineage(slim.select("doc_id", "source", "lang", "evidence"))
    return _judged(slim, site_posteriors(slim, rate), "evidence", "prior", "probability", "keep")


def _judged(rows: DataFrame, sites: DataFrame, evidence_col: str, prior: str, probability: str, keep: str) -> DataFrame:
    sites = sites.select(F.col("source").alias("_src"), F.col("lang").alias("_lng"), F.col("prior").alias(prior))
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    same = F.col("source").eqNullSafe(F.col("_src")) & F.col("lang").eqNullSafe(F.col("_lng"))
    rows = rows.join(sites, same, "left").drop("_src", "_lng")
    odds = F.col(evidence_col) + F.coalesce(F.col(prior), F.lit(0.0))
    return rows.withColumn(probability, 1.0 / (1.0 + F.exp(-odds))).withColumn(keep, odds >= 0)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``score_documents`` keeps, with their columns."""
    coefficients, rate = train(docs, labels), global_rate(labels)
    sites = site_posteriors(with_evidence(docs.select("source", "lang", "text"), "text", coefficients, "evidence"), rate)
    names = fresh(docs, "_evidence", "_prior", "_probability", "_keep", "_src", "_lng")
    marked = with_evidence(docs, "text", coefficients, names[0])
    return _judged(marked, sites, *names[:4]).filter(F.col(names[3])).select(*docs.columns)
