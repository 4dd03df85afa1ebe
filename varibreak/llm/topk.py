"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidates are packed into blocks of a few thousand rows, each with one posting list (places and weights) per
term; queries into blocks of sparse rows.  Every pair of blocks meets once: for each term the weighted postings
are scattered into the dense score array of the block, a partition selects the best k of each query, and the
blocks' winners are merged by query.  Nothing is left out, and a task holds one pair of blocks.

Defined cases: vectors that are NULL or hold a NULL or non-finite component take no part; a component missing in
a shorter vector is 0; repeated rows (same id and vector) count once, rows with one id and several vectors are
candidates each but never of a query of the same id, and as queries their scores share one list; NULL ids take
no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

CANDIDATES = 4096
QUERIES = 1024


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _packed(rows: DataFrame, group: str) -> DataFrame:
    """One row per ``group``: ids and the vectors in sparse form (row places, terms, weights)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        vectors = [np.asarray(v, dtype=np.int64) for v in pdf["weights"]]
        size = np.array([len(v) for v in vectors], dtype=np.int64)
        weight = np.concatenate(vectors) if len(vectors) else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(vectors)), size)
        term = np.arange(len(weight)) - np.repeat(np.cumsum(size) - size, size)
        some = weight != 0
        return pd.DataFrame({
            group: [pdf[group].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
            "rows": [row[some].astype(np.int32).tobytes()], "terms": [term[some].astype(np.int32).tobytes()],
            "weights": [weight[some].tobytes()],
        })

    return rows.groupBy(group).applyInPandas(pack, f"{group} long, ids binary, rows binary, terms binary, weights binary")


def _best(qids, qrows, qterms, qweights, cids, crows, cterms, cweights, k: int):
    """Yield (query id, candidate ids, scores) of one pair of blocks; candidates are in id order."""
    order = np.argsort(cterms, kind="stable")
    crows, cterms, cweights = crows[order], cterms[order], cweights[order]
    starts = np.searchsorted(cterms, np.unique(cterms))
    postings = {}
    for a, b in zip(starts, [*starts[1:], len(cterms)]):
        whole = b - a == len(cids)  # every row has the term, and rows come in order
        postings[int(cterms[a])] = (slice(None) if whole else crows[a:b], cweights[a:b])
    bounds = np.searchsorted(qrows, np.arange(len(qids) + 1))
    score = np.empty(len(cids), dtype=np.int64)
    for q, qid in enumerate(qids):
        score[:] = 0
        for term, weight in zip(qterms[bounds[q]:bounds[q + 1]].tolist(), qweights[bounds[q]:bounds[q + 1]]):
            if term in postings:
                place, values = postings[term]
                score[place] += weight * values
        other = np.flatnonzero(cids != qid)
        if len(other) > k:
            own = score[other]
            least = np.partition(own, len(own) - k)[len(own) - k]
            above = np.flatnonzero(own > least)
            tied = np.flatnonzero(own == least)[: k - len(above)]  # smaller ids first
            other = other[np.sort(np.concatenate([above, tied]))]
        yield qid, cids[other], score[other]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of each query row of ``vec_id, embedding``."""
    weights = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), weights.alias("weights")).distinct()
    counts = rows.agg(F.count("*"), F.count_if(is_query)).first()
    n_blocks, q_blocks = max(1, -(-counts[0] // CANDIDATES)), max(1, -(-counts[1] // QUERIES))
    mixed = F.xxhash64("vec_id", "weights")
    candidates = _packed(rows.withColumn("block", F.pmod(mixed, F.lit(n_blocks))), "block")
    queries = _packed(rows.filter(is_query).withColumn("qblock", F.pmod(mixed, F.lit(q_blocks))), "qblock")
    pairs = candidates.withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    queries = queries.select("qblock", *[F.col(c).alias(f"q{c}") for c in ("ids", "rows", "terms", "weights")])
    pairs = pairs.join(queries.hint("shuffle_merge"), "qblock").repartition(n_blocks * q_blocks, "block", "qblock")

    def search(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                view = lambda b, kind: np.frombuffer(b, dtype=kind)
                found = list(_best(
                    view(row.qids, np.int64), view(row.qrows, np.int32), view(row.qterms, np.int32), view(row.qweights, np.int64),
                    view(row.ids, np.int64), view(row.rows, np.int32), view(row.terms, np.int32), view(row.weights, np.int64), k,
                ))
                yield pd.DataFrame({
                    "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64),
                    "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found]),
                })

    best = pairs.mapInPandas(search, "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
