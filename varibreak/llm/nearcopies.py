"""Documents whose sets of five-word shingles are alike: Jaccard similarity ``SIMILAR`` or more, exactly.

A bit limit on fingerprints cannot promise this (at similarity 0.8 two 64-bit fingerprints differ in about ten bits,
give or take three), so candidates come from prefixes: with the shingles of every set in one common order, two sets
that are alike share a shingle among the first ``n - ceil(0.8 n) + 1`` of each.  Any order is complete; here shingles
that a sample of the corpus holds in several texts come last, so that common passages seldom are in a prefix.
Every candidate is confirmed on the whole sets.

The texts under one shingle first meet ``LEADERS`` of them, drawn by a hash of shingle and text; what those link needs
no other comparison among itself, so a large group of near copies costs a few comparisons a member.  Then all texts
under a shingle that are still in different components meet each other.  In both steps the places of the shingle in
the two orders bound what can be shared (nothing before a pair's first shared shingle is); in the second, bits of the
two sets do so too, inside the join.  Only ids, sizes, places and, for what is left then, those bits travel.

Defined cases: letters A-Z count as small and ASCII white space separates words; a text of fewer than five words is
one shingle; texts without words, and NULL, are alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType

from ..session import cut_lineage, small
from .common import connected_components

SHINGLE = 5
SIMILAR = (4, 5)  # 0.8, as whole numbers
SAMPLE = 4000
COMMON = 3
KNOWN = 200_000
BITS = (8, 17)  # of a map: least and most, as powers of two
LEADERS = 4  # of a shingle
SIGN = 16  # longs of the bits that travel
_RING = 1 << 20


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; zero alone stands for no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(1, dtype=np.int64)
    size = min(SHINGLE, len(words))
    rows = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in rows), dtype=np.uint64).view(np.int64))


def prefix_of(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(0.8 n) + 1`` hashes, those in the sorted array ``common`` last."""
    above, below = SIMILAR
    length = len(hashes) + above * len(hashes) // -below + 1
    if not len(common):
        return hashes[:length]
    known = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    rare = hashes[~known]
    return rare[:length] if len(rare) >= length else np.concatenate([rare, hashes[known][:length - len(rare)]])


def bit_map(hashes: np.ndarray, size: int = 0) -> np.ndarray:
    """Bits as longs: those that some hash names by its low bits; without ``size`` a power of two, about four to eight per hash."""
    size = size or 1 << min(max((4 * len(hashes)).bit_length(), BITS[0]), BITS[1])
    held = np.zeros(size, dtype=np.uint8)
    held[hashes.view(np.uint64) % np.uint64(size)] = 1
    return np.packbits(held).view(np.int64)


def _folded(bits: Column, other: Column) -> Column:
    """A map halved to the size of ``other`` if it is twice as long; maps of alike sets differ by one doubling at most."""
    half = (F.size(bits) / 2).cast("int")
    halves = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseOR(q))
    return F.when(F.size(bits) == 2 * F.size(other), halves).otherwise(bits)


@F.pandas_udf(ArrayType(LongType()))
def shingles(text: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t) for t in text], dtype=object)


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles in ``COMMON`` or more texts of a sample; they set an order, never a result."""
    n = docs.count()
    share = _RING if n <= SAMPLE else SAMPLE * _RING // n + 1
    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(_RING)) < share).distinct()
    counts = sample.select(F.explode(shingles("text")).alias("s")).groupBy("s").count().filter(F.col("count") >= COMMON)
    return np.sort(np.array([r.s for r in counts.orderBy(F.desc("count"), "s").limit(KNOWN).collect()], dtype=np.int64))


def _may_agree(n: Column, at: Column, m: Column, other: Column) -> Column:
    """Whether two sets may be alike whose first shared shingle stands at these places: no more than what follows is shared."""
    above, below = SIMILAR  # alike: shared / (n + m - shared) >= above / below
    return F.least(n - at, m - other) * (above + below) >= (n + m) * above


def _may_share(n: Column, x: list[Column], m: Column, y: list[Column]) -> Column:
    """Whether two sets of these sizes and bits may be alike: a bit that only one has is a shingle that is not shared."""
    above, below = SIMILAR
    apart = lambda p, q: sum((F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in zip(p, q)), F.lit(0))
    return F.least(n - apart(x, y), m - apart(y, x)) * (above + below) >= (n + m) * above


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes whose whole sets are alike.

    Every bit that one set's map has and the other's lacks stands for a shingle that is not shared; pairs with too
    many of them are out before the whole sets are fetched.
    """
    above, below = SIMILAR
    maps = lambda name, n, bits: nodes.select(F.col("id").alias(name), F.col("n").alias(n), F.col("bits").alias(bits))
    met = pairs.distinct().join(maps("b", "m", "y"), "b").join(maps("a", "n", "x"), "a")
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda at, k: at + k)
    met = met.filter(F.least("n", "m") * below >= F.greatest("n", "m") * above)
    met = met.select("a", "b", "n", "m", _folded(F.col("x"), F.col("y")).alias("x"), _folded(F.col("y"), F.col("x")).alias("y"))
    most = F.least(F.col("n") - apart("x", "y"), F.col("m") - apart("y", "x"))
    pairs = cut_lineage(met.filter(most * (above + below) >= (F.col("n") + F.col("m")) * above).select("a", "b"))
    asked = small(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct().join(nodes.select("id", "key"), "id"))
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(asked, "key").dropDuplicates(["id"])
    sets = cut_lineage(texts.select("id", shingles("text").alias("own")))
    side = lambda name, own: sets.select(F.col("id").alias(name), F.col("own").alias(own))
    both = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a")
    alike = F.size(F.array_intersect("x", "y")) * (above + below) >= (F.size("x") + F.size("y")) * above
    return cut_lineage(both.filter(alike).select("a", "b"))


def near_copy_components(docs: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """``key, root`` of the texts (by ``text_key``) that have a near copy; ``root`` is the same for a component.

    ``linked`` (``key, group``) names texts that count as copies already; their groups are parts of the components.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    @F.pandas_udf("n int, prefix array<long>, bits array<long>, sign array<long>")
    def prefix(text: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in text]
        column = lambda of: pd.Series([of(s) for s in sets], dtype=object)
        return pd.DataFrame({"n": pd.Series(map(len, sets), dtype="int32"), "prefix": column(lambda s: prefix_of(s, common.value)),
                             "bits": column(bit_map), "sign": column(lambda s: bit_map(s, 64 * SIGN))})

    texts = docs.select(text_key(F.col("text")).alias("key"), prefix("text").alias("p")).dropDuplicates(["key"])
    nodes = cut_lineage(texts.select(F.monotonically_increasing_id().alias("id"), "key", "p.n", "p.prefix", "p.bits", "p.sign"))
    tokens = nodes.select("id", "n", F.posexplode("prefix").alias("at", "s"))
    under = Window.partitionBy("s").orderBy(F.xxhash64("s", "id"), "id")
    # no text after the first: the shingle has one text
    ranked = tokens.withColumn("rank", F.row_number().over(under)).withColumn("more", F.lead(F.lit(True)).over(under))
    members = cut_lineage(ranked.filter("rank > 1 OR more").drop("more"))
    leaders = members.filter(F.col("rank") <= LEADERS).select(
        F.col("s").alias("t"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("id").alias("b"), F.col("rank").alias("before"))
    # a pair that is alike passes at its first shared shingle: here if one of the two leads it, else below
    pair = [F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")]
    agree = _may_agree(F.col("n"), F.col("at"), F.col("m"), F.col("place"))
    first = members.join(leaders, (F.col("s") == F.col("t")) & (F.col("rank") > F.col("before")) & agree)
    edges = _confirmed(first.select(*pair), nodes, docs)
    if linked is not None:
        grouped = nodes.select("id", "key").join(linked, "key").select("id", "group")
        least = grouped.groupBy("group").agg(F.min("id").alias("a"))
        edges = cut_lineage(edges.unionAll(grouped.join(least, "group").filter("a <> id").select("a", F.col("id").alias("b"))))
    parts = cut_lineage(connected_components(edges).select(F.col("node").alias("id"), "root"))
    told = members.filter(F.col("rank") > LEADERS).join(parts, "id", "left").select("s", "n", "at", "id", F.coalesce("root", "id").alias("root"))
    mixed = told.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("s")
    signs = nodes.select("id", *[F.col("sign")[i].alias(f"x{i}") for i in range(SIGN)])
    left = cut_lineage(told.join(mixed, "s").join(signs, "id"))
    other = left.select(F.col("s").alias("t"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("id").alias("b"), F.col("root").alias("other"),
                        *[F.col(f"x{i}").alias(f"y{i}") for i in range(SIGN)])
    share = _may_share(F.col("n"), [F.col(f"x{i}") for i in range(SIGN)], F.col("m"), [F.col(f"y{i}") for i in range(SIGN)])
    # the condition is part of the join, so what it refuses is no row anywhere
    rest = left.join(other, (F.col("s") == F.col("t")) & (F.col("id") < F.col("b")) & (F.col("root") != F.col("other")) & agree & share)
    edges = edges.unionAll(_confirmed(rest.select(F.col("id").alias("a"), "b"), nodes, docs))
    parts = connected_components(edges).select(F.col("node").alias("id"), F.col("root").cast("string").alias("root"))
    return cut_lineage(parts.join(nodes.select("id", "key"), "id").select("key", "root"))  # no number is a text's key
