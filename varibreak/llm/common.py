"""Words, fresh column names, ordered neighbours and connected components shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, stored

SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text (ASCII white space apart); a text without words gives one empty word."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), GAP)


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for NULL."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, GAP))).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that clash with no column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _next_lower(ids: DataFrame, span: tuple[int, int], bits: int = 10) -> DataFrame:
    """``b, nb``: the next smaller of the distinct longs ``b``; the smallest is followed by the largest.

    Each level orders runs of at most ``2 ** bits`` numbers and hands one number per run to the next.
    """
    low, high = span
    alone = high - low < 1 << bits
    up = F.lit(0).cast("long") if alone else F.shiftright("b", bits)
    run = Window.partitionBy("up").orderBy(F.col("b").desc())
    inside = ids.select("b", up.alias("up")).withColumn("nb", F.lead("b").over(run))
    heads = cut_lineage(ids.groupBy(up.alias("up")).agg(F.max("b").alias("head")))
    if alone:
        following = heads.select("up", "head")
    else:
        above = _next_lower(heads.select(F.col("up").alias("b")), (low >> bits, high >> bits), bits)
        following = above.join(heads.withColumnRenamed("up", "nb"), "nb").select(F.col("b").alias("up"), "head")
    return cut_lineage(inside.join(following, "up").select("b", F.coalesce("nb", "head").alias("nb")))


def next_in_descending_order(rows: DataFrame, key: str, payload: str, following: str, bits: int = 6, span=None) -> DataFrame:
    """Add ``following``: the ``payload`` of the next row by descending ``key``; after the last row, that of the first.

    ``rows`` has the two columns ``key``, a long without NULLs, and ``payload``.  Rows are dealt to buckets of
    ``2 ** bits`` keys and ordered inside them; the last row of a bucket is followed by the first row of the next
    bucket, which is found from the bucket numbers alone.  Rows and first rows come from one shuffle.  Rows with
    equal keys follow each other by ``payload``.  ``span`` is the least and largest key, looked up when not given.
    """
    low, high = span or rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.withColumn(following, F.col(payload))
    bucket = F.shiftright(F.col(key), bits).alias("b")
    after = _next_lower(cut_lineage(rows.select(bucket).distinct()), (low >> bits, high >> bits))
    window = Window.partitionBy("b").orderBy(F.col(key).desc(), F.col(payload).asc_nulls_first())
    inside = rows.select(key, payload, bucket).withColumn(following, F.lead(payload).over(window))
    inside = inside.withColumn("_head", F.lag(F.lit(True)).over(window).isNull()).withColumn("_last", F.lead(F.lit(True)).over(window).isNull())
    heads = inside.filter("_head").select(F.col("b").alias("nb"), F.col(payload).alias(following))
    ends = inside.filter("_last").select(key, payload, "b").join(after.join(heads, "nb").select("b", following), "b")
    return inside.filter("NOT _last").select(key, payload, following).unionByName(ends.drop("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b``; the root is a component's smallest node.

    Alternating large and small stars: every round links neighbours to the smallest node near them, and the
    number of rounds grows with the logarithm of the longest chain.  A hub is one row of a checkpointed side, so
    a skewed join can split its neighbours.
    """
    current = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        both = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.filter("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        lowest = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(moved.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = tuple(state)
