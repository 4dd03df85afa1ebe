"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint is the majority vote of the XXH64 of a text's three-word shingles.  Two fingerprints link at two
or fewer differing bits.  The upper nodes of the index are shared masked bit patterns: of four blocks of 16 bits
two link partners agree in at least two, so each fingerprint stands under the six patterns that mask the other
two blocks, and whole groups with other patterns are never met.  Under a node fingerprints are sorted by Gray
rank, runs of them are factored into nested patterns (the bits a run shares), and a search adds up the
differences on the way down and drops a run as soon as they pass two.

A node of more than ``LEAF`` fingerprints is not searched in one task: its members meet at the words one flipped
bit away instead (two fingerprints are at most two bits apart exactly if they share such a word), each word being
met by at most 65 of them.  That way is exact too; no pair is dropped.  Only links to the smallest member of a
local group are written, never all pairs.

Defined cases: NULL and wordless texts have fingerprint zero and link like any other; equal fingerprints are one
node of the graph however many documents share them; a NULL ``doc_id`` never names a component unless it has no
other document.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from ..session import cut_lineage
from .common import connected_components, fresh
from .nearcopies import near_copy_components, text_key

SHINGLE = 3
SEED = 42
BITS = 2
LEAF = 256
FAN = 8
CHUNK = 1 << 16


def fingerprint_text(text: str | bytes | None) -> int:
    """Signed 64-bit fingerprint of one text, or of its bytes as they are stored, valid UTF-8 or not."""
    stored = text.encode() if isinstance(text, str) else bytes(text or b"")
    words = stored.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), CHUNK):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[at:at + CHUNK]], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(shingles), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprint(stored: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_text(t) for t in stored], dtype="int64")


def fingerprint(text: Column | str) -> Column:
    return _fingerprint((F.col(text) if isinstance(text, str) else text).cast("binary"))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_masks(parts: int = 4, keep: int = 2) -> list[int]:
    size = 64 // parts
    block = (1 << size) - 1
    return [sum(block << (size * b) for b in chosen) for chosen in combinations(range(parts), keep)]


def gray_rank(fp: Column) -> Column:
    """Place of a word in the reflected Gray order, as a long that sorts the same way."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def tree_pairs(codes: np.ndarray, limit: int = BITS, fan: int = FAN):
    """Places i < j of the codes (uint64, in Gray order) at most ``limit`` bits apart."""
    lows, highs = [codes], [codes]
    while len(lows[-1]) > fan:
        starts = np.arange(0, len(lows[-1]), fan)
        lows.append(np.bitwise_and.reduceat(lows[-1], starts))
        highs.append(np.bitwise_or.reduceat(highs[-1], starts))
    n = len(codes)
    query = np.repeat(np.arange(n), len(lows[-1]))
    node = np.tile(np.arange(len(lows[-1])), n)
    differing = np.zeros(len(query), dtype=np.int64)
    above = np.zeros(len(query), dtype=np.uint64)  # bits the path has fixed so far
    for level in range(len(lows) - 1, -1, -1):
        fixed = ~(lows[level] ^ highs[level])[node]
        differing = differing + np.bitwise_count((codes[query] ^ lows[level][node]) & fixed & ~above)
        last = np.minimum((node + 1) * fan**level, n) - 1
        kept = (differing <= limit) & (last > query)
        query, node, differing, above = query[kept], node[kept], differing[kept], fixed[kept]
        if level:
            width = np.minimum(fan, len(lows[level - 1]) - node * fan)
            offset = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            query, differing, above = (np.repeat(x, width) for x in (query, differing, above))
            node = np.repeat(node * fan, width) + offset
    return query, node


def local_links(codes: np.ndarray) -> list[tuple[int, int]]:
    """(code, smallest code of its local group) of the codes that link to a smaller one; codes come in Gray order."""
    parent = list(range(len(codes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(codes) <= FAN:
        plain = [int(c) & ((1 << 64) - 1) for c in codes]
        pairs = [(i, j) for i, j in combinations(range(len(plain)), 2) if (plain[i] ^ plain[j]).bit_count() <= BITS]
    else:
        pairs = list(zip(*(x.tolist() for x in tree_pairs(codes.view(np.uint64)))))
    values = codes.tolist()
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            if values[a] > values[b]:
                a, b = b, a
            parent[b] = a
    return [(values[i], values[r]) for i in range(len(values)) if (r := find(i)) != i]


def _search(batches):
    """Links inside each row of ``fps``, a node's members in Gray order."""
    for pdf in batches:
        found = [x for codes in pdf["fps"] for x in local_links(np.asarray(codes, dtype=np.int64))]
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def fingerprint_links(fps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that connect all that are linked."""
    under = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern")) for i, m in enumerate(node_masks())]
    members = fps.select("fp", F.inline(F.array(*under)))
    sizes = cut_lineage(members.groupBy("mask", "pattern").agg(F.count("*").alias("n")).filter("n > 1"))
    members = members.join(sizes, ["mask", "pattern"])
    # a node is one row of ``leaf`` members at most: dealt by a repartition and read as a run, nodes were torn apart where
    # Spark found the join's parts to do and then read them otherwise
    ranked = F.array_sort(F.collect_list(F.struct(gray_rank(F.col("fp")).alias("rank"), "fp")))
    small = members.filter(F.col("n") <= leaf).groupBy("mask", "pattern").agg(ranked.alias("r"))
    edges = small.select(F.col("r.fp").alias("fps")).mapInPandas(_search, "a long, b long")
    if sizes.filter(F.col("n") > leaf).limit(1).count():
        hot = members.filter(F.col("n") > leaf).select("fp").distinct()
        near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]
        ball = hot.select("fp", F.explode(F.array(*near)).alias("word"))
        met = ball.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
        edges = edges.unionAll(ball.join(met, "word").filter("fp <> b").select(F.col("fp").alias("a"), "b"))
    return edges


def fingerprint_components(slim: DataFrame) -> DataFrame:
    """``fp, root, component_id`` per distinct fingerprint of ``doc_id, fp`` (a checkpointed table)."""
    firsts = cut_lineage(slim.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = cut_lineage(connected_components(fingerprint_links(firsts.select("fp"))).select(F.col("node").alias("fp"), "root"))
    lowest = linked.join(firsts, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(cut_lineage(lowest), "root").select("fp", "root", "component_id")
    return cut_lineage(firsts.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"),
    ))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    slim = cut_lineage(docs.select("doc_id", fingerprint("text").alias("fp")))
    found = fingerprint_components(slim)
    return slim.join(found, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest ``doc_id`` (NULL last).

    Components are made of the operator's own, whose fingerprints differ in two or fewer bits, and of the links of
    ``nearcopies``: texts that share 0.8 of their five-word shingles are near copies too, and no bit limit promises to
    find them.  Of rows that share id and text, one stays.
    """
    key, root, least, place, fp = fresh(docs, "_key", "_root", "_least", "_place", "_fp")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    marked = docs.withColumn(key, text_key(F.col("text"))).withColumn(least, own)
    slim = marked.select(key, least, fingerprint("text").alias(fp)).groupBy(key).agg(F.min(least).alias(least), F.min(fp).alias(fp))
    slim = cut_lineage(slim)
    alike = fingerprint_components(slim.select(F.col(least).alias("doc_id"), F.col(fp).alias("fp"))).select(F.col("fp").alias(fp), F.col("root").alias("group"))
    found = near_copy_components(docs, slim.join(alike, fp).select(F.col(key).alias("key"), "group"))
    found = found.select(F.col("key").alias(key), F.col("root").alias(root))
    owners = slim.join(found, key, "left").groupBy(F.coalesce(root, key).alias(root)).agg(F.min(F.struct(least, key)).alias("o"))
    kept = marked.join(owners.select(F.col("o")[least].alias(least), F.col("o")[key].alias(key)), [least, key])
    first = F.row_number().over(Window.partitionBy(least, key).orderBy(F.xxhash64("text")))
    return kept.withColumn(place, first).filter(F.col(place) == 1).select(*docs.columns)
