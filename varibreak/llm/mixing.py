"""Mixing sources to target weights.

Each source's words are packed into blocks of fixed length (the last one may be shorter).  A source's target is
turned into slots of one block; multinomial draws deal them to output shards; slot ``k`` of a source takes block
``perm(k mod blocks)`` where ``perm`` is the source's own pseudorandom permutation of that pass (a keyed Feistel
network that walks until it lands inside the range).  Slots and blocks are joined by source and block index.

Whole passes come first: a target of 1.4 sizes is one full pass and 0.4 of a second, so no word is taken more
than twice while targets stop at twice the size.  The last slot is cut so that the words add up.

Words stand in the order of a hash of their document.  Block places come from prefix sums in steps (rows of a chunk
of hashes, chunks of a part, parts of a source), so no task orders a whole source.  Everything drawn depends on the
source's name and the seed, and nothing on how rows are dealt to files or partitions, so reruns agree.

Defined cases: NULL text has no words; NULL sources are one source, the last; a source without words has target
0; rows that repeat are rows of their own (``row``); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import fresh, word_count, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
TOP = 2.0
BLOCK = 256
SHARD_SLOTS = 4096
SEED = 20_240_501
PART_BITS = 10
CHUNK_ROWS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, top: float = TOP) -> DataFrame:
    """``source, source_size, target`` of ``source, source_size``: capped proportional shares, the excess reshared.

    Sources are ranked by code point, NULL last.  With ``r = top * size / weight`` the capped sources are those of
    smallest ``r``: going up in ``r``, a source is capped while the level that the rest of the budget gives to a
    unit of the rest of the weights reaches its ``r``.  Each step costs one ordered pass of a table with one row
    per source.
    """
    # one row per source: a distinct list, not the documents
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * top)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")), "place").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * share
    rest = F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    levelled = ranked.withColumn("budget", budget).withColumn("level", rest / heavy)
    over = F.col("level") * F.col("weight") >= F.col("cap")
    # the first source that is not capped sets the level of all behind it
    open_level = F.min_by(F.when(~over, F.col("level")), F.when(~over, F.struct(F.col("cap") / F.col("weight"), "place"))).over(everything)
    target = F.when(over, F.col("cap")).otherwise(open_level * F.col("weight"))
    return levelled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def _key(name: str | None, *more: int) -> list[int]:
    """Four round keys from the source's name, the pass and the seed."""
    digest = hashlib.sha256(f"{SEED}|{'' if name is None else 's' + name}|{'|'.join(map(str, more))}".encode()).digest()
    return [int.from_bytes(digest[8 * i:8 * i + 8], "little") for i in range(4)]


def permute(index: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """Images of ``index`` (all below ``n``) under a pseudorandom permutation of ``range(n)``."""
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)

    def cross(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for key in keys:
            mixed = (right + np.uint64(key & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed = (mixed + np.uint64(key >> 32)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(31)) & low)
        return (left << half) | right

    out = cross(index.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = cross(out[outside])
    return out.astype(np.int64)


def _slots(sources: DataFrame, block: int, shard_slots: int) -> DataFrame:
    """``sid, shard, block, pass_no, upto``: every slot with the block it takes and the words it may take of it."""
    totals = sources.agg(F.sum(F.ceil(F.col("target") / block))).first()[0] or 0
    shards = max(1, int(-(-totals // shard_slots)))

    def draw(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                size, left, k, out = int(row.source_size), int(round(row.target)), 0, []
                blocks = -(-size // block)
                name = None if pd.isna(row.source) else row.source
                while left > 0 and size > 0:
                    words_now = min(left, size)
                    slots = blocks if words_now == size else -(-words_now // block)
                    draws = np.random.Generator(np.random.PCG64(_key(name, k, 7))).multinomial(slots, np.full(shards, 1.0 / shards))
                    starts = np.cumsum(draws) - draws
                    some = np.flatnonzero(draws)
                    out.append(pd.DataFrame({
                        "sid": row.sid, "name": name, "pass_no": k, "shard": some, "start": starts[some], "n": draws[some],
                        "blocks": blocks, "last_slot": slots - 1,
                        "last_words": block if words_now == size else words_now - (slots - 1) * block,
                    }))
                    left, k = left - words_now, k + 1
                yield from out

    drawn = sources.select("sid", "source", "source_size", "target").mapInPandas(
        draw, "sid long, name string, pass_no int, shard long, start long, n long, blocks long, last_slot long, last_words long")
    drawn = cut_lineage(drawn).repartition("sid", "pass_no", "shard")

    def place(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                slot = np.arange(row.start, row.start + row.n, dtype=np.int64)
                name = None if pd.isna(row.name) else row.name
                taken = permute(slot, int(row.blocks), _key(name, int(row.pass_no)))
                yield pd.DataFrame({
                    "sid": row.sid, "shard": row.shard, "block": taken, "pass_no": row.pass_no,
                    "upto": np.where(slot == row.last_slot, row.last_words, block),
                })

    return drawn.mapInPandas(place, "sid long, shard long, block long, pass_no int, upto long")


def _starts(sized: DataFrame, rows_at_most: int) -> DataFrame:
    """Add ``start``: words of the source before the row by ``place`` (a hash), without ordering a whole source in a task."""
    bits = max(PART_BITS, (rows_at_most // CHUNK_ROWS).bit_length())
    rows = sized.withColumn("part", F.shiftright("place", 64 - PART_BITS)).withColumn("chunk", F.shiftright("place", 64 - bits))
    chunks = cut_lineage(rows.groupBy("sid", "part", "chunk").agg(F.sum("size").alias("s")))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = chunks.groupBy("sid", "part").agg(F.sum("s").alias("s"))
    parts = parts.select("sid", "part", F.coalesce(F.sum("s").over(before("sid", "part")), zero).alias("p"))
    chunks = chunks.withColumn("c", F.coalesce(F.sum("s").over(before("sid", "part", "chunk")), zero))
    chunks = chunks.join(parts, ["sid", "part"]).select("sid", "chunk", (F.col("c") + F.col("p")).alias("base"))
    rows = rows.withColumn("r", F.coalesce(F.sum("size").over(
        Window.partitionBy("sid", "chunk").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, -1)), zero))
    return rows.join(chunks, ["sid", "chunk"]).withColumn("start", F.col("base") + F.col("r")).drop("part", "chunk", "r", "base", "place")


def _place() -> Column:
    """Where a document stands in its source; rows of one document and text are alike, so their order changes nothing."""
    return F.xxhash64("doc_id", "text")


def plan_mix(slim: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, **targets):
    """Sources with targets and the pieces taken, for a checkpointed ``row, place, source, size``.

    Returns ``(sources, pieces)``; a piece ``row, shard, pass_no, skip, n`` takes ``n`` words of a row from word
    ``skip`` on.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(source_targets(sizes, **targets).withColumn("sid", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))))
    sid = F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    started = _starts(slim.filter("size > 0").select("row", "place", sid.alias("sid"), "size"), slim.count())
    end = F.col("start") + F.col("size")
    block_list = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    parts = started.select("row", "sid", "start", end.alias("end"), F.explode(block_list).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    parts = parts.select("row", "sid", "block", (first - F.col("start")).alias("skip"), (first - F.col("block") * block).alias("inside"),
                         (F.least(F.col("end"), (F.col("block") + 1) * block) - first).alias("n"))
    taken = parts.join(_slots(sources, block, shard_slots), ["sid", "block"])
    n = F.least(F.col("n"), F.col("upto") - F.col("inside"))
    return sources, taken.select("row", "shard", "pass_no", "skip", n.alias("n")).filter("n > 0")


def mix_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` of every document."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _place().alias("place"))
    slim = cut_lineage(slim.withColumn("row", F.monotonically_increasing_id()))
    sources, pieces = plan_mix(slim.select("row", "place", "source", "size"))
    taken = pieces.groupBy("row").agg(F.sum("n").alias("taken"))
    counted = slim.join(taken, "row", "left").select("doc_id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    # one row per source; Spark broadcasts it only while it is small
    same = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return counted.join(same, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: per pass, each document's taken words joined by spaces.

    A text taken whole stays as it is.  ``n_chars``, where there is one, follows the new text.  Documents without
    words take no part in a mix of words and stay once as they are, since nothing else removes them.
    """
    row, size, pieces_col, piece = fresh(docs, "_row", "_size", "_pieces", "_piece")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    slim = cut_lineage(numbered.select(F.col(row).alias("row"), _place().alias("place"), "source", word_count(F.col("text")).alias("size")))
    _, pieces = plan_mix(slim)
    wanted = pieces.groupBy("row", "pass_no").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("skip", "n"))).alias("cut"))
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("n", "cut")).alias(pieces_col))
    wanted = slim.join(wanted, "row", "left").select(F.col("row").alias(row), F.col("size").alias(size), pieces_col)
    joined = numbered.join(wanted, row).filter(F.col(pieces_col).isNotNull() | (F.col(size) == 0))
    each = joined.withColumn(piece, F.explode_outer(pieces_col))
    own = words(F.col("text"))
    cut = F.array_join(F.flatten(F.transform(F.col(piece)["cut"], lambda c: F.slice(own, c["skip"].cast("int") + 1, c["n"].cast("int")))), " ")
    whole = F.col(piece).isNull() | (F.col(piece)["n"] == F.col(size))
    out = each.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
