"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Every five-word shingle is hashed once.  The leading bits of the hash choose a bin and the smallest hash of a
bin stands for it.  An empty bin borrows from the bin its own probe sequence meets first; when four probes meet
only empty bins, as in short texts, the fifth takes the first occupied bin at or behind its place (in a circle).
So filling always ends and depends on the set of occupied bins alone.  A lent hash is mixed with the number of the
bin that borrows it: the low bits of one hash must not agree by chance in many bins at once.  Four low-order bits of each bin are packed
into longs.  Everything is made of built-in column functions.

Defined cases: NULL is the empty text; a text of fewer than five words is one shingle; a text without words is
the shingle of one empty word, so two such texts are alike and others are not.  Words are taken as they are.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, functions as F

from .common import next_in_descending_order, words

SHINGLE = 5
BIN_BITS = 8
LOW_BITS = 4
PROBES = 4


def _probe_table(bins: int, probes: int) -> list[list[int]]:
    draw = random.Random(2017)
    return [[draw.randrange(bins) for _ in range(bins)] for _ in range(probes)]


def _shingles(w: Column) -> Column:
    """Hashes of all runs of five word hashes; a shorter sequence is one shingle."""
    n = F.size(w)
    run = F.transform(F.slice(w, 1, F.greatest(n - (SHINGLE - 1), F.lit(0))),
                      lambda first, i: F.xxhash64(first, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
    return F.when(n >= SHINGLE, run).otherwise(F.array(F.xxhash64(w)))


def with_fingerprint(df: DataFrame, text: Column, out: str, bin_bits: int = BIN_BITS) -> DataFrame:
    """Add ``out``: array of longs, each with sixteen bins of four bits.

    Columns that a lambda reads are named twice, so that the optimizer computes them once per row and not
    once per element.
    """
    bins, keep = 1 << bin_bits, 64 - bin_bits
    half = bins // 2
    place = lambda x: F.shiftright(x, keep) + half
    *table, final = [F.array(*[F.lit(v) for v in row]) for row in _probe_table(bins, PROBES + 1)]
    hashes, ordered, used, behind, filled = "_hashes", "_ordered", "_used", "_behind", "_filled"
    df = df.withColumn("_wordhash", F.transform(words(text), lambda w: F.xxhash64(w)))
    df = df.withColumn(hashes, _shingles(F.col("_wordhash"))).drop("_wordhash")
    df = df.withColumn(ordered, F.sort_array(F.col(hashes))).drop(hashes)
    first = lambda x, i: (i == 0) | (place(x) != place(F.get(F.col(ordered), i - 1)))
    df = df.withColumn(used, F.filter(F.col(ordered), first)).drop(ordered)
    # place -> first occupied bin at or behind it: each occupied bin as often as it has places before it
    runs = F.transform(F.col(used), lambda y, k: F.array_repeat(
        y, (place(y) - F.when(k == 0, F.lit(-1)).otherwise(place(F.get(F.col(used), k - 1)))).cast("int")))
    wrap = F.array_repeat(F.get(F.col(used), F.lit(0)), (F.lit(bins - 1) - place(F.element_at(F.col(used), -1))).cast("int"))
    df = df.withColumn(behind, F.concat(F.flatten(runs), wrap)).drop(used)

    def fill(x: Column, j: Column) -> Column:
        met = []
        for row in table:
            seen = F.get(F.col(behind), F.get(row, j))
            met.append(F.when(place(seen) == F.get(row, j), seen))
        lent = F.coalesce(*met, F.get(F.col(behind), F.get(final, j)))
        return F.when(place(x) == j, x).otherwise(F.xxhash64(lent, j))

    df = df.withColumn(filled, F.when(F.size(behind) == bins, F.transform(F.col(behind), fill))).drop(behind)
    low = (1 << LOW_BITS) - 1
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(bins // 16 - 1)),
        lambda w: F.aggregate(F.slice(F.col(filled), w * 16 + 1, 16), F.lit(0).cast("long"),
                              lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit(low)))),
    )
    return df.withColumn(out, F.when(F.size(filled) == bins, packed)).drop(filled)


def as_hex(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal bins, less the share that is equal by chance."""
    nibble = 0x1111111111111111

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        some = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(some.bitwiseAND(F.lit(nibble)))

    differing = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, n: acc + n)
    chance = 1.0 / (1 << LOW_BITS)
    share = 1.0 - differing / (F.size(a) * 16)
    return F.greatest(F.lit(0.0), (share - chance) / (1.0 - chance))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like they and the next document's are.

    The edited text has its last third of code points replaced by the head of the next document, by descending
    ``doc_id`` (NULL last); after the last comes the first.  Repeated rows are rows of their own.
    """
    least = -(1 << 63)
    ids = F.coalesce("doc_id", F.lit(least)).cast("long")
    span = docs.agg(F.min(ids), F.max(ids)).first()
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = with_fingerprint(base, F.col("text"), "fp")
    base = base.select(ids.alias("key"), F.struct("text", "fp", "doc_id").alias("own"))
    both = next_in_descending_order(base, "key", "own", "other", span=span)
    n = F.length("own.text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("own.text"), F.lit(1), n - cut), F.substring(F.col("other.text"), F.lit(1), cut))
    both = both.select("own.doc_id", n.cast("long").alias("n_chars"), F.col("own.fp").alias("fp"), F.col("other.fp").alias("next_fp"), edited.alias("edited"))
    both = with_fingerprint(both, F.col("edited"), "edited_fp")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
