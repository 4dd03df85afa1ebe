"""CIGAR strings as columns.

``=`` and ``X`` count as ``M`` everywhere.  A string with more than two soft
clips is malformed; its clip columns are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

READ_LENGTH_CLASS = "MX=IN"
REFERENCE_LENGTH_CLASS = "MX=DN"
QUERY_LENGTH_CLASS = "MIS=X"


def cigar_ops(cigar: Column) -> Column:
    """``array<struct<op:string,len:int>>`` in read order."""
    lengths = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MIDNSHP=X]"), F.lit(1))
    letters = F.regexp_extract_all(cigar, F.lit("[0-9]+([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(letters, lengths, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))


def number_sum(text: Column, pattern: str) -> Column:
    """Sum of group 1 of every match of ``pattern``, as BIGINT."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def first_number(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, ``'0'`` when there is none."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found == "", F.lit("0")).otherwise(found)


def aligned_length(cigar: Column, op_class: str = READ_LENGTH_CLASS) -> Column:
    return number_sum(cigar, f"([0-9]+)[{op_class}]")


def has_clip(cigar: Column) -> Column:
    return cigar.contains("S")


def soft_clip(cigar: Column) -> Column:
    """``struct<n_left, gap_left, n_match, to_right, n_right>``.

    ``gap_left`` counts the bases from after the left clip through the first
    matched run when something lies between them; ``to_right`` is the distance
    from the first matched base to the right clip.
    """
    clips = F.regexp_extract_all(cigar, F.lit("([0-9]+)S"), F.lit(1))
    n = F.size(clips)
    starts_clipped = F.regexp_like(cigar, F.lit("^([0-9]+H)?[0-9]+S"))
    matched = number_sum(cigar, "([0-9]+)[M=X]")
    left = F.when((n == 2) | ((n == 1) & starts_clipped), F.get(clips, F.lit(0)).cast("int"))
    right = F.when(n == 2, F.get(clips, F.lit(1)).cast("int")).when((n == 1) & ~starts_clipped, F.get(clips, F.lit(0)).cast("int"))
    between = F.regexp_extract(cigar, "^[^S]*S((?:[0-9]+[IDNHP])+[0-9]+[M=X])", 1)
    usable = matched > 0
    value = F.struct(
        F.when(usable, F.coalesce(left, F.lit(0))).otherwise(0).alias("n_left"),
        F.when(usable & left.isNotNull(), number_sum(between, "([0-9]+)")).alias("gap_left"),
        matched.alias("n_match"),
        F.when(usable & right.isNotNull(), matched + number_sum(cigar, "([0-9]+)D")).alias("to_right"),
        F.when(usable, F.coalesce(right, F.lit(0))).otherwise(0).alias("n_right"),
    )
    return F.when(n <= 2, value)


def cigar_walk(cigar: Column) -> Column:
    """``array<struct<op, len, query, ref>>``: every operation with the read and reference bases before it.

    Soft clips count as read bases; reference bases count from the first aligned one.
    """
    ops = cigar_ops(cigar)
    none = F.array().cast("array<struct<op:string,len:int,query:int,ref:int>>")
    start = F.struct(none.alias("done"), F.lit(0).alias("q"), F.lit(0).alias("r"))

    def step(at, x):
        entry = F.struct(x["op"].alias("op"), x["len"].alias("len"), at["q"].alias("query"), at["r"].alias("ref"))
        return F.struct(
            F.concat(at["done"], F.array(entry)).alias("done"),
            (at["q"] + F.when(x["op"].isin(*QUERY_LENGTH_CLASS), x["len"]).otherwise(0)).alias("q"),
            (at["r"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0)).alias("r"),
        )

    return F.aggregate(ops, start, step, lambda at: at["done"])


def _indels(cigar: Column, letter: str) -> Column:
    return F.transform(
        F.filter(cigar_walk(cigar), lambda x: x["op"] == letter),
        lambda x: F.struct(x["ref"].alias("offset"), x["len"].alias("length"), x["query"].alias("read_offset")),
    )


def insertions(cigar: Column) -> Column:
    """``array<struct<offset,length,read_offset>>``: reference bases from the first match, and read bases before."""
    return _indels(cigar, "I")


def deletions(cigar: Column) -> Column:
    return _indels(cigar, "D")


def head_clip(cigar: Column) -> Column:
    return first_number(cigar, "^([0-9]+)S").cast("int")


def tail_clip(cigar: Column) -> Column:
    return first_number(cigar, "([0-9]+)S$").cast("int")


def imputed_isize(isize_self: Column, cigar_self: Column, isize_mate: Column, cigar_mate: Column,
                  left: bool, self_side: bool) -> Column:
    """Insert size corrected by the clipped bases of both ends.

    The clip of the read itself is taken at its head on the left side and at its
    tail on the right side, the mate's at the opposite end.
    """
    own = head_clip(cigar_self) if left else tail_clip(cigar_self)
    other = tail_clip(cigar_mate) if left else head_clip(cigar_mate)
    base = isize_self if self_side else isize_mate
    return base + own + other if left == self_side else base - own - other
