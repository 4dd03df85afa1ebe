"""Bases and sequences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import NIBBLE_LETTERS

_ASCII = "".join(map(chr, range(128)))


def base_code(base: Column) -> Column:
    """A, C, G, T -> 1..4, anything else 5; case-insensitive."""
    upper = F.upper(base)
    return F.when(upper == "A", 1).when(upper == "C", 2).when(upper == "G", 3).when(upper == "T", 4).otherwise(5)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def hamming(a: Column, b: Column) -> Column:
    """Mismatching columns of two equally long strings."""
    return F.size(
        F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    )


def within_one_mismatch(a: Column, b: Column) -> Column:
    """Equal length and at most one mismatch.

    One half must then agree exactly; that cheap test comes first and the column
    count runs only on what passes it.
    """
    length = F.length(b)
    half = F.floor(length / 2).cast("int")
    first = F.substr(a, F.lit(1), half) == F.substr(b, F.lit(1), half)
    second = F.substr(a, half + 1, length) == F.substr(b, half + 1, length)
    return (F.length(a) == length) & (first | second) & (hamming(a, b) <= 1)


def decode_bases(packed: Column, length: Column) -> Column:
    """Bases of two-to-a-byte codes (binary), the first ``length`` of them; the code's value is the letter's place in ``=ACMGRSVTWYHKDBN``."""
    return F.substring(F.translate(F.hex(packed), "0123456789ABCDEF", NIBBLE_LETTERS), F.lit(1), length.cast("int"))


def encode_bases(seq: Column) -> Column:
    """Two-to-a-byte codes of a sequence; letters the code lacks count as N, an odd end is filled with code 0."""
    letters = F.regexp_replace(F.upper(seq), f"[^{NIBBLE_LETTERS}]", "N")
    # one look at each letter where all are ASCII; others may become several letters in upper case
    place = lambda letter: f"{NIBBLE_LETTERS.find(letter):X}" if letter in NIBBLE_LETTERS else "F"
    ascii_codes = F.translate(seq, _ASCII, "".join(place(c.upper()) for c in _ASCII))
    codes = F.when(F.length(seq) == F.octet_length(seq), ascii_codes).otherwise(F.translate(letters, NIBBLE_LETTERS, "0123456789ABCDEF"))
    return F.unhex(F.concat(codes, F.when(F.length(codes) % 2 == 1, "0").otherwise("")))
