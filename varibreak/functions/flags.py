"""Alignment flag bits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import DUPLICATE, FLAG_NAMES, MATE_UNMAPPED, QC_FAIL, UNMAPPED


def flag_columns(flag: Column) -> list[Column]:
    """The eleven named bits as boolean columns."""
    return [(flag.bitwiseAND(1 << i) != 0).alias(name) for i, name in enumerate(FLAG_NAMES)]


def usable(flag: Column) -> Column:
    """Neither duplicate nor quality-failed."""
    return flag.bitwiseAND(DUPLICATE + QC_FAIL) == 0


def clip_usable(flag: Column) -> Column:
    return flag.bitwiseAND(DUPLICATE + QC_FAIL + UNMAPPED) == 0


def hanging(flag: Column) -> Column:
    """Paired, itself mapped, mate unmapped (semantics chosen here)."""
    return flag.bitwiseAND(1 + UNMAPPED + MATE_UNMAPPED) == 1 + MATE_UNMAPPED
