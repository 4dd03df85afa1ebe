"""Typed options and the small option languages of the commands."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import constants as C


def parse_pairs(text: str) -> dict[str, str]:
    """``minmpr=5,maxins=50000``; a word without ``=`` is an error."""
    items = [item for item in text.split(",") if item]
    if bare := [item for item in items if "=" not in item]:
        raise ValueError(f"options are name=value, not {bare}")
    return dict(item.split("=", 1) for item in items)


def parse_sample_pairs(text: str, known: set[str]) -> tuple[dict[str, str], dict[str, str]]:
    """``minmpr=2,maxins=50000:minmpr=5,maxins=50000`` -> options of control and case; a single part serves both."""
    parts = [checked(parse_pairs(part), known) for part in text.split(":")]
    if len(parts) > 2:
        raise ValueError(f"one part per sample, control:case, not {text!r}")
    return parts[0], parts[-1]


def checked(options: dict[str, str], known: set[str]) -> dict[str, str]:
    """``options``, which may hold words of ``known`` only."""
    if unknown := sorted(set(options) - known):
        raise ValueError(f"unknown options {unknown}; known are {sorted(known)}")
    return options


def parse_tracks(text: str) -> list[list[dict[str, str]]]:
    """``track=lCd,method=empr_track=ins,sup=50:track=...``: per sample (``:``) a list of tracks (``_track=``)."""
    samples = []
    for part in text.split(":"):
        pieces = part.split("_track=")
        samples.append([parse_pairs(p if i == 0 else "track=" + p) for i, p in enumerate(pieces)])
    return samples


def parse_typed(text: str) -> dict[str, str | float]:
    """``name=text,other_3.5``: ``=`` keeps text, ``_`` makes a number."""
    out: dict[str, str | float] = {}
    for item in filter(None, text.split(",")):
        if "=" in item:
            key, value = item.split("=", 1)
            out[key] = value
        elif "_" in item:
            key, value = item.split("_", 1)
            out[key] = float(value)
    return out


def parse_int_pair(text: str) -> tuple[int, int]:
    """``10000:3``."""
    a, b = text.split(":")
    return int(a), int(b)


def parse_files(text: str) -> list[list[str]]:
    """``control.rg1,control.rg2:case.rg1`` -> libraries per sample."""
    return [[f for f in group.split(",") if f] for group in text.split(":")]


def parse_rules(text: str) -> list[list[list[str]]]:
    """``lCBS:lCd,lDl+lDr``: per file (``:``) rules joined by OR (``,``) of tracks joined by AND (``+``)."""
    return [[rule.split("+") for rule in part.split(",")] for part in text.split(":")]


def parse_confirm(text: str) -> set[str]:
    return {w for w in text.split(",") if w}


def parse_sample(text: str) -> dict[str, str]:
    """``spX,INFO,MIX,DESCRIPTION``."""
    return dict(zip(("id", "info", "mixture", "description"), text.split(",")))


@dataclass
class StatOptions:
    """xmax, yield (None: all reads), chromosome, outputs and step of the statistics command."""

    xmax: int = 2000
    yield_reads: int | None = None
    chromosome: str = "A"
    out: str = "none"
    merged: str = "none"
    step: int = 10


@dataclass
class ScanOptions:
    """Window scan; None means "learn from the library statistics"."""

    chromosome: str = "a"
    start: int = 1
    end: int = 3_000_000_000
    mixing_rate: float = 0.5
    width: int = 100
    step: int = 10
    gap: str = ""
    coverage: float | None = None
    read_length: int | None = None
    insert_size: float | None = None
    insert_sd: float | None = None
    delta: int | None = None
    big_deletion: int | None = None
    prob_hang: float | None = None
    prob_hang_right: float | None = None
    prob_soft: float | None = None
    out: str = "input"

    def __post_init__(self):
        if self.step <= 0:
            raise ValueError("step must be positive")
        if not 0 <= self.mixing_rate <= 1:
            raise ValueError("mixing rate must lie in 0..1")
        if self.width <= 0:
            raise ValueError("width must be positive")


@dataclass
class ClipOptions:
    """Soft-clip scan: cluster support (control:case), filters and event thresholds."""

    chromosome: str = "a"
    gap: str = "none"
    min_reads: tuple[int, int] = (3, 5)
    min_bases: tuple[int, int] = (30, 50)
    sample: str = "spX,INFO,MIX,DESCRIPTION"
    del_threshold: float = C.DEL_FOLD
    dup_threshold: float = C.DUP_FOLD
    max_fold: int = C.MAX_FOLD_LENGTH
    min_fold: int = C.MIN_FOLD_LENGTH
    min_separation: int = C.MIN_BREAKEND_SEPARATION
    insertion: tuple[int, int] = (0, 0)
    hotspot: tuple[int, int] = (C.HOTSPOT_DISTANCE, C.HOTSPOT_SIZE)
    gap_distance: int = C.GAP_DISTANCE
    coverage: bool = True
    out: str = "input"


TRACKS_ONE = "track=lCd,method=empr,thresh=level7,sup=100,gap=100_track=lDr+lDl,method=theo,thresh=level3,sup=100,gap=100_track=ins,sup=50,cvg=5_track=del,sup=50,cvg=5"


@dataclass
class JoinOptions:
    """Evidence options and the confirmation set of the joining command."""

    chromosome: str = "a"
    tracks: str = TRACKS_ONE
    big: str = "minmpr=5,maxins=50000"
    discordant: str = "minmpr=5,maxins=10000"
    change_point: str = "minstat=0,sup=1500,gap=1000,expand=2000,good=4"
    coverage: str = "width=10000,gap=0,sup=0"
    hanging: str = "width=250,minfwd=2,minrev=2"
    confirm: str = "dedup"
    sample: str = "spX,INFO,MIX,DESCRIPTION"
    out: str = "input"


@dataclass
class GenotypeOptions:
    sample: str = "spX,INFO,MIX,DESCRIPTION"
    parameters: dict[str, str | float] = field(default_factory=dict)
    out: str = "input"
