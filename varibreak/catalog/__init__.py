"""Queries over the benchmark tables, one or more per operator."""

from . import anchors, breakends, calls, clips, files, intervals, libraries, pileups, reads, scans, thresholds  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
