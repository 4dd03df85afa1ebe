"""Named queries over the benchmark tables and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_VIEWS = {
    "aln": views.aln_sql, "genome": views.genome_sql, "contigs": views.contigs_sql, "gaps": views.gaps_sql,
    "regions": views.regions_sql, "bnd": views.breakends_sql, "anchors": views.anchors_sql,
}


def query(name: str, using: str = "", sql: str | None = None, recursive: bool = False):
    """Register a query; ``using`` lists the views its SQL needs, in order."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(using, sql, recursive)
        return fn

    return keep


def compose(using: str, sql: str, recursive: bool = False) -> str:
    """Views first, then the query's own CTEs; its final SELECT is the last one that starts a line."""
    parts = [_VIEWS[v]() for v in using.split()]
    head, _, tail = ("\n" + sql.strip()).rpartition("\nSELECT")
    if not tail:
        raise ValueError("the final SELECT must start a line")
    if head.strip():
        parts.append(head.strip().rstrip(","))
    prefix = "WITH RECURSIVE " if recursive else "WITH "
    return (prefix + ",\n".join(parts) + "\n" if parts else "") + "SELECT" + tail
