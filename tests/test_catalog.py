"""Every registered query against its SQL on the smallest tables (a spread of them; the driver runs all)."""

import os

import duckdb
import pytest
from tests.conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

SPREAD = [
    "src10_subsequence", "scf05_soft_clip_tuple", "ag01_library_stats", "jn06_mate_join", "jn11_first_overlap", "ag21_depth_runs", "ag04_deletion_term",
    "jn05_hanging_left", "st11_insertion_scan", "wn03_peaks", "ag09_consensus", "jn08_control_removed", "aln01_genome_matches", "wn02_hotspots", "jn14_adjacent_breakends",
    "ag16_fold_change_bracket", "wn08_sweep_clusters", "cl02_contrast_clusters", "wn10_strict_dedup", "gt01_genotypes", "src16_breakdancer", "st09_kappa_bins",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def test_names():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 120


def test_entry(spark):
    assert entry(spark).columns == ["sample", "chrom", "start", "end", "score", "peak"]


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SMALL)
    result = duck.execute(oracle_sql()[name])
    cols = [c[0] for c in result.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, result.fetchall()))


def test_filters_on_derived_reads_are_not_written_out_over_the_table(spark):
    """A filter of a window scan compares a position; spelled down to the table's columns it is thousands of terms."""
    for name in ("st11_deletion_scan", "ag06_coverage_term", "flt06_away_from_gaps"):
        plan = queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        conditions = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
        assert conditions and max(map(len, conditions)) < 1500, name


def test_hanging_scans_join_mates_once(spark):
    for name in ("st11_deletion_hanging_scan", "st11_insertion_scan"):
        plan = queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "qname" not in plan and "l_orderkey" not in plan, name


def test_event_records_make_their_clusters_once(spark, tmp_path, monkeypatch):
    from varibreak.catalog import QUERIES, breakends, clips

    d = str(tmp_path)
    spark.range(300).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{d}/orders.parquet")
    spark.range(1200).selectExpr(
        "id % 300 AS l_orderkey", "id * 7 AS l_partkey", "id AS l_suppkey", "CAST(id % 4 AS INT) AS l_linenumber",
        "CAST(id % 50 AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice").write.parquet(f"{d}/lineitem.parquet")
    made, true = [], clips.clusters
    monkeypatch.setattr(clips, "clusters", lambda *a, **k: made.append(1) or true(*a, **k))
    assert {"CHROM", "POS", "INFO"} <= set(QUERIES["snk06_event_records"](spark, d).columns)
    assert len(made) == 1
