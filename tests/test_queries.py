from pathlib import Path

import duckdb
import pytest

from packwatch.plans import catalog
from support import DATA, same

#: Queries whose order-dependent meaning SQL doesn't express.
ROWS_ONLY = {"dedup_entities_fuzzy"}
WIDER = "/root/testdata/sf0.1"


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - ROWS_ONLY))
def test_query_equals_its_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, DATA), duck.sql(catalog.ORACLE_SQL[name]))


def test_ingest_reads_each_event_once(spark, duck):
    rows = catalog.QUERIES["ingest_incremental"](spark, DATA)
    assert rows.count() == rows.select("event_id").distinct().count() == duck.sql("select count(distinct event_id) from events").fetchall()[0][0]


def test_windows_of_events_hold_ninety_days(spark):
    rows = catalog.QUERIES["dedup_events_window"](spark, DATA).toPandas()
    for _, group in rows.groupby(["entity_id", "size_before", "size_after"]):  # only events of equal sizes are one
        days = sorted(group["observed_date"])
        assert all((b - a).days > 90 for a, b in zip(days, days[1:]))


@pytest.fixture
def tied(tmp_path):
    """Products of a larger table whose mean fall lies between two tenths, and their own engine."""
    con = duckdb.connect()
    for path in Path(WIDER).glob("*.parquet"):
        keep = {"part": "where p_partkey in (select p from w)", "lineitem": "where l_partkey in (select p from w)"}.get(path.stem, "")
        con.sql("create or replace table w as select unnest([323, 40, 512, 9346]) + i as p from (select unnest(range(0, 10000, 40)) as i)")
        con.sql(f"copy (select * from '{path}' {keep}) to '{tmp_path / path.name}' (format parquet)")
        con.sql(f"create view {path.stem} as select * from '{tmp_path / path.name}'")
    con.sql("set threads = 1")
    return str(tmp_path), con


def test_means_between_tenths_round_as_in_sql(spark, tied):
    folder, con = tied
    same(catalog.QUERIES["product_index"](spark, folder), con.sql(catalog.ORACLE_SQL["product_index"]))


def test_each_matched_claim_has_its_events_summary(spark):
    rows = {r.claim_id: r for r in catalog.QUERIES["stuck_cleanup"](spark, DATA).collect()}
    assert sum(r.status == "evidence" for r in rows.values()) > 10
    for r in rows.values():
        assert (r.summary is not None) == (r.status in ("matched", "evidence"))
        if r.status == "evidence":
            assert str(r.claim_id) in r.summary.split(",")


def test_work_on_pages_is_dealt_to_all_cores(spark):
    assert catalog.QUERIES["html_size_extract"](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["dominant_source", "evidence_sources", "events_without_image", "fuzzy_duplicate_groups", "reassigned_events", "dedup_events_wide"])
def test_makers_are_not_looked_up_where_no_column_needs_them(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "s_nationkey" not in plan


def test_dominant_source_orders_no_rows_of_a_product(spark):
    plan = catalog.QUERIES["dominant_source"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


@pytest.mark.parametrize("name", ["flap_guarded", "release_drops"])
def test_observations_carry_no_unused_columns(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_discount" not in plan.replace("Relation", "\nRelation").split("\nRelation")[0]


@pytest.mark.parametrize("name", ["turnover", "turnover_groups"])
def test_turnover_joins_codes_once(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("dense_rank") == 2


@pytest.mark.parametrize("name", ["reassigned_claims", "reassigned_events"])
def test_events_to_reassign_are_made_once(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan


def test_versions_come_from_one_pass_over_changes(spark):
    plan = catalog.QUERIES["backfill_versions"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "l_partkey" in plan


@pytest.mark.parametrize("name", ["flap_guarded", "kroger_changes"])
def test_rows_that_fail_the_guards_carry_nothing_on(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "END AS found#" in plan
