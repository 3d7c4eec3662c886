"""All queries against DuckDB, and their plans."""

import glob

import pytest
from oracle_check import SMALL, differences, duck

import __spark_entry__ as entry_points
from eventdocs.plans import queries as named
from eventdocs.plans.oracle import ORACLE
from eventdocs.plans.queries import QUERIES

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.fixture(scope="module")
def plans(spark):
    return {
        name: query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        for name, query in QUERIES.items()
    }


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(NAMES)
    assert set(NAMES) <= set(entry_points.queries()) and set(NAMES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, connection, name):
    assert differences(spark, connection, SMALL, name) == []


@pytest.mark.parametrize("name", NAMES)
def test_no_single_task_and_no_pair_of_all(plans, name):
    for step in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert step not in plans[name]


@pytest.mark.parametrize(
    "name, exchanges", [("receipt_items", 1), ("receipt_elements", 1), ("receipt_footers", 1), ("html_items", 0)]
)
def test_row_by_row_queries_shuffle_their_constants_at_most(plans, name, exchanges):
    shuffled = [line for line in plans[name].splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == exchanges and not any("entry_no" in line for line in shuffled)


@pytest.mark.parametrize("name, scans", [("session_labels", 2), ("page_labels", 1)])
def test_ranges_read_their_input_once(plans, name, scans):
    assert plans[name].count("FileScan") == scans


def test_the_list_shuffles_texts_to_their_part_only_once_after_the_joins(plans):
    assert "rangepartitioning" not in plans["citation_list_files"]


def test_only_needed_columns_are_read(plans):
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plans["page_labels"]
    assert "text" not in plans["page_combine"]


def test_damaged_files_hold_their_header_however_the_parts_are_made(spark, connection):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1500",
                "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        files = glob.glob(f"{named._damaged_folder(spark, SMALL)}/event_id=*/*.txt".removeprefix("file:"))
        assert len(files) == 25 and all(open(f).readline().startswith("氏名") for f in files)
        assert differences(spark, connection, SMALL, "roster_damaged") == []
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 150
