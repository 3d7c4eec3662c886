from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventdocs.operators import ordinal
from eventdocs.operators.constants import constants_rejects, with_constants
from eventdocs.operators.ordinal import dense_ordinal, doubled_keys, running_total, slice_starts, tied_ordinal

KEYS = st.one_of(st.integers(-20, 60), st.integers(-(2**63), 2**63 - 1))
SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def expected_ordinals(rows):
    groups = defaultdict(list)
    for group, key in rows:
        groups[group].append(key)
    return {(g, k): i for g, keys in groups.items() for i, k in enumerate(sorted(keys))}


@SLOW
@given(st.sets(st.tuples(st.integers(0, 2), KEYS), min_size=1, max_size=60))
def test_dense_ordinal_numbers_any_keys(spark, rows):
    df = spark.createDataFrame(list(rows), "g BIGINT, k BIGINT")
    got = {(r["g"], r["k"]): r["o"] for r in dense_ordinal(df, ["g"], "k", "o", bits=2, block_bits=3).collect()}
    assert got == expected_ordinals(rows)


def test_hot_group_is_cut_into_slices(spark):
    rows = spark.range(0, 5000).select(F.lit(7).alias("g"), F.col("id").alias("k"))
    starts = slice_starts(rows, ["g"], "k", bits=6, block_bits=4).collect()
    assert len(starts) == 5000 // 64 + 1
    assert all(row["_start"] == row["_slice"] * 64 for row in starts)
    numbered = dense_ordinal(rows, ["g"], "k", "o", bits=6, block_bits=4)
    assert numbered.where("o <> k").count() == 0 and numbered.count() == 5000


@pytest.mark.parametrize("row", [(None, 1), (1, None)])
def test_row_without_place_fails(spark, row):
    df = spark.createDataFrame([(1, 5), row], "g BIGINT, k BIGINT")
    with pytest.raises(Exception, match="no place in the order"):
        dense_ordinal(df, ["g"], "k", "o").collect()


TIED = st.tuples(st.integers(0, 1), st.one_of(st.none(), st.integers(-2, 3)), st.integers(-9, 9), st.sampled_from("ab"))


def nulls_first(value):
    return (value is not None, value or 0)


@SLOW
@given(st.lists(TIED, min_size=1, max_size=60), st.sampled_from([1, 5, 1000]))
def test_tied_ordinal_numbers_repeated_keys_and_rows(spark, rows, most):
    df = spark.createDataFrame(rows, "g BIGINT, k BIGINT, t BIGINT, x STRING")
    found = tied_ordinal(df, ["g"], "k", "o", tie="t", most=most, bits=1, tie_bits=2).collect()
    got = [tuple(r)[:4] for r in sorted(found, key=lambda r: (r["g"], r["o"]))]
    assert got == sorted(rows, key=lambda r: (r[0], nulls_first(r[1]), r[2], r[3]))
    assert all([r["o"] for r in sorted(found, key=lambda r: r["o"]) if r["g"] == g] == list(range(sum(x[0] == g for x in rows))) for g in (0, 1))


def test_the_order_does_not_follow_the_size_of_a_slice(spark):
    df = spark.range(0, 3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("k"), "id")
    one, cut = (
        {r["id"]: r["o"] for r in tied_ordinal(df, ["g"], "k", "o", most=most).collect()} for most in (1 << 16, 10)
    )
    assert one == cut


def test_a_third_of_the_rows_under_one_key_is_cut_to_slices(spark):
    df = spark.range(0, 30_000).select(F.lit(1).alias("g"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    numbered = tied_ordinal(df, ["g"], "k", "o", tie="id", most=1000, bits=8, tie_bits=9)
    assert numbered.select("o").distinct().count() == 30_000 and numbered.agg(F.max("o")).first()[0] == 29_999
    hot = numbered.where("k = 5 AND id % 3 = 0").orderBy("o").collect()
    assert [r["id"] for r in hot] == list(range(0, 30_000, 3)) and hot[-1]["o"] - hot[0]["o"] in (9_999, 10_000)
    windows = [line for line in numbered._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line]
    assert any("_cell" in line and "_tie" in line for line in windows)


def test_doubled_keys_are_reported(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (2, None), (2, None)], "g BIGINT, k BIGINT")
    assert {tuple(r) for r in doubled_keys(df, ["g"], "k").collect()} == {(1, 1, 2), (2, None, 2)}


def test_running_total_over_text_keys(spark):
    rows = [(f"job{i % 3}", f"f{i:04}" if i % 2 else f"f{i}", i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "job STRING, name STRING, n BIGINT")
    got = {(r["job"], r["name"]): r["before"] for r in running_total(df, ["job"], ["name"], "n", "before").collect()}
    for job in {r[0] for r in rows}:
        total = 0
        for _, name, n in sorted(r for r in rows if r[0] == job):
            assert got[job, name] == total
            total += n
    assert len(got) == 400


def test_constants_reach_every_row_once(spark):
    rows = spark.range(0, 300).select((F.col("id") % 5).alias("event_id"), F.shiftleft("id", 19).alias("entry_no"))
    events = [(0, "a"), (1, "b"), (2, "c"), (4, "twice"), (4, "twice"), (None, "none")]
    events = spark.createDataFrame(events, "event_id BIGINT, name STRING")
    for parts in (1, 32):
        got = with_constants(rows, events, parts=parts).select("event_id", "entry_no", "name").collect()
        assert len(got) == 300
        assert {(r["event_id"], r["name"]) for r in got} == {(0, "a"), (1, "b"), (2, "c"), (3, None), (4, None)}
    assert [tuple(r) for r in constants_rejects(events).collect()] == [(4, 2)]


def test_more_constants_than_are_broadcast(spark):
    events = spark.range(0, 30_000).select(F.col("id").alias("event_id"), F.concat(F.lit("e"), "id").alias("name"))
    rows = spark.range(0, 60_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 30_000).alias("event_id"), F.col("id").alias("entry_no")
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joined = with_constants(rows, events)
        wrong = F.coalesce(F.col("name") != F.concat(F.lit("e"), "event_id"), F.lit(True))
        assert joined.count() == 60_000 and joined.where(wrong).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_tied_ordinal_makes_more_parts_of_more_rows(spark, monkeypatch):
    monkeypatch.setattr(ordinal, "_PART_ROWS", 100)
    rows = spark.range(3000).selectExpr("id % 2 AS event_id", "IF(id % 3 = 0, 1, id) AS entry_no", "id AS place", "id % 5 AS desk")
    by = Window.partitionBy("event_id").orderBy("entry_no", "place", "desk")
    expected = sorted(rows.withColumn("position", F.row_number().over(by) - 1).collect())
    for most in (50, 5000):  # all slices are cut, none is
        got = ordinal.tied_ordinal(rows, ["event_id"], "entry_no", "position", tie="place", most=most)
        assert sorted(got.collect()) == expected
        assert got.rdd.getNumPartitions() >= 30


def test_constants_are_not_copied_by_default(spark):
    events = spark.range(0, 100).select(F.col("id").alias("event_id"), F.lit("e").alias("name"))
    rows = spark.range(0, 1000).select((F.col("id") % 100).alias("event_id"), F.col("id").alias("entry_no"))
    joined = with_constants(rows, events)
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.where("name = 'e'").count() == 1000
