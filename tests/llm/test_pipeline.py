from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from eventdocs.llm import decontaminate, lines
from llm_help import SMALL, exact_groups


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage over the small tables, with two repeated rows and a further column."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 2")).withColumn("row_key", F.lit("own"))
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs.collect())
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "packing"]
    for rows in stages[:-1]:
        assert rows[0].asDict().keys() == stages[0][0].asDict().keys() and {r.row_key for r in rows} == {"own"}


def test_toxicity_drops_whole_rows_only(stages):
    assert not Counter(stages[1]) - Counter(stages[0]) and len(stages[1]) > 0.6 * len(stages[0])


def test_line_dedup_equals_brute_force(stages):
    holders = defaultdict(int)
    for r in stages[1]:
        for key in {lines.line_key(x) for x in r.text.encode().split(b"\n")}:
            holders[key] += 1
    want = Counter()
    for r in stages[1]:
        kept = [x for x in r.text.encode().split(b"\n") if not lines.line_key(x) or holders[lines.line_key(x)] < 10]
        text = b"\n".join(kept).decode()
        want[(r.doc_id, text, r.lang, r.source, len(text))] += 1
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in stages[2]) == want


def test_near_duplicates_equal_brute_force(stages):
    rows = sorted(stages[2], key=lambda r: r.doc_id)
    roots = exact_groups([r.text for r in rows])
    want = [rows[i] for i in sorted(set(roots))]
    assert sorted(stages[3]) == sorted(want) and len(want) < len(rows)


def test_decontamination_equals_brute_force(spark, stages):
    items = [decontaminate.normalized(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = {r.doc_id for r in stages[3] if any(i in decontaminate.normalized(r.text) for i in items)}
    assert held and sorted(stages[4]) == sorted(r for r in stages[3] if r.doc_id not in held)


def test_packing_holds_every_kept_row(stages):
    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}
    whole = {r.doc_id: r.doc_tokens for r in stages[5]}
    assert sum(r.length for r in stages[5]) == sum(whole.values())


def test_odd_rows_and_empty_tables(spark, make_docs):
    docs = make_docs(["", None, "a b c d e f", "a b c d e f", "A b c d e f"], [1, 2, None, 3, 3])
    docs = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit(1)).withColumn("n", F.lit(2))
    for table in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            result = stage(spark, table, SMALL)
            assert result.columns == docs.columns
            table = spark.createDataFrame(result.collect(), docs.schema)
        rows = table.collect()
        assert {r.doc_id for r in rows} == ({1, 3} if rows else set())
        cp.STAGES[-1][1](spark, table, SMALL).collect()


def test_run(spark):
    assert cp.run(spark, SMALL).count() > 0
