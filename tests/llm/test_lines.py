from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventdocs.llm import lines
from llm_help import SMALL

LOWER = {c: c + 32 for c in range(65, 91)}


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def expected(rows, min_docs, min_chars=1):
    holders = defaultdict(int)
    for _, text in rows:
        for k in {key_of(x) for x in (text or "").split("\n")}:
            holders[k] += len(k) >= min_chars and k != ""
    out = Counter()
    for key, text in rows:
        whole = (text or "").split("\n")
        kept = [x for x in whole if holders[key_of(x)] < min_docs]
        out[(key, "\n".join(kept), len(whole), len(whole) - len(kept))] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in df.collect())


@pytest.mark.parametrize("batches, fanout", [(8, 4), (5, 2), (1, 2)])
def test_whole_table_equals_brute_force(spark, batches, fanout):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()], 4)
    assert sum(k[3] for k in want) > 0
    assert found(lines.dedup_lines(docs, min_docs=4, batches=batches, fanout=fanout)) == want


def test_odd_lines(make_docs):
    texts = ["", None, "\n", "A\n a\t\nb", "a\r\nB \n\x0bb", "\x0c a", "Ä\nä", "Ä\nä", " \u00a0\n\u00a0", "\u00a0", "a\n" * 5000 + "z", "b"]
    docs = make_docs(texts).withColumns({"pos": F.lit("x"), "h1": F.lit("y"), "kept": F.lit(1), "n": F.lit(2)})
    rows = list(enumerate(texts))
    assert found(lines.dedup_lines(docs, min_docs=2)) == expected(rows, 2)
    assert found(lines.dedup_lines(docs, min_docs=2, min_chars=2)) == expected(rows, 2, 2)


def test_repeated_rows_null_keys_and_empty_tables(make_docs):
    rows = [(1, "x\ny"), (1, "x\ny"), (1, "q"), (None, "x"), (None, "x")]
    docs = make_docs([t for _, t in rows], [k for k, _ in rows])
    assert found(lines.dedup_lines(docs, min_docs=3)) == expected(rows, 3)
    assert found(lines.dedup_lines(docs, min_docs=2)) == expected(rows, 2)
    assert lines.dedup_lines(make_docs([])).collect() == []


def test_runs_are_merged_by_level_and_removed(spark):
    runs = lines.LineRuns(spark, min_docs=3, fanout=2, buckets=3)
    for batch in range(5):
        rows = [(h, h, 1) for h in range(batch, 6)] + [(99, 99, 3)]
        runs.add(spark.createDataFrame(rows, "h1 bigint, h2 bigint, n bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r.h1 for r in runs.frequent().collect()) == [2, 3, 4, 5, 99]
    sizes = [spark.table(n).where("h1 = 99").count() for n in runs.names()]
    assert sum(sizes) == 1  # a settled key is not added again
    names = runs.names()
    runs.clear()
    assert not any(spark.catalog.tableExists(n) for n in names)
