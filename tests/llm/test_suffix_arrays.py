import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventdocs.llm import queries
from eventdocs.llm import suffix_arrays as sa
from llm_help import SMALL, colliding_texts


@pytest.mark.parametrize("bucket", [1, 10**9])
def test_order_and_common_prefixes_equal_brute_force(monkeypatch, bucket):
    monkeypatch.setattr(sa, "_BUCKET", bucket)
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randrange(1, rng.choice([1, 2, 3, 6]) + 1) for _ in range(rng.randrange(1, 60))] + [0]
        text, order = np.array(x, np.uint8), sorted(range(len(x)), key=lambda i: x[i:])
        assert sa.suffix_array(text).tolist() == order
        shared = sa.common_prefixes(text, np.array(order))
        for before, i in zip([None, *order], order):
            n = 0
            while before is not None and max(i, before) + n < len(x) and x[i + n] == x[before + n]:
                n += 1
            assert shared[i] == n


def expected(rows, length):
    """(kept, removed, stretches) by a table of all strings of the length."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (kept, len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()))
    return out


def found(df):
    return {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, len(r.spans)) for r in df.collect()}


@pytest.mark.parametrize("shard_bytes", [1 << 20, 20_000])
def test_whole_table_equals_brute_force(spark, shard_bytes):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows, 100)
    assert sum(w[2] for w in want.values()) > 0
    assert found(sa.dedup_substrings(docs, shard_bytes=shard_bytes)) == want


def test_short_windows_on_repetitive_texts(make_docs):
    rng = random.Random(4)
    texts = ["", None, "a" * 700, "ab" * 90, "a" * 300, "xyz" * 40, "héé" * 30, "é" * 20]
    for _ in range(60):
        texts.append("".join(rng.choice(["ab", "a", "abcabc", "é", " \n"]) for _ in range(rng.randrange(40))))
    rows = list(enumerate(texts))
    got = found(sa.dedup_substrings(make_docs(texts), length=12))
    assert got == expected(rows, 12)


def test_windows_over_the_place_counter_and_parts(make_docs, monkeypatch):
    texts = ["q" * 66_000 + "ab" * 40_000, "ab" * 300, "".join(random.Random(1).choices("abcdefgh", k=70_000))]
    texts.append(texts[2][30_000:60_000])
    assert found(sa.dedup_substrings(make_docs(texts))) == expected(list(enumerate(texts)), 100)


def test_empty_table_repeated_rows_and_null_keys(make_docs):
    assert sa.dedup_substrings(make_docs([])).collect() == []
    text = "0123456789" * 2
    docs = make_docs([text + "x", text + "x", text, "y" + text], [5, 5, 7, None]).withColumn("kept", F.lit(1))
    rows = sa.dedup_substrings(docs, length=15).collect()
    got = sorted((r.doc_id or 99, bytes(r.kept)) for r in rows)
    assert got[0][1] == got[1][1] == (text + "x").encode()
    assert got[2] == (7, b"") and got[3] == (99, b"y")


def test_other_texts_of_the_same_key_lose_nothing(spark, make_docs):
    a, b = colliding_texts(spark, 7, lambda i: "".join(random.Random(i).choices("abcdefghij ", k=153)))
    rows = [(7, a), (7, b), (8, a + "tail"), (None, b[:120]), (None, "x" * 50)]
    got = sa.dedup_substrings(make_docs([t for _, t in rows], [k for k, _ in rows])).collect()
    kept = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept).decode()) for r in got)
    assert kept == sorted([(False, 7, a), (False, 7, b), (False, 8, "tail"), (True, 0, ""), (True, 0, "x" * 50)])


def test_query_equals_brute_force(spark):
    rows = queries.QUERIES["op5_suffix_array_dedup"](spark, SMALL)
    assert rows.dtypes == [(c, "bigint") for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [("kept_sha256", "string")]
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {k: (v[1], v[2], v[3], hashlib.sha256(v[0]).hexdigest()) for k, v in expected(given, 100).items()}
    assert {r.doc_id: tuple(r)[1:] for r in rows.collect()} == want
