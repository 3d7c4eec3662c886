import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventdocs.llm import fm_index as fm
from eventdocs.llm import queries
from llm_help import SMALL, colliding_texts


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 37, 500)
    matrix = fm.WaveletMatrix(symbols)
    for c in range(37):
        at = np.arange(501)
        found = matrix.place(np.full(501, c), at) - matrix.place(np.array([c]), np.array([0]))
        assert found.tolist() == [int((symbols[:i] == c).sum()) for i in at]


def test_backward_search_counts_copies():
    rng = random.Random(3)
    for _ in range(40):
        text = np.array([rng.randrange(2, 5) for _ in range(60)] + [0])
        weights = np.array([rng.randrange(1, 4) for _ in range(60)] + [0])
        index = fm.FMIndex(text, weights, 20)
        for _ in range(20):
            a = rng.randrange(55)
            b = a + rng.randrange(1, 6)
            low, high = np.array([0]), np.array([len(text)])
            for c in text[a:b][::-1]:
                low, high = index.extend(np.array([c]), low, high)
            places = [i for i in range(61 - (b - a)) if (text[i : i + b - a] == text[a:b]).all()]
            assert int(index.occurrences(low, high)[0]) == int(weights[places].sum())


def words_of(text):
    return (text or "").encode().split()


def expected(rows, length):
    times = Counter()
    for _, text in rows:
        words = words_of(text)
        times.update(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
    out = []
    for key, text in rows:
        words = words_of(text)
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - length + 1):
            if times[tuple(words[i : i + length])] > 1:
                gone[i : i + length] = True
        out.append((key, b" ".join(w for w, g in zip(words, gone) if not g), len(words), int(gone.sum())))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, bytes(r.kept), r.n_words, r.n_removed) for r in df.collect())


@pytest.mark.parametrize("shard_words", [400_000, 3_000])
def test_whole_table_equals_brute_force(spark, shard_words):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert sum(w[3] for w in want) > 0
    assert found(fm.dedup_windows(docs, shard_words=shard_words)) == want


def test_short_windows_on_repetitive_texts(make_docs):
    rng = random.Random(9)
    texts = ["", None, "a " * 400, "a b " * 70, "a" * 40, "x y z " * 9, "é\x0bü \x1c\x1c q"]
    for _ in range(120):
        texts.append(" ".join(rng.choice("abc") for _ in range(rng.randrange(25))))
    assert found(fm.dedup_windows(make_docs(texts), length=6)) == expected(list(enumerate(texts)), 6)


def test_edges_of_a_shared_passage(make_docs):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(40):
        own = [f"d{i}w{rng.randrange(10**6)}" for _ in range(rng.randrange(80))]
        at, a, b = rng.randrange(len(own) + 1), rng.randrange(30), rng.randrange(30, 61)
        texts.append(" ".join(own[:at] + passage[a:b] + own[at:]))
    assert found(fm.dedup_windows(make_docs(texts))) == expected(list(enumerate(texts)), 35)


def test_empty_table_repeated_rows_and_null_keys(make_docs):
    assert fm.dedup_windows(make_docs([])).collect() == []
    docs = make_docs(["a b c d", "a b c d", "x a b c", "n o n e"], [1, 1, None, 2]).withColumn("kept", F.lit(1))
    rows = fm.dedup_windows(docs, length=3).collect()
    assert sorted(bytes(r.kept) for r in rows) == [b"", b"", b"n o n e", b"x"]


def test_other_texts_of_the_same_key_lose_nothing(spark, make_docs):
    def text(i):
        rng = random.Random(i)
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(40 + i % 9))

    a, b = colliding_texts(spark, 7, text)
    rows = [(7, a), (7, b), (8, a + " tail"), (None, "n " + a)]
    got = sorted((r.doc_id or 99, bytes(r.kept).decode()) for r in fm.dedup_windows(make_docs([t for _, t in rows], [k for k, _ in rows])).collect())
    assert got == sorted([(7, ""), (7, b), (8, "tail"), (99, "n")])


def test_query_equals_brute_force(spark):
    rows = queries.QUERIES["op4_fm_index_dedup"](spark, SMALL)
    assert rows.dtypes == [(c, "bigint") for c in ("doc_id", "n_words", "n_removed")] + [("kept_sha256", "string")]
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = [(k, n, gone, hashlib.sha256(kept).hexdigest()) for k, kept, n, gone in expected(given, 35)]
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want)
