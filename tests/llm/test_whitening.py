import numpy as np
import pytest
from pyspark.sql import functions as F

from eventdocs.llm import queries, whitening
from llm_help import SMALL

VECTORS = "vec_id bigint, embedding array<double>, label int, component string, n string"


def brute_force(rows):
    """x of every vector as exact integers, and eigenpairs of the dense covariance."""
    x = np.floor(64 * np.array(rows, float)).astype(np.int64) + 1_000_000
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    exact = [sum((len(x) * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(0))) for row in x]
    return x, c, values[::-1], vectors[:, ::-1], exact


def compare(found, ids, rows, count):
    x, c, values, vectors, exact = brute_force(rows)
    at = {i: k for k, i in enumerate(ids)}
    assert len(found) == len(rows) * count
    for component in range(1, count + 1):
        own = [r for r in found if r.component == component]
        got = np.array([r.whitened for r in own])
        want = (c @ vectors[:, component - 1] / np.sqrt(values[component - 1]))[[at[r.vec_id] for r in own]]
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert all(abs(r.explained - values[component - 1] / values.sum()) < 1e-12 for r in own)
    assert all(r.n == len(rows) and r.deviation == exact[at[r.vec_id]] for r in found)
    assert {r.identity_error for r in found} and max(r.identity_error for r in found) < 1e-9


def test_query_equals_brute_force(spark):
    found = queries.QUERIES["op13_whitening"](spark, SMALL)
    assert found.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                            ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    compare(found.collect(), [r.vec_id for r in given], [r.embedding for r in given], 32)


@pytest.mark.parametrize("dims, count", [(300, 5), (40, 40), (90, 12)])
def test_jacobi_davidson_equals_dense_eigenpairs(dims, count):
    rng = np.random.default_rng(dims)
    q = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    values = np.sort(rng.exponential(1, dims) ** 3)[::-1]
    a = (q * values) @ q.T
    calls = []
    got, vectors = whitening.jacobi_davidson(lambda b: calls.append(b.shape) or a @ b, dims, count)
    assert np.abs(got - values[:count]).max() < 1e-12 * values[0]
    assert np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(count)).max() < 1e-12
    assert max(width for _, width in calls) <= count + whitening.GUARD and len(calls) < 150


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    a = (q * np.linspace(-3, 5, 12)) @ q.T
    right = rng.normal(size=(12, 4))
    assert np.abs(a @ whitening.minres(lambda v: a @ v, right, 12) - right).max() < 1e-8
    assert not whitening.minres(lambda v: a @ v, np.zeros((12, 2)), 3).any()


def test_odd_vectors(spark):
    good = [[float(i % 5), float(i * i % 7), 3.0 - i] for i in range(20)]
    odd = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [], [1e300, 0.0, 0.0]]
    rows = [(i, v, 1, "c", "n") for i, v in enumerate(good)] + [(99, v, None, None, None) for v in odd]
    docs = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = whitening.whiten(docs, whitening.fit(docs))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found.collect(), list(range(20)), good, 3)


def test_repeated_and_null_keys_stay(spark):
    rows = [(k, [float(i), float(i * i % 3)], 0, "", "") for i, k in enumerate([1, 1, None, None, 5])]
    docs = spark.createDataFrame(rows + rows[:1], VECTORS)
    found = whitening.whiten(docs, whitening.fit(docs, count=1)).collect()
    assert sorted(str(r.vec_id) for r in found) == ["1", "1", "1", "5", "None", "None"]


def test_missing_directions_and_empty_tables(spark):
    flat = [(i, [float(i), 2.0 * i, 7.0], 0, "", "") for i in range(10)]
    docs = spark.createDataFrame(flat, VECTORS)
    found = whitening.whiten(docs, whitening.fit(docs)).collect()
    assert {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-12
    for table in (docs.limit(0), docs.where("vec_id = 3"), docs.withColumn("embedding", F.lit(None).cast("array<double>"))):
        assert whitening.whiten(table, whitening.fit(table)).collect() == []


def test_deviation_is_exact_or_null(spark):
    rows = [(i, [1e9 * i, -float(i)], 0, "", "") for i in range(9)] + [(9, [6e13, 0.5], 0, "", "")]
    docs = spark.createDataFrame(rows, VECTORS)
    exact = brute_force([r[1] for r in rows])[4]
    found = {r.vec_id: r.deviation for r in whitening.whiten(docs, whitening.fit(docs)).collect()}
    assert found == {i: v if v < 1 << 63 else None for i, v in enumerate(exact)} and None in found.values()
