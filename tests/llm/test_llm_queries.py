"""The queries themselves, over the small tables."""

import hashlib
import zlib

import pytest
from test_classifiers import auc
from test_decontaminate import nearest
from test_packing import check
from test_simhash import expected as simhash_expected
from test_sketches import expected as sketches_expected

from eventdocs.llm import decontaminate, queries
from llm_help import SMALL


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def run(spark, name, types):
    found = queries.QUERIES[name](spark, SMALL)
    assert found.dtypes[: len(types)] == types
    return found.collect()


def longs(*names):
    return [(n, "bigint") for n in names]


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    types = longs("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    rows = run(spark, "op1_packing", types)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert check(rows, texts, tokenizer, 2048) < 0.02


def test_decontamination(spark, texts):
    rows = run(spark, "op2_decontamination", longs("doc_id", "item_id", "edits", "start", "end"))
    items = {r.item_id: decontaminate.normalized(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    shown = {k: decontaminate.normalized(t or "") for k, t in texts.items()}
    found = {(r.doc_id, r.item_id) for r in rows}
    assert {(k, i) for k, t in shown.items() for i, item in items.items() if item in t} <= found
    for r in rows:
        part = shown[r.doc_id][r.start : r.end]
        longest = max(len(items[r.item_id]) - len(part), 0)
        assert longest > 0 or nearest(items[r.item_id], part) == r.edits <= len(items[r.item_id]) // 10


def test_toxicity(spark, texts):
    rows = run(spark, "op6_toxicity", [*longs("doc_id"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")])
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    # The small tables have too few labels to learn from.
    larger = SMALL.replace("0.001", "0.01")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = queries.QUERIES["op6_toxicity"](spark, larger).collect()
    own = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert len(own) > 100 and auc([s for s, _ in own], [t for _, t in own]) > 0.8


def test_fingerprints(spark, texts):
    types = [*longs("doc_id", "n_chars"), ("edited_sha256", "string"), ("fingerprint", "string"),
             ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    rows = run(spark, "op7_fingerprints", types)
    want, by_text = sketches_expected(list(texts.items())), {}
    for r in rows:
        n, edited, near_edited, near_next = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - near_edited) <= 0.15 and abs(r.near_next - near_next) <= 0.15
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(rows) == len(texts) and len(set(by_text.values())) > 0.9 * len(by_text)


def test_quality(spark, texts):
    rows = run(spark, "op8_quality", [*longs("doc_id"), ("expected_grade", "double"), ("tail_probability", "double")])
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    own = [(r.expected_grade, good[r.doc_id]) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in good]
    assert len(own) > 20 and auc([s for s, _ in own], [q for _, q in own]) > 0.8


def test_simhash(spark, texts):
    rows = run(spark, "op10_simhash", [*longs("doc_id"), ("fingerprint", "string"), *longs("component_id")])
    want = [(k, f"{fp:016x}", component) for k, fp, component in simhash_expected(list(texts.items()), 4, 4)]
    assert sorted(tuple(r) for r in rows) == want
