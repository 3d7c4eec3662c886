import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventdocs.llm import packing
from llm_help import SMALL


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, tokenizer, most):
    """Every id in one piece with the right checksum, sequences gapless and not too long; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_doc) == sorted(texts)
    for key, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    used = []
    for slots in by_sequence.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at and length > 0
            at += length
        assert at <= most
        used.append(at)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return sum(most - u for u in used if u & (u - 1)) / sum(used)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(packing.pack(docs).collect(), texts, tokenizer, 2048) < 0.02


def test_odd_texts(make_docs, tokenizer):
    texts = ["", None, " \n\t", "a", "İΑΣ é ́x", "a<|endoftext|>b <|startoftext|>", "x" * 5000, "tie", "tie",
             "No break wide", "don't we'll 12 345", "\x1c\x1d\u0085 end", "a b " * 3000]
    texts = dict(enumerate(texts))
    docs = make_docs(list(texts.values()))
    check(packing.pack(docs, most=64).collect(), texts, tokenizer, 64)


def test_word_by_word_ids_equal_those_of_the_whole_text(spark, tokenizer):
    encoder = packing.WordIds("word_bpe_49k.json")
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["ΑΣ. İst! Σ ß? Å)) x|| a-b ² ½. don't! 'll it's: “q” a.b.c 日本語。 ﬁ, ǅ;", "a" * 300 + "."]
    words = [t.encode().split() for t in texts]
    encoder.learn(words)
    for text, own in zip(texts, words):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.ids(own) == want


def test_empty_table_repeated_rows_null_keys_and_other_columns(spark, make_docs):
    assert packing.pack(make_docs([])).collect() == []
    docs = make_docs(["a b", "a b", "c"], [1, 1, None]).selectExpr("*", "1 AS start", "'x' AS rank", "2 AS part")
    rows = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, None: 1}
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50)))
def test_patterns_use_the_histogram_up(histogram):
    used = Counter()
    for pattern, count in packing.shortest_pack_first(histogram, 64):
        assert sum(pattern) <= 64 and count > 0
        for length in pattern:
            used[length] += count
    assert used == histogram
