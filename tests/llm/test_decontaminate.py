import random

import numpy as np
from pyspark.sql import functions as F

from eventdocs.llm import decontaminate as dc
from llm_help import SMALL

LETTERS = "abcdefghij klmnop qrstuv"


def nearest(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = np.zeros(len(text) + 1, int)
    places = np.arange(len(text) + 1)
    codes = np.array([ord(c) for c in text], int)
    for c in pattern:
        moved = row + 1
        moved[1:] = np.minimum(moved[1:], row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(moved - places) + places
    return int(row.min())


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice(LETTERS)
        elif kind == 1:
            chars.insert(at, rng.choice(LETTERS))
        else:
            del chars[at]
    return "".join(chars)


def words(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def test_finds_exactly_what_alignment_with_everything_finds():
    rng = random.Random(2)
    items = [(i, words(rng, size)) for i, size in enumerate([9, 10, 11, 15, 20, 22, 23, 30, 31, 40, 90, 200, 400, 511, 1200, 2000])]
    patterns = dc.Items(items, segment=4000)
    texts = []
    for _ in range(160):
        item = rng.choice(items)[1]
        inner = edited(rng, item, rng.randrange(0, 2 + len(item) // 7))
        texts.append(rng.choice(["", words(rng, 300)]) + inner + rng.choice(["", words(rng, 100)]))
    allowed = {i: len(dc.normalized(t)) // 10 for i, t in items}
    for text, hits in zip(texts, patterns.search(texts)):
        shown = dc.normalized(text)
        want = {}
        for i, t in items:
            edits = nearest(dc.normalized(t), shown)
            if edits <= allowed[i]:
                want[i] = edits
        assert {i: h[0] for i, h in hits.items()} == want
        for i, (edits, start, end) in hits.items():
            assert 0 <= start <= end <= len(shown)
            assert nearest(dc.normalized(items[i][1]), shown[start:end]) == edits


def test_items_of_a_few_characters_are_whole_words():
    items = [(1, "42, yes!"), (2, "Paris"), (3, "paris"), (4, "a"), (5, "é è"), (6, "...")]
    texts = ["He said 42 -- YES.", "paris", "comparison parish", "A: É; è", "", "x" * 50 + " paris paris"]
    found = [{i: h for i, h in sorted(own.items())} for own in dc.Items(items).search(texts)]
    assert found == [
        {1: (0, 8, 14)}, {2: (0, 0, 5), 3: (0, 0, 5)}, {}, {4: (0, 0, 1), 5: (0, 2, 5)}, {}, {2: (0, 51, 56), 3: (0, 51, 56)}
    ]


def test_long_items_are_held_by_a_stretch_or_as_a_whole():
    rng = random.Random(6)
    item = words(rng, 1889)
    text = words(rng, 100) + item[450:1200] + words(rng, 100)
    assert list(dc.Items([(1, item)]).search([text])[0]) == [1]
    assert dc.Items([(1, item)], segment=2000).search([text, "so " + item]) == [{}, {1: (0, 3, 3 + len(dc.normalized(item)))}]


def test_whole_table(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}
    plain = {
        (d.doc_id, b.item_id)
        for d in docs.collect() for b in bench.collect()
        if dc.normalized(b.text) in dc.normalized(d.text)
    }
    assert plain and found >= plain
    assert found == {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench, block_bytes=2000).collect()}


def test_odd_rows(spark, make_docs):
    secret = "The quick brown fox jumps over the lazy dog near the old stone bridge"
    items = spark.createDataFrame(
        [(1, secret), (1, secret), (2, None), (3, ""), (4, "tiny"), (None, "Completely different words in here, friend")],
        "item_id bigint, text string",
    ).withColumn("edits", F.lit("x"))
    long = "x y " * 400_000 + secret.upper().replace(" ", "\n-- ") + " z" * 3_000
    texts = ["", None, "tiny", secret, secret, long, "say: completely different WORDS in here friend"]
    docs = make_docs(texts, [0, 1, 2, 3, 3, 5, None]).withColumn("start", F.lit(1))
    rows = dc.find_leaks(docs, items).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id or 0, r.edits) for r in rows)
    assert got == [(-1, 0, 0), (2, 4, 0)] + [(3, 1, 0)] * 4 + [(5, 1, 0)] * 2
    assert dc.find_leaks(make_docs([]), items).collect() == []
    assert dc.find_leaks(docs, items.limit(0)).collect() == []
