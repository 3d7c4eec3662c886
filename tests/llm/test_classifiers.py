import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventdocs.llm import labelled, quality, toxicity
from llm_help import SMALL

WORDS = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ran", "sto", "ti", "vo", "zen", "pal", "qur")]
BAD = ["vexor", "gruntle", "skarn"]


def made(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 80))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD).title() + rng.choice(["", "!", ","]))
        rows.append((int(i % 4 == 0), " ".join(words), ("en", "de", None)[i % 3]))
    return rows


@pytest.fixture(scope="module")
def net():
    return toxicity.fit(made(600))


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    own = np.array(labels) == 1
    return (rank[own].mean() - (own.sum() - 1) / 2) / (~own).sum()


def test_network_finds_telling_words_in_new_texts(net):
    rows = made(300, seed=7)
    scores = net.score([r[1].encode() for r in rows])
    assert auc(scores, [r[0] for r in rows]) > 0.99
    assert np.mean((scores >= 0.5) == np.array([r[0] == 1 for r in rows])) > 0.95


def test_pooling_equals_a_plain_loop(net):
    texts = ["", "ba", "Vexor", " ".join(WORDS), "x " * 50 + "skarn!"]
    table = toxicity.hashed_words(len(net.words))
    for text, got in zip(texts, net.pooled([table.of(t.encode().split()) for t in texts])):
        ids = [table[w] for w in text.encode().split()] or [0]
        ids = ids + [0] * 2
        want = []
        for w, kernel, bias in zip(toxicity.WIDTHS, net.kernels, net.biases):
            values = [
                sum(net.words[ids[i + k]] @ kernel[k] for k in range(w)) + bias for i in range(len(ids) - 2)
            ]
            want.append(np.maximum(np.max(values, 0), 0))
        assert np.allclose(got, np.concatenate(want), atol=1e-4)


def test_scores_of_odd_rows(spark, make_docs, net):
    docs = make_docs(["", None, "ba do", "ba do", "skarn " * 9], [1, 2, 3, 3, None]).withColumn("score", F.lit("x"))
    rows = toxicity.scores(docs, net).collect()
    found = sorted((r.doc_id or 0, round(r.score, 5)) for r in rows)
    assert len(found) == 5 and found[1][1] == found[2][1] and found[3] == found[4]
    assert all(0 <= s <= 1 for _, s in found) and found[0][1] > 0.5
    assert toxicity.scores(make_docs([]), net).collect() == []


def test_thresholds_by_language(spark, net):
    net.thresholds = {"de": 0.2}
    df = spark.createDataFrame([(0.3, "de"), (0.3, "en"), (0.99, None)], "s double, lang string")
    rows = df.select(toxicity.rejected(net, F.col("s"), F.col("lang"))).collect()
    assert [r[0] for r in rows] == [True, 0.3 >= net.common, True]


def test_one_label_or_none_gives_a_constant():
    assert set(toxicity.fit([(0, "a b", "en")] * 3).score([b"a", b""])) == {0.125}
    assert 0 < toxicity.fit([]).score([b"a"])[0] < 0.1


def test_sample_is_bounded_and_leaves_the_fold_out(spark, make_docs):
    docs = make_docs([f"t{i}" for i in range(300)] + [None, "long " * 30], [*range(300), 300, None])
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(301), 5]], "doc_id bigint, toxic int")
    rows = labelled.sample(docs, labels, F.col("toxic"), rows=20, words=10)
    assert [r[0] for r in rows] == [0] * 20 + [1] * 20
    assert all(zlib.crc32(r[1][1:].encode()) % 3 != 1 for r in rows)
    assert labelled.sample(make_docs([]), labels, F.col("toxic")) == []


def test_grades_are_ordered_and_learned():
    rng = random.Random(3)
    def text(grade):
        kind = [["junk!!", "123", "&&&"], ["plain", "words", "here"], ["careful", "reasoned", "prose"]][grade]
        return " ".join(rng.choice(kind * 8 + WORDS) for _ in range(40))
    model = quality.fit([(g, text(g)) for g in (0, 1, 2) for _ in range(150)])
    assert (np.diff(model.thresholds) >= 0).all()
    fresh = [(g, text(g)) for g in (0, 1, 2) for _ in range(50)]
    tails = model.tails([t.encode() for _, t in fresh])
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.mean(np.abs(tails.sum(1) - [g for g, _ in fresh])) < 0.3


def test_quality_on_tables(spark, make_docs):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit_on_tables(docs, labels)
    rows = quality.grades(docs, model).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    good = {r.doc_id: r.quality for r in labels.collect()}
    grade = {q: np.mean([r.expected_grade for r in rows if good.get(r.doc_id) == q]) for q in (0, 1)}
    assert grade[0] < grade[1] and all(0 <= r.tail_probability <= 1 for r in rows)
    odd = make_docs(["", None, "a"], [1, 1, None]).withColumn("grade", F.lit(5))
    assert len(quality.grades(odd, model).collect()) == 3
    assert quality.grades(make_docs([]), model).collect() == []
