import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from eventdocs.llm import attention, lm_scoring, queries
from llm_help import SMALL

SIZE = 60


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def is_held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


def base_scores(rows):
    """(n_tokens, n_known, train_tokens, base_score) of every (doc_id, text), by the definition."""
    counts, ends = Counter(), 0
    for key, text in rows:
        if not is_held_out(key):
            counts.update(tokens(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    out = []
    for _, text in rows:
        own = [*(counts[w] for w in tokens(text)), ends]
        out.append((len(own), sum(c > 0 for c in own), n, sum(map(log, own))))
    return out


@pytest.fixture(scope="module")
def vocabulary():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, SIZE, (50, attention.WINDOW + 1)) ** 2 // SIZE
    counts = np.bincount(windows.ravel(), minlength=SIZE)
    return attention.vocabulary(counts, attention.pairs(windows, attention.ranked(counts), SIZE))


def test_shares_of_a_class_add_up(vocabulary):
    total = np.bincount(vocabulary.of_class, 10.0**vocabulary.share, attention.CLASSES)
    assert np.allclose(total[np.unique(vocabulary.of_class)], 1)
    many = np.arange(5000)[::-1] + 1
    pairs = np.random.default_rng(0).integers(0, 5, (attention.KNOWN, attention.ALONE))
    words = attention.vocabulary(many, pairs)
    assert len(np.unique(words.of_class)) > attention.ALONE + 10 and len(np.unique(words.of_class[:attention.ALONE])) == attention.ALONE
    assert np.allclose(np.bincount(words.of_class, 10.0**words.share)[np.unique(words.of_class)], 1)


def direct_logs(w, rows, targets):
    """Every place on its own, in double precision."""
    x = w["inputs"][rows].astype(float) + w["places"]
    out = np.zeros(targets.shape)
    for i in range(len(rows)):
        for t in range(rows.shape[1]):
            q = x[i, t] @ w["q"]
            a = np.exp([q @ (x[i, s] @ w["k"]) for s in range(t + 1)])
            o = sum(p * (x[i, s] @ w["v"]) for s, p in enumerate(a / a.sum()))
            z = np.concatenate([x[i, t], o, [1.0]]) @ w["out"]
            out[i, t] = z[targets[i, t]] - np.log(np.exp(z).sum())
    return out


def test_masked_attention_equals_place_by_place(vocabulary):
    rng = np.random.default_rng(5)
    w = attention.initial(vocabulary)
    rows = vocabulary.row[rng.integers(0, SIZE + 1, (3, attention.WINDOW))].astype(np.int64)
    targets = vocabulary.of_class[rng.integers(0, SIZE, rows.shape)].astype(np.int64)
    want = direct_logs(w, rows, targets)
    scorer = attention.Scorer(w, vocabulary)
    assert np.allclose(scorer.logs(rows, targets).reshape(rows.shape), want, atol=1e-4)
    last = targets[:, -attention.STRIDE :]
    assert np.allclose(scorer.logs(rows, last).reshape(last.shape), want[:, -attention.STRIDE :], atol=1e-4)
    assert abs(attention.gradients(w, rows, targets)[0] + want.mean()) < 1e-4


def test_gradients_equal_differences(vocabulary):
    rng = np.random.default_rng(2)
    w = {n: a.astype(np.float64) for n, a in attention.initial(vocabulary).items()}
    rows = vocabulary.row[rng.integers(0, SIZE + 1, (2, attention.WINDOW))].astype(np.int64)
    targets = vocabulary.of_class[rng.integers(0, SIZE, rows.shape)].astype(np.int64)
    targets[0, -7:] = -1
    _, found = attention.gradients(w, rows, targets)
    for name, at in (("q", (1, 2)), ("k", (3, 4)), ("v", (0, 5)), ("out", (4, targets[1, 3])), ("out", (20, 7)), ("places", (6, 1)),
                     ("inputs", (rows[1, 5], 3))):
        values = []
        for step in (1e-4, -1e-4):
            moved = {n: a.copy() for n, a in w.items()}
            moved[name][at] += step
            values.append(attention.gradients(moved, rows, targets)[0])
        assert abs((values[0] - values[1]) / 2e-4 - found[name][at]) < 1e-5


def test_training_lowers_the_loss_and_weights_travel(vocabulary):
    w = attention.initial(vocabulary)
    ids = np.tile(np.arange(attention.WINDOW + 1) % 7, (40, 1))
    rows, targets = vocabulary.row[ids[:, :-1]].astype(np.int64), vocabulary.of_class[ids[:, 1:]].astype(np.int64)
    before = attention.gradients(w, rows, targets)[0]
    trained = attention.train(w, rows, targets, 0, 60, 0.02)
    assert attention.gradients(trained, rows, targets)[0] < 0.3 * before
    back = attention.unpacked(np.frombuffer(attention.packed(trained)), w)
    assert all(np.array_equal(back[n], trained[n]) for n in w)


@pytest.fixture(scope="module")
def scored(spark):
    found = queries.QUERIES["op11_lm_scoring"](spark, SMALL)
    assert found.dtypes[:7] == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"),
                                ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    return found.collect()


def test_query_equals_brute_force_where_that_is_defined(spark, scored):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {k: v for (k, _), v in zip(given, base_scores(given))}
    assert len(scored) == len(given)
    for r in scored:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, is_held_out(r.doc_id))
        assert abs(r.base_score - base) < 1e-8 * n and -1e9 < r.score < 0 and r.attention_score < 0


def test_the_model_beats_the_unigrams_on_held_out_texts(spark):
    own = queries.QUERIES["op11_lm_scoring"](spark, SMALL.replace("0.001", "0.01")).where("held_out").collect()
    assert sum(r.attention_score for r in own) > 1.3 * sum(r.base_score for r in own)
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_scores_equal_words_put_together_one_by_one(spark, make_docs, monkeypatch):
    texts = ["One two three, " * 30 + "Zebra", "", None, "x" * 1500, "a b", "one TWO\tthree\n\n"]
    docs = make_docs(texts * 3)
    model = lm_scoring.fit(docs, rate=1)
    got = {r.doc_id: r for r in lm_scoring.scores(docs, model).collect()}
    encoder = lm_scoring.subwords(model.tokenizer)
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    counts = {bytes(r["word"]): r["c"] for r in model.counts.collect()}
    for (key, text), (n, known, _, base) in zip(rows, base_scores(rows)):
        lists = [encoder.of(w) for w in tokens(text)] + [[encoder.end]]
        ids = np.array([i for one in lists for i in one])
        inputs = np.concatenate([[encoder.size], ids[:-1]])
        logs = np.zeros(len(ids))
        for start in range(0, len(ids), attention.STRIDE):
            x = inputs[start : start + attention.WINDOW]
            pad = np.zeros((1, attention.WINDOW), np.int64)
            pad[0, : len(x)] = model.words.row[x]
            y = np.zeros((1, attention.WINDOW), np.int64)
            y[0, : len(x)] = model.words.of_class[ids[start : start + attention.WINDOW]]
            own = direct_logs(model.weights, pad, y)[0][: len(x)]
            skip = attention.WINDOW - attention.STRIDE if start else 0
            logs[start + skip : start + len(x)] = own[skip:]
        logs = logs / math.log(10) + model.words.share[ids]
        total, at = 0.0, 0
        for one, word in zip(lists, [*tokens(text), None]):
            a, at = logs[at : at + len(one)].sum(), at + len(one)
            b = float(model.base(float(model.texts if word is None else counts.get(word, 0))))
            total += max(a, b) + math.log10((1 + 10 ** (min(a, b) - max(a, b))) / 2)
        assert abs(got[key].attention_score - logs.sum()) < 1e-3 * (1 + len(ids))
        assert abs(got[key].score - total) < 1e-3 * (1 + len(ids)) and abs(got[key].base_score - base) < 1e-8 * n
        assert (got[key].n_tokens, got[key].n_known) == (n, known)


def test_very_long_texts_null_keys_and_repeated_rows(make_docs):
    long = "Alpha beta gamma delta " * 110_000
    texts = [long, "beta", "beta", "new"] + [f"alpha w{i}" for i in range(30)]
    own = next(k for k in range(100, 200) if not is_held_out(k))
    ids = [own, None, 7, 7, *range(10, 40)]
    docs = make_docs(texts, ids)
    found = lm_scoring.scores(docs, lm_scoring.fit(docs, rate=4)).collect()
    want = {(k, n): (known, total, base) for (k, _), (n, known, total, base) in zip(zip(ids, texts), base_scores(list(zip(ids, texts))))}
    assert len(found) == len(texts) and {r.doc_id for r in found} == set(ids)
    for r in found:
        if r.doc_id != 7:
            known, total, base = want[r.doc_id, r.n_tokens]
            assert (r.n_known, r.train_tokens) == (known, total) and abs(r.base_score - base) < 1e-6 * r.n_tokens
    per_token = {r.doc_id: r.attention_score / r.n_tokens for r in found}
    assert -1 < per_token[own] < 0


def test_empty_tables_and_texts_that_are_all_held_out(make_docs):
    empty = make_docs([])
    assert lm_scoring.scores(empty, lm_scoring.fit(empty)).collect() == []
    keys = [k for k in range(200) if is_held_out(k)][:3]
    docs = make_docs(["a b", "", None], keys)
    found = lm_scoring.scores(docs, lm_scoring.fit(docs)).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.base_score == 0 and r.held_out for r in found) and len(found) == 3


def test_the_query_learns_from_all_training_words(monkeypatch):
    rates = []
    monkeypatch.setattr(queries, "_table", lambda *_: None)
    monkeypatch.setattr(queries.lm_scoring, "scores", lambda docs, model: None)
    monkeypatch.setattr(queries.lm_scoring, "fit", lambda docs, rate=lm_scoring.RATE: rates.append(rate))
    queries.op11_lm_scoring(None, "")
    assert rates == [1]
    for windows in (1, 127, 5000, 32_768, 33_100, 60_000):
        assert lm_scoring.steps_of(windows) * len(lm_scoring.RATES) * 128 >= windows


def test_windows_are_dealt_out_once_and_rounds_do_not_shuffle_them(make_docs, monkeypatch):
    plans, packs = [], []
    own, pack = lm_scoring.added_up, lm_scoring._packed
    monkeypatch.setattr(lm_scoring, "added_up", lambda a, *k: plans.append(a._jdf.queryExecution().toString()) or own(a, *k))
    monkeypatch.setattr(lm_scoring, "SHARD_WINDOWS", 20)

    def both(sample, size):
        packed = pack(sample, size)
        packs.append((size, [bytes(r.ids) for r in sample.collect()], [bytes(r.windows) for r in packed.collect()]))
        return packed

    monkeypatch.setattr(lm_scoring, "_packed", both)
    lm_scoring.fit(make_docs([f"one two three w{i} " * 60 for i in range(12)]))
    assert len(plans) == len(lm_scoring.RATES) and not any("Exchange" in p for p in plans)
    size, given, values = packs[0]
    back = [w.astype("<i4").tobytes() for v in values for w in lm_scoring._unpacked(v, size)]
    assert len(packs) == 1 and len(values) > 1 and sorted(back) == sorted(given)
