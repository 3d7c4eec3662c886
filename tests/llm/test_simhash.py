import random

import numpy as np
import xxhash

from eventdocs.llm import jaccard, simhash
from llm_help import SMALL, exact_groups, roots_by_brute_force


def plain_simhash(text, size):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def expected(rows, size, radius):
    rows = sorted(rows)
    fps = np.array([plain_simhash(text, size) for _, text in rows], np.uint64)
    roots = roots_by_brute_force(fps, lambda i: np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius))
    return [(key, int(fp), rows[root][0]) for (key, _), fp, root in zip(rows, fps, roots)]


def found(df):
    return sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in df.collect())


def test_components_equal_brute_force_on_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == expected(rows, 4, 4)


def test_odd_texts(make_docs):
    texts = ["", None, " \t\n", "One", "one two", "a b c d e", "A B  C\tD e", "a b c d e", "ß É x\x0by z", "  a b"]
    docs = make_docs(texts, [9, 8, 7, 6, 5, 4, 3, 2, 1, 0])
    assert found(simhash.near_duplicates(docs)) == expected(list(zip([9, 8, 7, 6, 5, 4, 3, 2, 1, 0], texts)), 4, 4)


def test_long_text_equals_its_plain_fingerprint():
    words = [random.Random(1).choice(["red", "green", "Blue"]) + str(i % 977) for i in range(70_000)]
    text = " ".join(words)
    assert simhash.simhash(text.encode(), 4) == plain_simhash(text, 4)


def test_links_of_random_neighbours(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for fp in list(fps):
        for _ in range(rng.randrange(6)):
            near = fp
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                near ^= 1 << bit
            fps.add(near)
    fps = np.array(sorted(fps), np.uint64)
    want = roots_by_brute_force(fps, lambda i: np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4))
    signed = [int(x) for x in fps.view(np.int64)]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for most in (4_000_000, 2_000):
        pairs = [(r.a, r.b) for r in simhash.links(df, 4, 8, most).collect()]
        at = {x: i for i, x in enumerate(signed)}
        near = {i: set() for i in range(len(fps))}
        for a, b in pairs:
            near[at[a]].add(at[b])
            near[at[b]].add(at[a])
        assert roots_by_brute_force(fps, near.__getitem__) == want


def test_later_links_keep_earlier_ones():
    label = np.arange(3)
    simhash._join(label, np.array([2]), np.array([1]))
    simhash._join(label, np.array([2]), np.array([0]))
    assert label.tolist() == [0, 0, 0]


def test_chains_across_slices_and_rounds():
    # B and C meet in one slice only; a later slice joins C to A, which has a smaller index than B.
    a, c = 1 << 40, (1 << 40) ^ (1 << 63) ^ (0b11 << 54) ^ 1
    chain = [a, c ^ 0b1110, c]
    for most in (4_000_000, 50_000, 500):
        fps, near = np.array(chain, np.uint64), {i: {i} for i in range(3)}
        for cell in range(256):
            touching = fps[np.bitwise_count((fps >> np.uint64(56)) ^ np.uint64(cell)) <= 2]
            for x, y in zip(*simhash._cell_links(cell, touching, 8, 4, most)) if len(touching) else []:
                i, j = chain.index(int(x)), chain.index(int(y))
                near[i].add(j)
                near[j].add(i)
        assert roots_by_brute_force(fps, near.__getitem__) == [0, 0, 0]
    rng = np.random.default_rng(3)
    for _ in range(30):
        fps = np.unique(rng.integers(0, 1 << 18, 60).astype(np.uint64))
        want = roots_by_brute_force(fps, lambda i: np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4))
        at = {int(x): i for i, x in enumerate(fps)}
        for most in (1 << 22, 1 << 12):
            label = np.arange(len(fps))
            x, y = simhash._cell_links(0, fps, 46, 4, most)
            simhash._join(label, np.array([at[int(v)] for v in x], int), np.array([at[int(v)] for v in y], int))
            assert label.tolist() == want


def test_close_fingerprints_do_not_exceed_the_variants_of_a_step(monkeypatch):
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 1 << 24, 300).astype(np.uint64) | np.uint64(0xABCD << 48))
    want = roots_by_brute_force(fps, lambda i: np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4))
    sizes, sort = [], np.argsort
    monkeypatch.setattr(simhash.np, "argsort", lambda v: sizes.append(len(v)) or sort(v))
    x, y = simhash._cell_links(0xAB, fps, 8, 4, 20_000)
    assert max(sizes) <= 20_000
    at, label = {int(f): i for i, f in enumerate(fps)}, np.arange(len(fps))
    simhash._join(label, np.array([at[int(v)] for v in x], int), np.array([at[int(v)] for v in y], int))
    assert label.tolist() == want


def test_empty_table_and_null_keys(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []
    rows = simhash.near_duplicates(make_docs(["x y", "x y", "q"], [None, 3, None])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows if r.component_id) == [(False, 3), (True, 3)]
    assert len(rows) == 3


def changed(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def test_near_copies_are_found_and_others_are_not(make_docs):
    rng = random.Random(8)
    texts, similar = [], []
    for i in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        other = changed(rng, words, rng.choice([0.0, 0.005, 0.01, 0.02, 0.2]))
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (words, other))
        texts += [" ".join(words), " ".join(other)]
        similar.append(len(a & b) / len(a | b))
    rows = {r.doc_id: r.component for r in simhash.near_copies(make_docs(texts)).collect()}
    same = [rows[2 * i] == rows[2 * i + 1] for i in range(150)]
    assert sum(s for s, j in zip(same, similar) if j >= 0.82) >= 0.93 * sum(j >= 0.82 for j in similar)
    assert not any(s for s, j in zip(same, similar) if j < 0.6)
    firsts = [rows[2 * i] for i in range(150)]
    assert len(set(firsts)) == 150


def found_groups(docs):
    rows = sorted((r.doc_id, r.component) for r in simhash.near_copies(docs).collect())
    first = {}
    return [first.setdefault(c, i) for i, (_, c) in enumerate(rows)]


def test_near_copies_equal_exact_jaccard_on_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r.text for r in sorted(docs.collect())]
    assert found_groups(docs) == exact_groups(texts)


def test_shapes_bound_what_sets_share():
    rng = np.random.default_rng(4)
    for _ in range(300):
        common = rng.integers(0, 1 << 63, rng.integers(0, 900)).astype(np.uint64) * np.uint64(2)
        own = [rng.integers(0, 1 << 63, rng.integers(0, 300)).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in "ab"]
        a, b = (np.unique(np.concatenate([common, x])) for x in own)
        shapes = [np.frombuffer(jaccard._shape(x), np.uint8) for x in (a, b)]
        most = jaccard._most_common(*shapes)
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b)) and most == jaccard._most_common(*shapes[::-1])
    assert jaccard._shape(np.arange(300, dtype=np.uint64)) == b"" and jaccard._most_common(np.zeros(0), np.ones(4)) is None


def test_near_copies_around_the_threshold(make_docs, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"s{i}x{k}" for k in range(n)) for i in range(40) for n in (9, 8)]  # 5 shingles and 4 of them: 0.8
    passage = [f"p{k}" for k in range(60)]
    for i in range(60):
        own = [f"o{i}x{k}" for k in range(rng.choice([4, 8, 20, 60]))]
        words = own + passage
        texts.append(" ".join(words))
        texts.append(" ".join(changed(rng, words, rng.choice([0.01, 0.02, 0.04]))))
    want = exact_groups(texts)
    for frequent, known in ((1000, 1 << 20), (5, 1 << 20), (5, 20), (5, 0)):
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        monkeypatch.setattr(jaccard, "KNOWN", known)
        monkeypatch.setattr(jaccard, "SEEN", 1)
        assert found_groups(make_docs(texts)) == want
    assert 40 < len(set(want)) < len(texts) - 40


def test_fingerprints_link_what_shingles_do_not(make_docs):
    # Other ends of a text that repeats three words: fingerprints of four-word shingles are close, sets of five-word ones not.
    rng = random.Random(3)
    texts = ["k l m " * 40 + "one two three four five six seven", "k l m " * 40 + "eight nine ten"]
    texts += [" ".join(f"v{rng.randrange(900)}" for _ in range(80)) for _ in range(20)]
    texts.append(texts[5].replace(" ", "  "))
    fps = [plain_simhash(t, 4) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 4 and exact_groups(texts)[1] == 1
    docs = make_docs(texts)
    for radius, want in ((None, exact_groups(texts)), (simhash.RADIUS, [0, 0, *exact_groups(texts)[2:]])):
        rows = sorted((r.doc_id, r.component) for r in simhash.near_copies(docs, radius=radius).collect())
        first = {}
        assert [first.setdefault(c, i) for i, (_, c) in enumerate(rows)] == want


def test_the_pipeline_links_by_fingerprints_and_by_shingles(spark, make_docs, monkeypatch):
    import corpus_pipeline

    used = []
    own = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: used.append(k.get("radius")) or own(*a, **k))
    rows = corpus_pipeline.near_duplicate_stage(spark, make_docs(["a b c d e f", "A b c d e f", "q r s t u v"]), SMALL)
    assert {r.doc_id for r in rows.collect()} == {0, 2} and used == [simhash.RADIUS]
