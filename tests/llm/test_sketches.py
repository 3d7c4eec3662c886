import hashlib

from pyspark.sql import functions as F

from eventdocs.llm import sketches
from llm_help import SMALL


def shingles(text, size=5):
    words = [w for w in text.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        out[key] = (len(text), edited, jaccard(text, edited), jaccard(text, after))
    return out


def compare(df, rows, tolerance):
    want = expected(rows)
    got = df.withColumns(
        {
            "near_edited": sketches.resemblance(F.col("fingerprint"), F.col("edited_fingerprint")),
            "near_next": sketches.resemblance(F.col("fingerprint"), F.col("next_fingerprint")),
        }
    ).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        n, edited, near_edited, near_next = want[r.doc_id]
        assert (r.n_chars, r.edited) == (n, edited)
        assert abs(r.near_edited - near_edited) <= tolerance and abs(r.near_next - near_next) <= tolerance


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    compare(sketches.with_edits(docs), [(r.doc_id, r.text) for r in docs.collect()], 0.15)


def test_sparse_keys_and_odd_texts(make_docs):
    texts = ["", None, " \n", "a", "a b c d e f", "é😀" * 9, "a b c d e f", "x y z\x0bw\x0c q r s t", "aaa", "one two three"]
    keys = [-(2**62), 5, 1 << 40, 1 << 41, 3, 4, 1 << 20, (1 << 20) + 1, 2**62, 0]
    compare(sketches.with_edits(make_docs(texts, keys)), list(zip(keys, texts)), 1e-9)


def test_empty_table_null_and_repeated_keys(make_docs):
    assert sketches.with_edits(make_docs([])).collect() == []
    rows = sketches.with_edits(make_docs(["abc", "abc", "xyzxyz"], [1, 1, None])).collect()
    assert sorted((r.doc_id is None, r.edited) for r in rows) == [(False, "aba"), (False, "abx"), (True, "xyzxab")]
    alone = sketches.with_edits(make_docs(["abcdef"])).first()
    assert alone.edited == "abcdab"


def test_sketches_merge_in_any_order_and_estimate(spark):
    words = [f"w{i * i % 9973}" for i in range(6000)]
    parts = [(g, " ".join(words[a : a + 2000])) for g, a in ((0, 0), (0, 1500), (0, 4000), (1, 1000))]
    df = spark.createDataFrame(parts, "g int, text string").withColumn("s", sketches.sketch(F.col("text")))
    merged = {r.g: r.s for r in sketches.merge_sketches(df, ["g"], "s").collect()}
    sets = {g: set().union(*(shingles(t) for h, t in parts if h == g)) for g in (0, 1)}
    both = spark.createDataFrame([(merged[0], merged[1])], "a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    r = both.select(
        sketches.resemblance(a, b), sketches.containment(b, a), sketches.distinct_count(a),
        sketches.merged(a, b) == sketches.merged(b, a),
    ).first()
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(r[0] - true) < 0.12 and abs(r[1] - len(sets[0] & sets[1]) / len(sets[1])) < 0.3
    assert abs(r[2] / len(sets[0]) - 1) < 0.25 and r[3]


def test_digest_of_edited_text(spark, make_docs):
    row = sketches.with_edits(make_docs(["äöü", "ß"])).select(F.sha2(F.encode("edited", "UTF-8"), 256).alias("h"), "doc_id")
    assert {r.doc_id: r.h for r in row.collect()}[0] == hashlib.sha256("äöß".encode()).hexdigest()
