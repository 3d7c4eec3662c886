"""Helpers of the tests of this folder."""

import numpy as np

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def roots_by_brute_force(values, linked):
    """Smallest index that links reach, for every index; ``linked(i)`` gives the indices linked with i."""
    label = np.full(len(values), -1)
    for i in range(len(values)):
        if label[i] >= 0:
            continue
        label[i], todo = i, [i]
        while todo:
            for j in linked(todo.pop()):
                if label[j] < 0:
                    label[j] = i
                    todo.append(j)
    return label.tolist()


def exact_groups(texts):
    """Smallest index of each text's group, linked by a Jaccard similarity of 0.8 over five-word shingles."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    return roots_by_brute_force(
        sets, lambda i: [j for j, s in enumerate(sets) if 5 * len(sets[i] & s) >= 4 * len(sets[i] | s)]
    )


def colliding_texts(spark, key, make, count=30_000):
    """Two different texts whose row keys under ``key`` share their lowest 25 bits; ``make`` gives the i-th candidate."""
    from eventdocs.llm.common import with_row_key

    rows = spark.createDataFrame([(key, make(i)) for i in range(count)], "doc_id bigint, text string")
    seen = {}
    for r in with_row_key(rows, "doc_id").collect():
        other = seen.setdefault(r.row_key & (1 << 25) - 1, r.text)
        if other != r.text:
            return other, r.text
    raise AssertionError("no such pair")
