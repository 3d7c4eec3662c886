import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from oracle_check import duck
from pyspark.sql import functions as F

from eventdocs.llm import prefix_trie, queries
from llm_help import SMALL

TABLE = "conv_id bigint, turn bigint, role string, text string, words int, pos string"


def sequences(rows):
    """The rebuilt conversations, by the definition; rows are (conv_id, turn, role, text) without equal turns."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    return out


def brute_force(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        kids = [below[k] for k in children[node]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below[node] = (sum(k[0] for k in kids) or 1, sum(k[1] for k in kids) + (len(members[node]) - 1) * words)
    rows = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(conversations[c]) == len(node))
        rows.append(
            (min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children[node]), *below[node],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def made_up(rng, convs):
    rows = []
    for c in range(-30, convs):
        if c % 7 == 3 or c == 40:
            continue
        pool = 2 if c % 3 else 1
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            text = " ".join(f"w{rng.randrange(pool)}" for _ in range(rng.randrange(3)))
            rows.append((c, turn if turn else rng.choice([None, 0]), rng.choice(["user", None]), text or None))
    return rows


@pytest.mark.parametrize("layer, shard", [(64, 1 << 17), (2, 1 << 17), (2, 7), (3, 1), (1, 20)])
def test_equals_brute_force(spark, layer, shard):
    rows = made_up(random.Random(layer), 60)
    assert any(not turns for turns in sequences(rows).values())
    table = spark.createDataFrame([(*r, None, None) for r in rows], TABLE).repartition(3)
    turns, convs = prefix_trie.rebuilt(prefix_trie.ordered_turns(table))
    found = prefix_trie.prefix_trie(turns, convs, layer=layer, shard_turns=shard, range_pieces=10)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_force(sequences(rows))


def test_query_equals_brute_force_and_sql(spark):
    found = queries.QUERIES["op12_prefix_trie"](spark, SMALL)
    assert found.dtypes[:-1] == [(c, "bigint") for c in
        ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    rows = sorted((tuple(r) for r in found.collect()), key=str)
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows == brute_force(sequences(given))
    names = ", ".join(found.columns)
    told = duck(SMALL).execute(f"SELECT {names} FROM ({queries.ORACLE['op12_prefix_trie']})").fetchall()
    assert sorted(told, key=str) == rows


def test_many_copies_and_one_long_conversation(spark):
    long = [(1000, i, "user", f"t{i % 9} x") for i in range(400)]
    same = [(c, i, "user", f"t{i} x") for c in range(2000, 2150) for i in range(3)]
    rows = long + [(1001, *r[1:]) for r in long[:300]] + same
    table = spark.createDataFrame([(*r, None, None) for r in rows], TABLE)
    turns = prefix_trie.ordered_turns(table)
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    found = prefix_trie.prefix_trie(turns, convs, layer=8, shard_turns=50)
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role, text))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_force(want)


def test_tied_turns_nulls_and_empty_tables(spark):
    rows = [(None, 1, "u", "lost"), (5, None, None, None), (5, None, None, None), (5, 2, "b", "x" * 100_000), (5, 2, "a", "y")]
    table = spark.createDataFrame([(*r, None, None) for r in rows], TABLE)
    turns = prefix_trie.ordered_turns(table).orderBy("pos").collect()
    assert [(r.conv_id, r.pos, r.words) for r in turns] == [(5, 0, 0), (5, 1, 0), (5, 2, 1), (5, 3, 1)]
    turns, convs = prefix_trie.rebuilt(prefix_trie.ordered_turns(table.limit(0)))
    assert prefix_trie.prefix_trie(turns, convs).collect() == []


def test_medians_come_first():
    assert list(prefix_trie.medians(7)) == [3, 1, 0, 2, 5, 4, 6] and list(prefix_trie.medians(0)) == []
