"""Conversation prefix trie: which conversations share their first turns, and what storing these once would save.

1. Turns become ids of a dictionary, and a conversation becomes a sequence of ids.
2. Sequences are cut into layers of LAYER turns. A layer's piece stands under the prefix before it, so no value grows with
   the length of a conversation. Equal pieces are one row with a weight.
3. Pieces are sorted and range partitioned; a task takes a shard of neighbouring pieces at a time and puts them into
   ternary search trees, one for each prefix, median first. An iterative traversal adds up members, leaves and savings.
4. Only nodes on the path of a shard's first or last piece may go on in a neighbouring shard. They are merged by their
   identity and handed up; all others are complete.
5. What lies in deeper layers is summed up along the conversations and handed to the nodes of the layer above.

A node's identity is 128 bits: the exclusive or of hashes of (turn id, position) over its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventdocs.llm.common import drop_written, parts, text_of, written
from eventdocs.operators.ordinal import tied_ordinal

#: Turns of a layer; turns that a task puts into trees at a time; pieces of a range partition.
LAYER, SHARD_TURNS, RANGE_PIECES = 64, 1 << 17, 1 << 17
#: Layers, and conversation ids, that are summed up or listed together.
_BLOCK_BITS, _ID_BITS = 12, 16
_WORDS = r"[^\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, pos, k1, k2, words): turns numbered from 0 in each conversation, by ``turn``, null first.

    k1 and k2 are a 128-bit digest of (role, text); nulls are empty. Turns of the same number follow that digest. Rows
    without a conversation are left out. One conversation may hold any share of the rows.
    """
    role, text = text_of("role"), text_of("text")
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.xxhash64(role, text).alias("k1"),
        F.xxhash64(text, role, F.lit(1)).alias("k2"),
        F.regexp_count(text, F.lit(_WORDS)).cast("bigint").alias("words"),
    )
    return tied_ordinal(rows, ["conv_id"], "turn", "pos", tie="k1").drop("turn")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation c has its first h turns replaced by those of c - c % ``every``.

    h is crc32 of c in decimal, modulo ``heads``; c % ``every`` has the sign of c. Where the other one has fewer turns or none, there are fewer or none.
    Conversations: (conv_id, n_turns), turnless ones included. Both are tables in the shared folder.
    """
    turns = written(turns, "own-turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = own.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    own = written(own, "conversations")
    bases = own.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("base_n"))
    convs = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint"))))
    convs = convs.select(
        "conv_id", "h", "base", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")
    )
    convs = written(convs, "heads")
    columns = ["conv_id", "pos", "k1", "k2", "words"]
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    first = convs.where("taken > 0").join(first, "base").where("pos < taken").select(columns)
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).select(columns)
    result = written(first.unionByName(rest), "turns")
    drop_written(turns)
    drop_written(own)
    return result, convs.select("conv_id", "n_turns")


def _earlier(value: str, how, key: str = "conv_id") -> Column:
    before = Window.partitionBy(key, "_block").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(how(value).over(before), F.lit(0).cast("bigint"))


def _running(rows: DataFrame, values: Sequence[str], how, join) -> DataFrame:
    """(conv_id, layer, *values): of each conversation's earlier layers, in blocks, so that no task sees all of a long one.
    ``how`` aggregates and ``join`` puts two results together."""
    rows = rows.select("conv_id", "layer", *values, F.shiftright("layer", _BLOCK_BITS).alias("_block"))
    blocks = rows.groupBy("conv_id", "_block").agg(*[how(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("bigint")
    blocks = blocks.select(
        "conv_id", "_block", *[F.coalesce(how(f"_{v}").over(before), nothing).alias(f"_{v}") for v in values]
    )
    inside = rows.select("conv_id", "layer", "_block", *[_earlier(v, how).alias(v) for v in values])
    joined = inside.join(blocks, ["conv_id", "_block"])
    return joined.select("conv_id", "layer", *[join(F.col(v), F.col(f"_{v}")).alias(v) for v in values])


def _pieces(turns: DataFrame, convs: DataFrame, layer: int) -> DataFrame:
    """(conv_id, layer, r1, r2, x1, x2, turns, goes_on): layer by layer, r the prefix before it and x its own digest.
    ``turns`` has (id, words, h1, h2) in order; a turnless conversation has one empty piece."""
    dictionary = turns.groupBy("k1", "k2").agg(F.first("words").alias("words"))
    dictionary = written(dictionary.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    encoded = turns.drop("words").join(dictionary, ["k1", "k2"])
    one = F.struct(
        "pos", "id", "words", F.xxhash64("id", "pos").alias("h1"), F.xxhash64("pos", "id", F.lit(1)).alias("h2")
    )
    encoded = encoded.select("conv_id", F.call_function("div", "pos", F.lit(layer)).alias("layer"), one.alias("t"))
    own = encoded.groupBy("conv_id", "layer").agg(
        F.array_sort(F.collect_list("t")).alias("turns"), F.bit_xor("t.h1").alias("x1"), F.bit_xor("t.h2").alias("x2")
    )
    own = written(own, "layers")
    long = own.select("conv_id", "layer", "x1", "x2").join(convs.where(F.col("n_turns") > layer), "conv_id", "left_semi")
    prefix = _running(long, ["x1", "x2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    prefix = written(prefix.select("conv_id", "layer", F.col("x1").alias("r1"), F.col("x2").alias("r2")), "prefixes")
    nothing = F.lit(0).cast("bigint")
    pieces = own.join(prefix, ["conv_id", "layer"], "left").join(convs, "conv_id").select(
        "conv_id",
        "layer",
        F.coalesce("r1", nothing).alias("r1"),
        F.coalesce("r2", nothing).alias("r2"),
        "x1",
        "x2",
        F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"), t["h1"].alias("h1"), t["h2"].alias("h2"))).alias("turns"),
        ((F.col("layer") + 1) * layer < F.col("n_turns")).alias("goes_on"),
    )
    none = F.filter(F.array(F.struct(*[nothing.alias(c) for c in ("id", "words", "h1", "h2")])), lambda t: F.lit(False))
    empty = convs.where("n_turns = 0").select(
        "conv_id", *[nothing.alias(c) for c in ("layer", "r1", "r2", "x1", "x2")], none.alias("turns"), F.lit(False).alias("goes_on")
    )
    return written(pieces.unionByName(empty), "pieces")


_NODES = (
    "kind string, d1 bigint, d2 bigint, p1 bigint, p2 bigint, under_root boolean, depth bigint, conv_id bigint, "
    "n_convs bigint, words bigint, n_children bigint, n_leaves bigint, saved bigint, goes_on boolean, "
    "parent_conv_id bigint, path array<struct<d1: bigint, d2: bigint, root: boolean>>"
)


class Tree:
    """A ternary search tree of sequences. Node 0 is the prefix that all of them share; ``down`` of a node is the top of
    its children, which are a binary search tree by ``low`` and ``high``."""

    def __init__(self, d1: int, d2: int):
        self.symbol, self.low, self.down, self.high, self.up = [0], [-1], [-1], [-1], [-1]
        self.n, self.conv, self.words, self.goes_on = [0], [None], [0], [False]
        self.d1, self.d2, self.depth = [d1], [d2], [0]

    def _new(self, turn: dict, up: int) -> int:
        for column, value in (
            (self.symbol, turn["id"]), (self.low, -1), (self.down, -1), (self.high, -1), (self.up, up), (self.n, 0),
            (self.conv, None), (self.words, turn["words"]), (self.goes_on, False), (self.d1, self.d1[up] ^ turn["h1"]),
            (self.d2, self.d2[up] ^ turn["h2"]), (self.depth, self.depth[up] + 1),
        ):
            column.append(value)
        return len(self.symbol) - 1

    def _child(self, node: int, turn: dict) -> int:
        at, symbol = self.down[node], turn["id"]
        if at < 0:
            self.down[node] = at = self._new(turn, node)
            return at
        while symbol != self.symbol[at]:
            side = self.low if symbol < self.symbol[at] else self.high
            if side[at] < 0:
                side[at] = self._new(turn, node)
                return side[at]
            at = side[at]
        return at

    def insert(self, turns: list[dict], weight: int, conv: int, goes_on: bool) -> list[int]:
        """Adds a sequence and returns its nodes."""
        path = [0]
        for turn in turns:
            path.append(self._child(path[-1], turn))
        for node in path:
            self.n[node] += weight
            known = self.conv[node]
            self.conv[node] = conv if known is None or conv < known else known
        self.goes_on[path[-1]] |= goes_on
        return path

    def totals(self, edge: set[int]) -> tuple[list[int], list[int], list[int]]:
        """Children, leaves and savings of every node's subtree. Nodes of ``edge`` keep to themselves, so that those above
        them only have what is complete. Children come after their parents, so one pass from the last node suffices."""
        size = len(self.symbol)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for node in range(size - 1, 0, -1):
            if node in edge:
                continue
            if not children[node] and not self.goes_on[node]:
                leaves[node] = 1
            saved[node] += (self.n[node] - 1) * self.words[node]
            up = self.up[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
        return children, leaves, saved


def medians(count: int) -> Iterator[int]:
    """All numbers below ``count``: the middle one, then those of both halves, and so on."""
    todo = [(0, count)]
    while todo:
        first, end = todo.pop()
        if first < end:
            middle = (first + end) // 2
            yield middle
            todo += [(middle + 1, end), (first, middle)]


def _shard_nodes(rows: list[dict], layer: int) -> Iterator[tuple]:
    """The nodes of neighbouring pieces, as in _NODES."""
    starts = [0, *(i for i in range(1, len(rows)) if any(rows[i][c] != rows[i - 1][c] for c in ("layer", "r1", "r2"))), len(rows)]
    for first, end in zip(starts, starts[1:]):
        own = rows[first:end]
        tree, edge = Tree(own[0]["r1"], own[0]["r2"]), set()
        number = own[0]["layer"]
        for i in medians(len(own)):
            row = own[i]
            path = tree.insert(row["turns"], row["n"], row["conv_id"], row["goes_on"])
            if (first == 0 and i == 0) or (end == len(rows) and i == len(own) - 1):
                edge.update(path)
        if number == 0:
            edge.add(0)
        children, leaves, saved = tree.totals(edge)
        for node in range(len(tree.symbol)):
            up = tree.up[node]
            kind = ("edge" if node in edge else "inner") if node else ("edge root" if 0 in edge else "root")
            path = []
            if kind == "edge":
                above = up
                while above >= 0:
                    path.append({"d1": tree.d1[above], "d2": tree.d2[above], "root": above == 0})
                    above = tree.up[above]
            yield (
                kind, tree.d1[node], tree.d2[node], tree.d1[up] if node else None, tree.d2[up] if node else None, up == 0,
                number * layer + tree.depth[node], tree.conv[node], tree.n[node], tree.words[node], children[node],
                leaves[node], saved[node], tree.goes_on[node], tree.conv[up] if up > 0 and up not in edge else None, path,
            )


def _shards(pieces: DataFrame, layer: int, shard_turns: int, range_pieces: int) -> DataFrame:
    distinct = pieces.groupBy("layer", "r1", "r2", "turns").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max("goes_on").alias("goes_on")
    )
    distinct = written(distinct, "distinct-pieces")
    ranges = max(parts(pieces.sparkSession), -(-distinct.count() // range_pieces))
    order = ["layer", "r1", "r2", "ids"]
    sorted_ = distinct.withColumn("ids", F.col("turns.id")).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    arrow = pa.schema(
        [("kind", pa.string())]
        + [(c, pa.int64()) for c in ("d1", "d2", "p1", "p2")]
        + [("under_root", pa.bool_())]
        + [(c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "words", "n_children", "n_leaves", "saved")]
        + [("goes_on", pa.bool_()), ("parent_conv_id", pa.int64())]
        + [("path", pa.list_(pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("root", pa.bool_())])))]
    )

    def batches_of(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(found)
        for at in range(0, len(rows), 1 << 14):
            columns = zip(*rows[at : at + (1 << 14)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                for row in whole.slice(at, 512).to_pylist():
                    held.append(row)
                    size += 1 + len(row["turns"])
                    if size >= shard_turns:
                        yield from batches_of(_shard_nodes(held, layer))
                        held, size = [], 0
        if held:
            yield from batches_of(_shard_nodes(held, layer))

    found = written(sorted_.drop("ids").mapInArrow(build, _NODES), "shard-nodes")
    found.pieces = distinct
    return found


def _merged(edges: DataFrame) -> DataFrame:
    """The nodes that several shards have: (d1, d2, root, ...), subtree totals within their layer."""
    key = ["d1", "d2", "root"]
    once = edges.withColumn("root", F.col("kind") == "edge root").groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("depth", "p1", "p2", "under_root", "words", "path")],
        F.min("conv_id").alias("conv_id"),
        F.max("goes_on").alias("goes_on"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    once = written(once, "edges")
    children = once.where("NOT root").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"), F.col("under_root").alias("root"))
    once_more = once.join(children.agg(F.count(F.lit(1)).alias("more")), key, "left")
    nothing = F.lit(0).cast("bigint")
    whole = once_more.withColumn("n_children", F.col("n_children") + F.coalesce("more", nothing)).drop("more")
    alone = (F.col("n_children") == 0) & ~F.col("goes_on")
    whole = whole.withColumn("n_leaves", F.col("n_leaves") + alone.cast("bigint"))
    counted = F.when(F.col("root"), 0).otherwise((F.col("n_convs") - 1) * F.col("words"))
    whole = written(whole.withColumn("saved", F.col("saved") + counted), "edges-with-children")
    # What a node has goes to itself and to the at most LAYER nodes above it.
    above = whole.where("NOT root").select(F.explode("path").alias("a"), "n_leaves", "saved")
    given = above.select("a.d1", "a.d2", "a.root", "n_leaves", "saved").unionByName(whole.select(*key, "n_leaves", "saved"))
    totals = given.groupBy(*key).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    result = written(whole.drop("n_leaves", "saved", "path").join(totals, key), "merged-edges")
    drop_written(once)
    drop_written(whole)
    return result


def _deeper(pieces: DataFrame, distinct: DataFrame, roots: DataFrame, layer: int) -> DataFrame:
    """(d1, d2, more_children, more_leaves, more_saved): what nodes get from the layers below theirs."""
    places = pieces.where("layer > 0").select("conv_id", "layer", F.col("r1").alias("d1"), F.col("r2").alias("d2"))
    # Each prefix is charged to its smallest conversation; a prefix has the charges of all its conversations from it on.
    first = places.groupBy("d1", "d2").agg(F.min("conv_id").alias("conv_id"), F.first("layer").alias("layer"))
    charges = roots.join(first, ["d1", "d2"]).select("conv_id", "layer", "n_leaves", "saved")
    nothing = F.lit(0).cast("bigint")
    charged = places.join(charges, ["conv_id", "layer"], "left").withColumns(
        {c: F.coalesce(c, nothing) for c in ("n_leaves", "saved")}
    )
    charged = written(charged, "charges")
    before = _running(charged, ["n_leaves", "saved"], F.sum, lambda a, b: a + b)
    before = before.withColumnsRenamed({"n_leaves": "leaves_before", "saved": "saved_before"})
    whole = charged.groupBy("conv_id").agg(F.sum("n_leaves").alias("all_leaves"), F.sum("saved").alias("all_saved"))
    below = charged.select("conv_id", "layer", "d1", "d2").join(before, ["conv_id", "layer"]).join(whole, "conv_id")
    below = below.groupBy("d1", "d2").agg(
        F.sum(F.col("all_leaves") - F.col("leaves_before")).alias("leaves"),
        F.sum(F.col("all_saved") - F.col("saved_before")).alias("saved"),
    )

    def digests(of: str, start: str) -> Column:
        listed = F.transform(F.col("turns"), lambda t: t[of])
        return F.transform(
            F.sequence(F.lit(1), F.lit(layer)),
            lambda i: F.aggregate(F.slice(listed, 1, i), F.col(start), lambda a, x: a.bitwiseXOR(x)),
        )

    paths = distinct.where("goes_on").select("layer", digests("h1", "r1").alias("path1"), digests("h2", "r2").alias("path2"))
    paths = paths.withColumns({"d1": F.element_at("path1", -1), "d2": F.element_at("path2", -1)}).join(below, ["d1", "d2"])
    top = F.when(F.col("layer") == 0, F.array(nothing)).otherwise(F.array().cast("array<bigint>"))
    each = F.explode(F.arrays_zip(F.concat("path1", top).alias("a"), F.concat("path2", top).alias("b")))
    handed = paths.select(each.alias("z"), "leaves", "saved").select(
        F.col("z.a").alias("d1"), F.col("z.b").alias("d2"), nothing.alias("children"), "leaves", "saved"
    )
    own = roots.select("d1", "d2", F.col("n_children").alias("children"), nothing.alias("leaves"), nothing.alias("saved"))
    more = handed.unionByName(own).groupBy("d1", "d2")
    return more.agg(*[F.sum(c).alias(f"more_{c}") for c in ("children", "leaves", "saved")])


def _ends(pieces: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256): the conversations that end at a node. One task reads a node's list, as the hash goes from
    its start to its end, but holds a part of it only."""
    last = pieces.groupBy("conv_id").agg(F.bit_xor("x1").alias("d1"), F.bit_xor("x2").alias("d2"))
    listed = last.groupBy("d1", "d2", F.shiftright("conv_id", _ID_BITS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    count = parts(pieces.sparkSession)
    dealt = listed.repartition(count, "d1", "d2").sortWithinPartitions("d1", "d2", "block")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def flushed() -> pa.RecordBatch:
            rows = list(zip(*out)) or [[], [], []]
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["d1", "d2", "ends_sha256"])

        for batch in batches:
            for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids"))):
                if (d1, d2) == now:
                    state.update(b",")
                else:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (d1, d2), hashlib.sha256()
                state.update(ids.encode())
            yield flushed()
        if now:
            out.append((*now, state.hexdigest()))
        yield flushed()

    return dealt.mapInArrow(hashed, "d1 bigint, d2 bigint, ends_sha256 string")


def prefix_trie(
    turns: DataFrame,
    convs: DataFrame,
    layer: int = LAYER,
    shard_turns: int = SHARD_TURNS,
    range_pieces: int = RANGE_PIECES,
) -> DataFrame:
    """A row per distinct sequence of first turns: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), conv_id and parent_conv_id the smallest member of the node and of its parent.

    ``turns`` is (conv_id, pos, k1, k2, words) as from ``ordered_turns``, pos without gaps from 0; ``convs`` is (conv_id,
    n_turns) with each conversation once. Conversations without turns are members of the root only; without conversations
    there is no root and no row. Empty and very long texts are turns like any other, repeated turns too; copies of a
    conversation are members of the same nodes. Other columns are not read.
    """
    pieces = _pieces(turns, convs, layer)
    found = _shards(pieces, layer, shard_turns, range_pieces)
    edges = _merged(found.where("kind IN ('edge', 'edge root')"))
    inner = found.where("kind = 'inner'")
    totals = ["d1", "d2", "n_children", "n_leaves", "saved"]
    roots = found.where("kind = 'root'").select(*totals).unionByName(edges.where("root AND depth > 0").select(*totals))
    columns = ["d1", "d2", "depth", "parent_conv_id", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    # A prefix also has those members that end with it, which are not in the layer below it.
    full = pieces.where(F.size("turns") == layer).groupBy(
        F.col("r1").bitwiseXOR(F.col("x1")).alias("d1"), F.col("r2").bitwiseXOR(F.col("x2")).alias("d2")
    )
    prefixes = full.agg(F.min("conv_id").alias("conv_id")).withColumn("root", F.lit(True))
    parents = edges.where("NOT root OR depth = 0").select("d1", "d2", "conv_id", "root").unionByName(prefixes).select(
        F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("root").alias("under_root"), F.col("conv_id").alias("parent")
    )
    waiting = inner.where("parent_conv_id IS NULL").drop("parent_conv_id", "path", "kind", "words", "goes_on")
    waiting = waiting.unionByName(edges.where("NOT root").select(waiting.columns)).join(parents, ["p1", "p2", "under_root"])
    nodes = inner.where("parent_conv_id IS NOT NULL").select(*columns)
    nodes = nodes.unionByName(waiting.withColumnRenamed("parent", "parent_conv_id").select(*columns))
    top = edges.where("root AND depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    nodes = nodes.unionByName(top.select(*columns))
    joined = nodes.join(_deeper(pieces, found.pieces, roots, layer), ["d1", "d2"], "left").join(_ends(pieces), ["d1", "d2"], "left")
    nothing = F.lit(0).cast("bigint")
    return joined.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        (F.col("n_children") + F.coalesce("more_children", nothing)).alias("n_children"),
        (F.col("n_leaves") + F.coalesce("more_leaves", nothing)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", nothing)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
