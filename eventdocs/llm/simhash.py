"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits share a variant that each reaches by flipping at most r/2 bits, and two
that share one differ in at most r. Every distinct fingerprint therefore emits its whole ball of radius r/2. The shuffle
goes by the leading bits of the variants: a fingerprint is sent once to each cell of leading bits that its ball
touches, and the cell's task spells out the variants that lie in it, sorts them and links the owners of equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventdocs.llm import jaccard
from eventdocs.llm.common import components, keep_only, parts, pieces, releasing, text_of, with_row_key, written

BITS, RADIUS, SEED = 64, 4, 42
#: Variants that a cell's task holds at a time.
MOST_VARIANTS = 4_000_000
_CHUNK = 1 << 16


def simhash(text: bytes, size: int, seed: int = SEED) -> int:
    """Bit i is set where more than half of the shingles' XXH64 have it set; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    spans = zip(starts, ends[size - 1 :]) if len(words) >= size else [(0, len(joined) + 1)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint32)
    return sum(1 << i for i in range(BITS) if 2 * int(ones[i]) > len(hashes))


def fingerprints(docs: DataFrame, key: str = "doc_id", size: int = 4) -> DataFrame:
    """(key, row_key, fp): the SimHash of every whole text as a BIGINT with the same 64 bits. A null text is an empty one."""
    schema = T.StructType(
        [docs.schema[key], T.StructField("row_key", T.LongType()), T.StructField("fp", T.LongType())]
    )

    @releasing
    def hash_all(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("simhash")
        for batch in pieces(rows, "text"):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            found = np.array([simhash(t, size) for t in texts], np.uint64).view(np.int64)
            own = [batch.column(key), batch.column("row_key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found)], names=schema.names)

    return with_row_key(docs, key).mapInArrow(hash_all, schema)


@lru_cache(maxsize=256)
def _masks(bits: int, flips: int) -> np.ndarray:
    """All words of ``bits`` low bits with at most ``flips`` ones."""
    return np.array(
        [sum(1 << i for i in c) for k in range(min(flips, bits) + 1) for c in combinations(range(bits), k)], np.uint64
    )


def _cell_links(cell: int, fps: np.ndarray, prefix: int, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smallest, other) that join the distinct ``fps`` whose variants meet in the cell.

    A cell with more than ``most`` variants is cut by its next bits, and so are its parts, until each has no more."""
    half = radius // 2
    label = np.arange(len(fps))

    def visit(bits: int, cell: int, own: np.ndarray, flipped: np.ndarray) -> None:
        low = BITS - bits
        groups = [(own[flipped == k], _masks(low, half - k)) for k in range(half + 1)]
        total = sum(len(some) * len(masks) for some, masks in groups)
        if total > most and low:
            step = min(low, 8, max(1, int(np.ceil(np.log2(total / most)))))
            upcoming = (fps[own] >> np.uint64(low - step)) & np.uint64((1 << step) - 1)
            for part in range(1 << step):
                now = flipped + np.bitwise_count(upcoming ^ np.uint64(part))
                here = now <= half
                if here.sum() > 1:
                    visit(bits + step, cell << step | part, own[here], now[here])
            return
        lead, rest = np.uint64(cell << low), np.uint64((1 << low) - 1)
        v = np.concatenate([(((fps[some] & rest) | lead)[:, None] ^ masks[None, :]).ravel() for some, masks in groups])
        o = np.concatenate([np.repeat(some.astype(np.int32), len(masks)) for some, masks in groups])
        order = np.argsort(v)
        v, o = v[order], o[order]
        met = np.flatnonzero(v[1:] == v[:-1])
        a, b = o[met], o[met + 1]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        _join(label, a[near], b[near])

    flipped = np.bitwise_count((fps >> np.uint64(BITS - prefix)) ^ np.uint64(cell)).astype(int)
    visit(prefix, cell, np.flatnonzero(flipped <= half), flipped[flipped <= half])
    other = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[other]], fps[other]


def links(fps: DataFrame, radius: int = RADIUS, prefix: int | None = None, most: int = MOST_VARIANTS) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``fps``. They connect exactly the pairs within ``radius`` bits.

    Within a cell, a group that meets is linked as a star, so a group of m gives m - 1 rows. A cell that has more
    variants than ``most`` is worked off in parts of its next bits, none of which has more. ``prefix`` leading bits make the cells; by default
    it follows the logarithm of the number of fingerprints, so that a cell keeps its size.
    """
    spark = fps.sparkSession
    if prefix is None:
        prefix = max(8, (fps.count() or 1).bit_length() - 12)
    touched = _masks(prefix, radius // 2).astype(np.int64).tolist()
    leading = F.shiftrightunsigned("fp", BITS - prefix)
    cells = fps.select(F.explode(F.transform(F.lit(touched), lambda m: m.bitwiseXOR(leading))).alias("cell"), "fp")
    placed = cells.repartition(max(parts(spark), 1), "cell").sortWithinPartitions("cell")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    @releasing
    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(cell: int, members: list[np.ndarray]) -> pa.RecordBatch:
            own = np.concatenate(members).view(np.uint64)
            a, b = _cell_links(cell, own, prefix, radius, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        current, members = None, []
        for batch in rows:
            cell, fp = batch.column("cell").to_numpy(), batch.column("fp").to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for c, own in zip(cell[np.concatenate([[0], cuts])] if len(cell) else [], np.split(fp, cuts)):
                if c != current and members:
                    yield one(int(current), members)
                    members = []
                current = c
                members.append(own)
        if members:
            yield one(int(current), members)

    return placed.mapInArrow(meet, schema).distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", size: int = 4, radius: int = RADIUS, prefix: int | None = None
) -> DataFrame:
    """(key, row_key, fp, component, component_id) of every row.

    ``component`` is the smallest fingerprint and component_id the smallest key that links of ``radius`` bits reach.

    Equal fingerprints are one node, so a group of copies costs one row in the search. Texts without words have
    fingerprint 0 and link like any other; a null text is an empty one. Repeated rows are kept and share a component. A
    null key takes part but names no component unless all keys of its component are null. An empty table gives an empty
    one; other columns are not read.
    """
    marked = written(fingerprints(docs, key, size), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, prefix)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").select("fp", F.col("root").alias("component"), "component_id")
    return marked.join(labels, "fp").select(key, "row_key", "fp", "component", "component_id")


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the groups of both ends of each pair. ``label`` holds the smallest index of every group, before and after."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # Roots, not ends, so that what was joined earlier stays joined.
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def near_copies(
    docs: DataFrame, key: str = "doc_id", size: int = 5, similarity: float = 0.8, radius: int | None = None
) -> DataFrame:
    """(key, row_key, component): texts whose sets of distinct shingles have a Jaccard similarity of ``similarity`` or more
    share a component, and so do those that such links reach. With ``radius``, texts that ``near_duplicates`` links, by
    fingerprints of four-word shingles, share one too; they are grouped first, and sets are compared across groups only.

    Links are found and verified exactly (see ``jaccard``), up to collisions of 64-bit hashes. Equal sets of shingles share
    one; texts without words are copies of each other, null texts are empty. Rows and nulls as in ``near_duplicates``.
    """
    groups = None
    if radius is not None:
        groups = written(near_duplicates(docs, key, radius=radius).select("row_key", "component"), "groups")
    marked, roots = jaccard.similar_sets(docs, key, size, similarity, groups)
    joined = marked.join(roots.withColumnRenamed("node", "id"), "id", "left")
    return joined.select(key, "row_key", F.coalesce("root", "id").alias("component"))


def first_of_each(
    docs: DataFrame, key: str = "doc_id", size: int = 5, similarity: float = 0.8, radius: int | None = None
) -> DataFrame:
    """One row of ``docs``, all columns unchanged, of each component (see ``near_copies``): that with the smallest key.
    Null keys come last; of repeated rows one stays."""
    found = near_copies(docs, key, size, similarity, radius)
    kept = found.groupBy("component").agg(F.min(F.struct(F.col(key).isNull().alias("no_key"), key, "row_key")).alias("m"))
    kept = kept.select(F.col("m.row_key").alias("row_key"), F.col(f"m.{key}").alias("kept_key"))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), text_of().alias("text"))
    rows = rows.select("row", "key", F.xxhash64("key", "text").alias("row_key"))
    staying = rows.join(kept, "row_key").where(F.col("key").eqNullSafe(F.col("kept_key")))
    once = Window.partitionBy("row_key").orderBy("key")
    return staying.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")
