"""Pairs of texts with a Jaccard similarity of a threshold or more, found and verified exactly by prefix filtering.

All sets of shingles are put in one order. Two sets of similarity s overlap in at least s times the size of either, so
both hold one of the other's first n - ceil(s n) + 1 shingles among their own first ones. Only these prefixes are shuffled;
what meets in one is counted, bounded, and verified on the whole sets. The order is that of the shingles' hashes, with
frequent shingles last, so that passages of many documents seldom lie in a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventdocs.llm.common import components, drop_written, keep_only, pieces, releasing, utf8_views, with_row_key, written

#: Rows that hold a frequent shingle, frequent shingles that the order knows of at most, and the share of the rows, one of
#: SEEN, in which they are looked for. None of them changes the result.
FREQUENT, KNOWN, SEEN = 300, 1 << 20, 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; a shorter text is one shingle, none without words."""
    words = text.lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    places = max(1, len(words) - size + 1) if words else 0
    found = np.zeros(places, np.uint64)
    for k in range(min(size, len(words))):
        found = (found ^ hashes[k : k + places]) * _MIX
        found ^= found >> np.uint64(29)
    return np.unique(found)


def _prefix(tokens: np.ndarray, frequent: np.ndarray, share: Fraction) -> tuple[np.ndarray, int]:
    """The prefix of a sorted set, and how many frequent shingles are in it."""
    if not len(tokens):
        return tokens, 0
    length = len(tokens) - -(-share.numerator * len(tokens) // share.denominator) + 1
    if not len(frequent):
        return tokens[:length], 0
    late = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    rare = tokens[~late]
    return np.concatenate([rare, tokens[late]])[:length], max(0, length - len(rare))


def _frequent(docs: DataFrame, key: str, size: int) -> np.ndarray:
    """Shingles of many rows, sorted: at most KNOWN, so that they may be sent to all tasks.

    They are counted in one of SEEN rows, and where a batch holds them twice; others are no help to the order. Of too many
    the more frequent ones are taken, by whole levels.
    """

    @releasing
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("jaccard")
        for batch in pieces(rows, "text", 8 << 20):
            sets = [shingle_set(t, size) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            tokens, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            twice = times > 1
            arrays = [pa.array(tokens[twice].view(np.int64)), pa.array(times[twice].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", "times"])

    seen = with_row_key(docs, key).where(F.pmod(F.xxhash64("row_key"), F.lit(SEEN)) == 0).select("text")
    counts = seen.mapInArrow(count, "token bigint, times bigint").groupBy("token").agg(F.sum("times").alias("times"))
    counts = written(counts.where(F.col("times") * SEEN > FREQUENT).withColumn("level", F.floor(F.log2("times")).cast("int")), "frequent")
    least, total = None, 0
    for row in sorted(counts.groupBy("level").count().collect(), reverse=True):
        total += row["count"]
        if total > KNOWN:
            break
        least = row["level"]
    taken = [] if least is None else counts.where(F.col("level") >= least).select("token").collect()
    drop_written(counts)
    return np.sort(np.array([r.token for r in taken], np.int64).view(np.uint64))


def _shape(tokens: np.ndarray) -> bytes:
    """How many shingles of a set fall in each of about n / 2 ranges of the hash, a byte each; nothing if that is too small."""
    bits = max(4, (len(tokens) // 2).bit_length())
    counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def _most_common(x: np.ndarray, y: np.ndarray) -> int | None:
    """What two sets can share at most, by their shapes: in each range no more than the smaller number. None if unknown."""
    if not len(x) or not len(y):
        return None
    x, y = sorted((x.astype(np.int64), y.astype(np.int64)), key=len)
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())


def _bounded(pairs: DataFrame, shapes: DataFrame, share: Fraction) -> DataFrame:
    """The (a, b) of ``pairs`` whose shapes don't rule the similarity out."""
    joined = pairs.join(shapes.toDF("a", "n", "x"), "a").join(shapes.toDF("b", "m", "y"), "b")
    p, q = share.numerator, share.denominator

    @releasing
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xs), (y, ys) = (utf8_views(batch.column(c)) for c in ("x", "y"))
            total = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            good = []
            for i in range(batch.num_rows):
                most = _most_common(x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]])
                if most is None or most * (p + q) >= p * total[i]:
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return joined.select("a", "b", "n", "m", "x", "y").mapInArrow(bound, "a bigint, b bigint")


def _prefixes(docs: DataFrame, key: str, size: int, share: Fraction, frequent: np.ndarray) -> DataFrame:
    """(key, row_key, id, n, late, prefix, shape) of every row; equal sets share their id."""
    schema = T.StructType(
        [docs.schema[key], T.StructField("row_key", T.LongType()), T.StructField("id", T.LongType())]
        + [T.StructField("n", T.LongType()), T.StructField("late", T.LongType())]
        + [T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("shape", T.BinaryType())]
    )

    @releasing
    def shorten(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("jaccard")
        for batch in pieces(rows, "text", 2 << 20):
            ids, sizes, lates, heads, shapes = [], [], [], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                tokens = shingle_set(text, size)
                head, late = _prefix(tokens, frequent, share)
                ids.append(xxhash.xxh64_intdigest(tokens.tobytes()))
                sizes.append(len(tokens))
                lates.append(late)
                heads.append(head)
                shapes.append(_shape(tokens))
            offsets = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads).view(np.int64)))
            arrays = [batch.column(key), batch.column("row_key"), pa.array(np.array(ids, np.uint64).view(np.int64))]
            arrays += [pa.array(sizes, pa.int64()), pa.array(lates, pa.int64()), lists, pa.array(shapes, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return with_row_key(docs, key).mapInArrow(shorten, schema)


def _sets(docs: DataFrame, key: str, size: int, marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, tokens): the whole sets of the ``wanted`` ids, each from one of its rows. Texts are shuffled compressed."""
    rows = marked.join(wanted, "id").groupBy("id").agg(F.min("row_key").alias("row_key")).select("row_key").distinct()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tokens", T.BinaryType())])

    @releasing
    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, "text", 4 << 20):
            texts = [packer.compress(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(texts, pa.binary())], names=["row_key", "zipped"])

    @releasing
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("jaccard")
        reader = zstandard.ZstdDecompressor()
        for batch in pieces(batches, "zipped", 1 << 20):
            sets = [shingle_set(reader.decompress(t) if t else b"", size) for t in batch.column("zipped").to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names
            )

    texts = with_row_key(docs, key).select("row_key", "text").mapInArrow(zipped, "row_key bigint, zipped binary")
    found = texts.join(rows, "row_key", "left_semi").select("zipped").mapInArrow(whole, schema)
    return written(found.dropDuplicates(["id"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets reach the similarity."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    p, q = share.numerator, share.denominator

    @releasing
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                (x, xs), (y, ys) = (utf8_views(batch.column(c)) for c in ("x", "y"))
                good = []
                for i in range(batch.num_rows):
                    one, other = x[xs[i] : xs[i + 1]].view(np.uint64), y[ys[i] : ys[i + 1]].view(np.uint64)
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    if common * (p + q) >= p * (len(one) + len(other)):
                        good.append(i)
                yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return joined.mapInArrow(verify, "a bigint, b bigint")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that ``roots`` does not join."""
    for end in ("a", "b"):
        of_end = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(of_end, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_a <> root_b").select("a", "b")


def similar_sets(
    docs: DataFrame, key: str, size: int, similarity: float, groups: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(key, row_key, id) of every row, and (node, root) of the ids that links of ``similarity`` or more join.

    ``groups`` are (row_key, component) of rows that are linked already. Those links count like the ones found here, and what
    they join is not compared again.

    Shingles known to be frequent are last in the order. Prefixes that meet in a shingle of at most FREQUENT of them are
    candidates, after a bound on what they can share. Those that meet in a known or another frequent one are candidates of one
    of them. A text is first compared with its smallest candidate, and with others only across the components found so far;
    for frequent shingles all but the largest component are compared with all. Texts are read for the prefixes, and once
    more where they have a candidate.
    """
    share = Fraction(str(similarity))
    p, q = share.numerator, share.denominator
    frequent = _frequent(docs, key, size)
    marked = written(_prefixes(docs, key, size, share, frequent), "prefixes")
    nodes = marked.select("id", "n", "late", "prefix").dropDuplicates(["id"])
    shapes = written(marked.select("id", "n", "shape").dropDuplicates(["id"]), "shapes")
    held = nodes.select("id", "n", "late", F.size("prefix").alias("length"), F.posexplode("prefix").alias("at", "token"))
    times = held.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # The late ones are at the end of a prefix.
    apart = (F.col("at") >= F.col("length") - F.col("late")) | (F.col("times") > FREQUENT)
    shared = held.join(times, "token").select("token", "id", "n", "late", "length", apart.alias("hot"))
    shared = written(shared, "shared")
    hot = shared.where("hot").select("token", "id", "n")
    # Counted where the rows of a text meet, so that no join is needed for it.
    uncounted = F.sum(F.col("hot").cast("long")).over(Window.partitionBy("id"))
    plain = shared.withColumn("uncounted", uncounted).where("NOT hot").select("token", "id", "n", "length", "uncounted")

    alike = (F.least("x.n", "y.n") * q) >= (F.greatest("x.n", "y.n") * p)
    met = plain.alias("x").join(plain.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & alike)
    counted = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(
        F.count(F.lit(1)).alias("c"),
        F.first(F.col("x.n") + F.col("y.n")).alias("total"),
        # Common shingles beyond the prefix that ends first, and those that are not counted here.
        F.first(F.greatest(F.col("x.n") - F.col("x.length"), F.col("y.n") - F.col("y.length"))).alias("beyond"),
        F.first(F.least("x.uncounted", "y.uncounted")).alias("uncounted"),
    )
    counted = counted.where((F.col("c") + F.col("uncounted") + F.col("beyond")) * (p + q) >= F.col("total") * p)
    pairs = written(counted.select("a", "b"), "pairs")

    first = hot.groupBy("token").agg(F.min(F.struct("id", "n")).alias("one"))
    first = first.select("token", F.col("one.id").alias("id"), F.col("one.n").alias("n"))
    star = first.alias("x").join(hot.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & alike)
    star = star.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    met = pairs.unionByName(star).distinct()
    given = None
    if groups is not None:
        own = marked.select("row_key", "id").distinct().join(groups.distinct(), "row_key").select("id", "component").distinct()
        least = own.groupBy("component").agg(F.min("id").alias("a"))
        given = own.join(least, "component").where("id <> a").select("a", F.col("id").alias("b"))
        given = written(given.distinct(), "given")
        met = _apart(met, written(components(given), "given-roots"))
    candidates = written(_bounded(met, shapes, share), "candidates")
    # Of the candidates of one text first the smallest, which mostly links all of a group.
    tried = written(candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")
    wanted = candidates.select(F.col("a").alias("id")).union(candidates.select("b")).union(hot.select("id")).distinct()
    sets = _sets(docs, key, size, marked, wanted)
    found = _verified(tried, sets, share)
    links = written(found if given is None else found.unionByName(given), "links")

    joined = written(components(links), "joined")
    named = hot.join(joined.withColumnRenamed("node", "id"), "id", "left")
    named = written(named.withColumn("root", F.coalesce("root", "id")), "named")
    largest = named.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = largest.groupBy("token").agg(F.max(F.struct("m", "root")).getField("root").alias("largest"))
    others = named.join(largest, "token").where("root <> largest")
    across = others.alias("x").join(named.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & alike)
    ends = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    apart = _apart(candidates, joined)
    across = across.select(*ends).distinct().join(candidates, ["a", "b"], "left_anti")
    rest = _bounded(across, shapes, share).unionByName(apart.join(tried, ["a", "b"], "left_anti"))
    links = written(links.unionByName(_verified(rest, sets, share)), "all-links")
    roots = written(components(links), "roots")
    for table in (shared, shapes, pairs, candidates, tried, sets, joined, named):
        drop_written(table)
    return marked.select(key, "row_key", "id"), roots
