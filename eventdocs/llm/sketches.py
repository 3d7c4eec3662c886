"""Document fingerprints: bottom-k sketches of word-shingle hashes, with built-in functions only.

A sketch is the ascending array of the k smallest distinct 64-bit shingle hashes. The sketch of a union is the bottom k
of the sketches' union, so parts merge in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventdocs.llm.common import BLANKS, text_of
from eventdocs.operators.ordinal import slice_of

K, SHINGLE = 256, 5
#: A slice is 2**10 neighbouring keys; neighbours are looked up among slices in groups of 2**12.
SLICE_BITS, GROUP_BITS = 10, 12


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of ``size`` words; fewer words make one shingle, none an empty array."""
    words = F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(1), F.size(h) - (size - 1)),
            lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(size)]),
        )
        return F.when(F.size(h) >= size, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(
            F.array().cast("array<bigint>")
        )

    return _let(hashed, shingles)


def _bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """Bottom-k sketch of a whole text; a null text has that of the empty one, an empty array."""
    return _bottom(shingle_hashes(F.coalesce(text, F.lit("")), size), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, group: Sequence[str], column: str, k: int = K) -> DataFrame:
    """One sketch per group. Every task keeps k hashes of a group at most before the shuffle, so a hot group is small.

    Null sketches and groups without hashes give no row; a null group is a group.
    """
    hashes = df.select(*group, F.explode(column).alias("_hash")).groupBy(*group, "_hash").agg(F.lit(1).alias("_one"))
    lowest = Window.partitionBy(*group).orderBy("_hash")
    kept = hashes.withColumn("_rank", F.row_number().over(lowest)).where(F.col("_rank") <= k)
    return kept.groupBy(*group).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def _shared(a: Column, b: Column, k: int, body) -> Column:
    """``body`` of the union's sketch and of the number of its hashes that both have."""
    return _let(
        F.struct(merged(a, b, k).alias("u"), F.array_intersect(a, b).alias("both")),
        lambda s: body(s["u"], F.size(F.filter(s["both"], lambda x: x <= F.element_at(s["u"], -1)))),
    )


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either that both have; 1 for two empty sketches, 0 if only one is empty."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(_shared(a, b, k, lambda u, n: n / F.size(u)))
    )


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    largest = F.element_at(a, F.when(F.size(a) < k, 1).otherwise(k))
    place = largest.cast("double") / F.lit(2.0**64) + 0.5
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 for an empty ``a``."""
    whole = distinct_count(merged(a, b, k), k)
    share = F.least(F.lit(1.0), resemblance(a, b, k) * whole / distinct_count(a, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(share)


def as_text(a: Column) -> Column:
    """The sketch in base64, eight bytes a hash."""
    digits = F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.regexp_replace(F.base64(F.unhex(digits)), "[\r\n]", "")


def _next_lower(keys: DataFrame, levels: int = 2) -> DataFrame:
    """(k, lower): for each of the distinct BIGINTs k the next lower one, null for the lowest.

    Neighbours are found in groups of 2**12 keys, and those of groups' ends among the groups.
    """
    if not levels:
        return keys.select("k", F.lag("k").over(Window.orderBy("k")).alias("lower"))
    grouped = keys.withColumn("g", F.shiftright("k", GROUP_BITS))
    inside = grouped.withColumn("lower", F.lag("k").over(Window.partitionBy("g").orderBy("k")))
    tops = grouped.groupBy("g").agg(F.max("k").alias("top"))
    order = _next_lower(tops.select(F.col("g").alias("k")), levels - 1)
    below = order.join(tops.withColumnRenamed("g", "lower"), "lower").select(F.col("k").alias("g"), "top")
    return inside.join(below, "g", "left").select("k", F.coalesce("lower", "top").alias("lower"))


def with_edits(docs: DataFrame, key: str = "doc_id", k: int = K, size: int = SHINGLE) -> DataFrame:
    """(key, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint) of every row.

    ``edited`` is the text with its last third of code points (rounded down) replaced by as many (or all) first ones of
    the next document in descending key order; after the last comes the first. Fingerprints are sketches. A null text
    is empty, a null key comes last, rows with one key follow in the order of their texts' hashes, a single row is its
    own next. An empty table gives an empty one; other columns are not read.

    The texts are shuffled once, by slices of 2**10 keys; where a slice ends, one row per slice hands over the first
    text of the next.
    """
    rows = docs.select(F.col(key).alias("_id"), text_of().alias("_text"), slice_of(key, SLICE_BITS).alias("_slice"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    order = Window.partitionBy("_slice").orderBy(F.col("_id").desc_nulls_last(), "_tie")
    heads = rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    heads = heads.select("_slice", F.col("_text").alias("_head"))
    lower = _next_lower(rows.select(F.col("_slice").alias("k")).distinct())
    follows = lower.where("lower IS NOT NULL").select(F.col("k").alias("_from"), F.col("lower").alias("_slice"))
    around = rows.agg(F.min("_slice").alias("_from"), F.max("_slice").alias("_slice"))  # after the last, the first
    follows = follows.unionByName(around)
    handed = follows.join(heads, "_slice").select(F.col("_from").alias("_slice"), "_head")
    handed = handed.withColumn("_head_sketch", sketch(F.col("_head"), k, size))

    placed = rows.repartition("_slice").withColumn("_own", sketch(F.col("_text"), k, size))
    placed = placed.withColumns(
        {"_after": F.lead("_text").over(order), "_after_sketch": F.lead("_own").over(order)}
    )
    ended = (placed["_slice"] == handed["_slice"]) & placed["_after"].isNull()
    chars = F.length("_text")
    joined = placed.join(handed, ended, "left").select(
        F.col("_id").alias(key),
        chars.cast("bigint").alias("n_chars"),
        F.concat(
            F.expr("substring(_text, 1, length(_text) - length(_text) div 3)"),
            F.expr("substring(coalesce(_after, _head), 1, CAST(length(_text) div 3 AS INT))"),
        ).alias("edited"),
        F.col("_own").alias("fingerprint"),
        F.coalesce("_after_sketch", "_head_sketch").alias("next_fingerprint"),
    )
    return joined.withColumn("edited_fingerprint", sketch(F.col("edited"), k, size))
