"""Event constants onto every row of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt out to: one, as Spark's skew join splits a hot key where the constants are too many
#: to be broadcast. More parts take as many copies of the constants, and a broadcast holds all of them.
SPREAD = 1


def constants_rejects(constants: DataFrame, key: str = "event_id") -> DataFrame:
    """Keys that occur more than once, and how often; ``with_constants`` gives their rows nulls."""
    return constants.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def with_constants(
    rows: DataFrame, constants: DataFrame, key: str = "event_id", spread: str = "entry_no", parts: int = SPREAD
) -> DataFrame:
    """Add the constants of ``key`` to every row; rows of an unknown key, and of one that occurs twice, keep nulls.

    One plan for every size: constants are reduced to one row per key and joined. Spark broadcasts them where its own threshold
    allows; else the rows are shuffled, and a hot key's are split by the skew join of adaptive execution. Without that,
    ``parts`` above one deals out the rows of every key by ``spread``, each part with a copy of the constants. Nothing runs while
    the plan is built.
    """
    others = [c for c in constants.columns if c != key]
    once = constants.groupBy(key).agg(F.count(F.lit(1)).alias("_times"), F.first(F.struct(*others)).alias("_c"))
    single = once.where("_times = 1").select(key, *[F.col("_c").getField(c).alias(c) for c in others])
    if parts == 1:
        return rows.join(single, key, "left")
    copies = single.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    return dealt.join(copies, [key, "_part"], "left").drop("_part")
