"""A training corpus from raw documents: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Its result is written as
Parquet in the session's shared folder and read again as the next stage's documents. All but the last return the
columns of the documents, further ones included. Stages accept null and repeated keys, null and empty texts (each operator's
docstring states what they become) and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventdocs.llm import decontaminate, lines, packing, simhash, toxicity
from eventdocs.llm.common import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays below their language's threshold. The network learns from the labelled rows that
    are among ``docs``."""
    net = toxicity.fit_on_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    others = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "doc_id", "text", "lang")
    scored = toxicity.scores(rows, net, extra=("row", "lang", "text"))
    kept = scored.where(~toxicity.rejected(net, F.col("score"), F.col("lang")))
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that at least ten of them share; ``n_chars`` counts what is left."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "doc_id", "text")
    kept = lines.dedup_lines(rows, carry=("row",))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by SimHash fingerprints within 4 bits, or by a Jaccard similarity of 0.8 or more
    over five-word shingles, which finds the near copies whose fingerprints are further apart."""
    return simhash.first_of_each(docs, size=5, similarity=0.8, radius=simhash.RADIUS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, up to a tenth of its length in edits."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained network, a search by edits and a tokenizer are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
