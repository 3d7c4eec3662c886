"""The queries of the operators over the given tables, and those that SQL can express in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventdocs.llm import (
    decontaminate,
    fm_index,
    labelled,
    lines,
    lm_scoring,
    packing,
    prefix_trie,
    quality,
    simhash,
    sketches,
    suffix_arrays,
    toxicity,
    urls,
    whitening,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The rules of op3 (verdict, host, path).
URL_RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, folder, "documents"), most=2048)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents hold, up to a tenth of their length in edits."""
    found = decontaminate.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "edits", "start", "end")


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.judge_urls(_table(spark, folder, "pages"), URL_RULES)


def op4_fm_index_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of all documents without windows of 35 words that occur twice."""
    kept = fm_index.dedup_windows(_table(spark, folder, "documents"), length=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of all documents without strings of 100 bytes that start earlier too."""
    kept = suffix_arrays.dedup_substrings(_table(spark, folder, "documents"), length=100)
    return kept.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every whole text; labels of the held-out fold are not learned from."""
    docs = _table(spark, folder, "documents")
    net = toxicity.fit_on_tables(docs, _table(spark, folder, "labels"))
    found = toxicity.scores(docs, net)
    return found.select(
        "doc_id",
        labelled.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of all documents and their edited texts, and their likeness to those and to the next document's."""
    found = sketches.with_edits(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        sketches.as_text(F.col("fingerprint")).alias("fingerprint"),
        sketches.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        sketches.resemblance(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade and tail probability of every whole text."""
    docs = _table(spark, folder, "documents")
    return quality.grades(docs, quality.fit_on_tables(docs, _table(spark, folder, "labels")))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines before and after dropping those that at least ten documents share."""
    kept = lines.dedup_lines(_table(spark, folder, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash of four-word shingles and components of fingerprints within four bits."""
    found = simhash.near_duplicates(_table(spark, folder, "documents"), size=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of every whole text under the attention model and under a unigram model."""
    docs = _table(spark, folder, "documents")
    return lm_scoring.scores(docs, lm_scoring.fit(docs, rate=1))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations, after each took over its first turns from another one."""
    turns, convs = prefix_trie.rebuilt(prefix_trie.ordered_turns(_table(spark, folder, "conversations")), every=20, heads=4)
    return prefix_trie.prefix_trie(turns, convs)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on the first 32 principal components, scaled to unit variance."""
    vectors = _table(spark, folder, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors, count=32))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_fm_index_dedup": op4_fm_index_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}

ORACLE = {
    "op3_url_filter": """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, arg_max(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path)) AS b
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, CASE WHEN host LIKE '%casino%' OR host LIKE '%ads-track%'
    OR host LIKE '%porn%' OR host LIKE '%viagra%' OR host LIKE '%malware%' THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
""",
    "op9_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM lines
), frequent AS (
  SELECT line_key FROM keyed WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, pos, line, line_key IN (SELECT line_key FROM frequent) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    # The checksum goes bit by bit: a number of 0 and more is a byte to take in, -1 is a shift. Rows that share a
    # conversation and a turn are not in the tables.
    "op12_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), listed AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY pos) AS turns FROM own GROUP BY conv_id
), steps AS (
  SELECT conv_id, turns, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS s FROM listed
), heads AS (
  SELECT conv_id, turns, xor(list_reduce(s, lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
    WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295) % 4 AS h FROM steps
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:h], []), a.turns[h + 1:]) AS turns
  FROM heads a LEFT JOIN listed b ON b.conv_id = a.conv_id - a.conv_id % 20
), members AS (
  SELECT conv_id, len(turns) AS n, d, turns[1:d] AS node, turns[1:d - 1] AS parent, turns[d].t AS last
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d AS depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+')), 0) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM members GROUP BY d, node
), children AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, node)
), paths AS (
  SELECT conv_id, depth, node, n_children, saved, unnest(range(depth + 1)) AS above FROM counted
), below AS (
  SELECT above AS depth, node[1:above] AS node, count(*) FILTER (n_children = 0) AS n_leaves,
    CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM paths GROUP BY ALL
)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, below.n_leaves, below.saved_tokens,
  a.ends_sha256
FROM counted a JOIN below USING (depth, node)
LEFT JOIN counted b ON a.depth > 0 AND b.depth = a.depth - 1 AND b.node = a.parent
""",
}
