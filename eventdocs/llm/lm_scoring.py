"""LM scoring: log10 probability of every text under a causal self-attention model, next to that of a unigram model.

1. All training texts give the counts of their words; these are a table, as large as the vocabulary of the corpus.
2. All training words, or one of ``rate`` spans of them, are cut to windows of subword ids. Shards of
   windows are trained apart from common weights, and their weights are averaged, round by round.
3. Every text is cut to overlapping windows in which each id is scored once (see ``attention``). A word has the product of its
   ids' probabilities. The model mixes that, word by word, with the word's smoothed share of the corpus, half and half.
4. The counts of at most FREQUENT words are sent to the tasks. All other words of a text meet their counts in a join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventdocs.llm import attention
from eventdocs.llm.attention import STRIDE, WINDOW
from eventdocs.llm.common import ARRAYS, added_up, array_row, drop_written, keep_only, keeps, pieces, releasing, summed, text_of, with_row_key, written
from eventdocs.llm.windows import mixed

TOKENIZER = "byte_bpe_50k.tiktoken"
#: One of so many spans of SPAN words trains the model; 1 is all of them.
RATE, SPAN = 1, 64
#: Words whose counts are sent to all tasks, each of at most so many bytes.
FREQUENT, LONGEST = 200_000, 64
#: Windows of a shard, about; learning rates of the rounds; steps of a round, more where
#: the rounds would not reach all windows, and times that it reads a small shard.
SHARD_WINDOWS, RATES, STEPS, EPOCHS = 32_768, (0.01, 0.01, 0.01, 0.003), 64, 16
#: Windows of a step.
BATCH = 128
#: Bytes of text, and windows, that are worked on together; letters of a word that are tokenized together.
TOGETHER, BLOCK, LETTERS = 1 << 20, 96, 500
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_encoders: dict[str, Subwords] = {}
keeps("lm", _encoders.clear)


class Subwords:
    """Ids of words, each as it is after a space. The id after the last one ends a text, the next one stands before it."""

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(name if "/" in name else public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)

    @property
    def size(self) -> int:
        return self.end + 1

    def of(self, word: bytes) -> list[int]:
        text = " " + word.decode()
        if len(text) <= LETTERS:
            return self.encoding.encode_ordinary(text)
        return [i for at in range(0, len(text), LETTERS) for i in self.encoding.encode_ordinary(text[at : at + LETTERS])]


    def together(self, words: list[bytes]) -> list[int]:
        """Ids of words in a row."""
        if max(map(len, words), default=0) > LETTERS:
            return [i for w in words for i in self.of(w)]
        return self.encoding.encode_ordinary(" " + b" ".join(words).decode()) if words else []


def subwords(name: str) -> Subwords:
    """The worker's own encoder."""
    if name not in _encoders:
        _encoders[name] = Subwords(name)
    return _encoders[name]


def held_out(key: str) -> Column:
    """Whether a row is not learned from: crc32 of the key as text leaves 1 modulo 5. A row without a key is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def word_lists(text: bytes, most: int = TOGETHER) -> Iterator[list[bytes]]:
    """The words of a text with A-Z lowered, in lists of about ``most`` bytes; one empty list without words."""
    text, at = text.lower(), 0
    while True:
        cut = _BLANK.search(text, at + most) if len(text) - at > most else None
        if not cut:
            yield text[at:].split()
            return
        yield text[at : cut.start()].split()
        at = cut.end()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all values of the column ``text``; counted per task first, so that a frequent word is a few rows."""

    def rows(counter: Counter) -> pa.RecordBatch:
        arrays = [pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("lm")
        counter: Counter = Counter()
        for batch in pieces(batches, "text", 4 << 20):
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                for words in word_lists(text):
                    counter.update(words)
                    if len(counter) > 200_000:
                        yield rows(counter)
                        counter.clear()
        yield rows(counter)

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _sample(texts: DataFrame, tokenizer: str, rate: int) -> DataFrame:
    """(at, ids): windows of WINDOW + 1 ids, -1 where the text has ended, of one of ``rate`` spans of (row_key, text)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = subwords(tokenizer)
        for batch in pieces(batches, "text", 4 << 20):
            at, found = [], []
            for key, text in zip(batch.column("row_key").to_numpy(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                number, lists = 0, word_lists(text)
                words, following = next(lists), None
                while words is not None:
                    following = next(lists, None)
                    spans = max(1, -(-len(words) // SPAN))
                    hashes = mixed(mixed(np.array([key], np.int64).view(np.uint64)) + np.arange(number, number + spans, dtype=np.uint64))
                    for i in np.flatnonzero(hashes % np.uint64(rate) == 0).tolist():
                        ids = encoder.together(words[i * SPAN : (i + 1) * SPAN])
                        ids = [encoder.size] * (number + i == 0) + ids + [encoder.end] * (following is None and i == spans - 1)
                        for k in range(0, len(ids) - 1, WINDOW):
                            own = ids[k : k + WINDOW + 1]
                            at.append(int(hashes[i] >> np.uint64(1)))
                            found.append(np.array(own + [-1] * (WINDOW + 1 - len(own)), "<i4").tobytes())
                    number, words = number + spans, following
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found, pa.binary())], names=["at", "ids"])

    return texts.select("row_key", "text").mapInArrow(windows, "at long, ids binary")


def _windows(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, WINDOW + 1)


def _stored(size: int) -> str:
    """Ids up to ``size`` and the mark of an ended text in as few bytes as they take."""
    return "<u2" if size < 65_535 else "<u4"


def _packed(sample: DataFrame, size: int) -> DataFrame:
    """(shard, windows): all windows of a shard in the order of (at, ids) as one value, so that they are dealt out once."""
    shards = max(1, -(-sample.count() // SHARD_WINDOWS))

    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard").slice(0, 1)
        ids = _windows(table.sort_by([("at", "ascending"), ("ids", "ascending")]).column("ids"))
        return pa.table({"shard": shard, "windows": pa.array([ids.astype(_stored(size)).tobytes()], pa.binary())})

    dealt = sample.withColumn("shard", F.pmod("at", F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pack, "shard long, windows binary")


def _unpacked(value: pa.Buffer, size: int) -> np.ndarray:
    ids = np.frombuffer(value, _stored(size)).reshape(-1, WINDOW + 1)
    return np.where(ids == np.iinfo(ids.dtype).max, -1, ids.astype(np.int32))


def _classes(ids: np.ndarray, words: attention.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Input rows and target classes of windows."""
    rows = words.row[np.where(ids[:, :-1] < 0, words.start, ids[:, :-1])].astype(np.int64)
    targets = np.where(ids[:, 1:] < 0, -1, words.of_class[np.maximum(ids[:, 1:], 0) % len(words.of_class)].astype(np.int64))
    return rows, targets


@dataclass(frozen=True)
class Model:
    tokenizer: str
    words: attention.Vocabulary
    weights: dict[str, np.ndarray]
    #: (word, c): counts of all words of the training texts, a table in the shared folder.
    counts: DataFrame
    tokens: int
    distinct: int
    texts: int

    def base(self, count):
        """log10 of the unigram probability; ``count`` is a column or an array."""
        log = F.log10 if isinstance(count, Column) else np.log10
        return log((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def steps_of(windows: int) -> int:
    """Steps of a round over a shard's windows: together the rounds read each of them at least once."""
    batches = -(-windows // BATCH)
    return max(min(STEPS, EPOCHS * batches), -(-batches // len(RATES)))


def fit(docs: DataFrame, key: str = "doc_id", tokenizer: str = TOKENIZER, rate: int = RATE) -> Model:
    """Learns from all rows that are not held out; null texts are empty, repeated rows count each time."""
    texts = with_row_key(docs.where(~held_out(key)), key)
    counts = written(word_counts(texts.select("text")), "word-counts")
    known = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_texts = texts.count()
    size = subwords(tokenizer).size
    sample = written(_sample(texts, tokenizer, rate), "windows")

    def id_counts(batch: pa.RecordBatch) -> np.ndarray:
        ids = _windows(batch.column("ids"))[:, 1:]
        return np.bincount(ids[ids >= 0], minlength=size).astype(np.int64)

    found = summed(sample, id_counts, np.int64)
    ids = np.zeros(size, np.int64) if found is None else found
    order = attention.ranked(ids)[: attention.KNOWN]

    def followed(batch: pa.RecordBatch) -> np.ndarray:
        windows = _windows(batch.column("ids"))
        return attention.pairs(np.where(windows < 0, size, windows), order, size).ravel()

    found = summed(sample, followed, np.int64)
    pairs = np.zeros(attention.KNOWN * attention.ALONE, np.int64) if found is None else found
    words = attention.vocabulary(ids, pairs.reshape(attention.KNOWN, attention.ALONE))
    weights = attention.initial(words)
    packed = written(_packed(sample, size), "shards")
    drop_written(sample)

    def trainer(w: dict[str, np.ndarray], number: int, pace: float):
        @releasing
        def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_only("lm")
            for batch in batches:
                for shard, value in zip(batch.column("shard").to_pylist(), batch.column("windows")):
                    windows = _unpacked(value.as_buffer(), size)
                    steps = steps_of(len(windows))
                    # Only the windows of this round's steps are looked up, in the order of the steps.
                    first, here = number * steps * BATCH, min(len(windows), steps * BATCH)
                    rows, targets = _classes(windows[np.arange(first, first + here) % len(windows)], words)
                    new = attention.train(w, rows, targets, 0, steps, pace, BATCH)
                    values = len(windows) * np.frombuffer(attention.packed(new))
                    yield array_row(shard, np.append(values, len(windows)))

        return trained

    for number, pace in enumerate(RATES):
        total = added_up(packed.mapInArrow(trainer(weights, number, pace), ARRAYS))
        if total is not None:
            weights = attention.unpacked(total[:-1] / total[-1], weights)
    drop_written(packed)
    return Model(tokenizer, words, weights, counts, known[0] + n_texts, known[1] + (n_texts > 0), n_texts)


def _frequent(model: Model) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts: whole levels of the count, as long as they are at most FREQUENT words."""
    short = model.counts.where(F.length("word") <= LONGEST)
    level = F.floor(F.log2(F.col("c")) * 8).cast("int")
    least, total = None, 0
    for row in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += row["count"]
        if total > FREQUENT:
            break
        least = row["level"]
    if least is None:
        return []
    return [(bytes(r["word"]), r["c"]) for r in short.where(level >= least).select("word", "c").collect()]


class _Texts:
    """Scores the words of many texts at once."""

    def __init__(self, model_words, weights, tokenizer: str, frequent: list[tuple[bytes, int]], base, end_base: float):
        self.encoder = subwords(tokenizer)
        self.model = attention.Scorer(weights, model_words)
        self.words = model_words
        self.base = np.append(base, end_base)
        self.index = {w: i for i, (w, _) in enumerate(frequent)}
        self.index[b""] = len(frequent)  # the end of a text
        ids = [self.encoder.of(w) for w, _ in frequent] + [[self.encoder.end]]
        self.sizes = np.array([len(i) for i in ids])
        self.ids = np.array([j for i in ids for j in i], np.int32)

    def _logs(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, leads: np.ndarray) -> np.ndarray:
        """Natural logarithms for ids of texts laid end to end, each after the one before it; of a text with a lead the
        first ids are known and only stand before the others."""
        before = WINDOW - STRIDE
        inputs = np.concatenate([[self.words.start], ids[:-1], np.zeros(2 * WINDOW, np.int32)])
        opening = leads <= before  # the lead, if any, is all there was
        inputs[starts[opening]] = self.words.start
        rows = self.words.row[inputs]
        targets = np.concatenate([self.words.of_class[ids], np.zeros(2 * WINDOW, np.int16)])
        logs = np.zeros(len(ids))
        # The first window of a text is scored whole; of those after it, and all of a text that goes on, the last STRIDE.
        first = np.where(opening, STRIDE, 1)
        count = np.maximum(0, -(-(sizes - before - first) // STRIDE))
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        later = np.repeat(starts + first, count) + STRIDE * within
        ends = starts + sizes
        for windows, limits, skip in ((starts[opening], ends[opening], 0), (later, np.repeat(ends, count), before)):
            for at in range(0, len(windows), BLOCK):
                own = windows[at : at + BLOCK, None]
                places = own + np.arange(skip, WINDOW)
                got = self.model.logs(rows[own + np.arange(WINDOW)], targets[places]).reshape(places.shape)
                inside = places < limits[at : at + BLOCK, None]
                logs[places[inside]] = got[inside]
        return logs

    def score(self, lists: list[list[bytes]], carried: list[np.ndarray | None]) -> list[tuple]:
        """(base, attention, mixture, known words, rare words, their attention, last ids) of every list. A list that goes on
        a text has the ids before it in ``carried``, others None."""
        words = [w for own in lists for w in own]
        owner = np.array([len(own) for own in lists])
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(at < 0)
        spelled = {w: k for k, w in enumerate({words[i]: None for i in rare.tolist()})}
        own_ids = [self.encoder.of(w) for w in spelled]
        at[rare] = [len(self.sizes) + spelled[words[i]] for i in rare.tolist()]
        table = np.concatenate([self.ids, np.array([j for i in own_ids for j in i], np.int32)])
        sizes = np.concatenate([self.sizes, np.array([len(i) for i in own_ids], np.int64)])
        begin = np.cumsum(sizes) - sizes
        size = sizes[at]
        ends = np.cumsum(size)
        ids = table[np.repeat(begin[at] - (ends - size), size) + np.arange(size.sum())]
        last = np.cumsum(owner)
        first = last - owner
        token_end = np.append(0, ends)[last]
        token_start = np.append(0, ends)[first]
        leads = np.array([0 if c is None else len(c) for c in carried])
        parts = [x for c, a, b in zip(carried, token_start, token_end) for x in (np.zeros(0, np.int32) if c is None else c, ids[a:b])]
        laid = np.concatenate(parts)
        lengths = leads + token_end - token_start
        starts = np.cumsum(lengths) - lengths
        full = lengths > 0
        logs = self._logs(laid, starts[full], lengths[full], leads[full])
        scored = np.ones(len(laid), bool)
        for s, n in zip(starts, leads):
            scored[s : s + n] = False
        tokens = logs[scored] / np.log(10) + self.words.share[ids]
        model = np.add.reduceat(tokens, ends - size) if len(words) else np.zeros(0)
        common = at < len(self.sizes)
        base = np.where(common, self.base[np.where(common, at, 0)], 0.0)
        mixture = np.where(common, mixed_logs(base, model), 0.0)
        out = []
        for a, b, s, n in zip(first, last, starts, lengths):
            picked = a + np.flatnonzero(~common[a:b])
            known = int((at[a:b] < len(self.sizes) - 1).sum())
            out.append(
                (base[a:b].sum(), model[a:b].sum(), mixture[a:b].sum(), known, [words[i] for i in picked], model[picked],
                 laid[max(s, s + n - (WINDOW - STRIDE) - 1) : s + n])
            )
        return out


def mixed_logs(a, b):
    """log10 of the mean of two probabilities that are given by their log10."""
    return np.logaddexp(a * np.log(10), b * np.log(10)) / np.log(10) - np.log10(2)


def scores(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score) of every row.

    Tokens are the words and one end, which is known where any text is learned from. A null text is empty: it has its end
    only. A very long text is worked on in parts that carry the ids before them on; a word is never cut. Null and repeated
    keys and rows stay as they are. An empty table gives an empty one; other columns are not read. ``attention_score`` is
    the score without the mixture.
    """
    spark = docs.sparkSession
    frequent = _frequent(model)
    base = model.base(np.array([c for _, c in frequent], float))
    sent = spark.sparkContext.broadcast((model.words, model.weights, model.tokenizer, frequent, base, float(model.base(float(model.texts)))))
    some = int(model.texts > 0)
    rare = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("a", T.DoubleType())]))
    doubles = [T.StructField(n, T.DoubleType()) for n in ("base", "attention", "mixture")]
    schema = T.StructType(
        [docs.schema[key], T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
         T.StructField("known", T.LongType()), *doubles, T.StructField("rare", rare)]
    )
    pairs = pa.list_(pa.struct([("word", pa.binary()), ("a", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("lm")
        scorer = _Texts(*sent.value)
        for batch in pieces(batches, "text", TOGETHER):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            if len(texts) == 1 and len(texts[0]) > TOGETHER:
                lists = word_lists(texts[0])
                sums: list = [0.0, 0.0, 0.0, 0, [], []]
                carry, words, now = None, 0, next(lists)
                while now is not None:
                    following = next(lists, None)
                    own = now if following is not None else now + [b""]
                    words += len(own)
                    if own:
                        got = scorer.score([own], [carry])[0]
                        sums = [x + y for x, y in zip(sums[:4], got[:4])] + [sums[4] + got[4], [*sums[5], *got[5]]]
                        carry = got[6]
                    now = following
                found, n_tokens = [sums], [words]
            else:
                lists = [next(word_lists(t)) + [b""] for t in texts]
                found, n_tokens = scorer.score(lists, [None] * len(lists)), [len(w) for w in lists]
            arrays = [batch.column(key), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array([f[3] + some for f in found], pa.int64())]
            arrays += [pa.array([float(f[i]) for f in found], pa.float64()) for i in range(3)]
            arrays.append(pa.array([[{"word": w, "a": float(a)} for w, a in zip(f[4], f[5])] for f in found], pairs))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    rows = docs.select(key, held_out(key).alias("held_out"), text_of().alias("text"))
    parts = written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored-parts")
    sent.destroy()
    others = parts.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.a").alias("a"))
    met = others.join(model.counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    unigram = model.base(F.col("c").cast("double"))
    met = met.select("row", (F.col("c") > 0).cast("long").alias("known"), unigram.alias("b"), "a")
    # The larger of the two is taken out, so that a very small one does no harm.
    high, low = F.greatest("a", "b"), F.least("a", "b")
    mixture = high + F.log10((F.lit(1.0) + F.pow(F.lit(10.0), low - high)) / 2)
    sums = met.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("b").alias("more_base"), F.sum(mixture).alias("more_mixture"))

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return parts.join(sums, "row", "left").select(
        key,
        "held_out",
        "n_tokens",
        plus("known", "more_known").alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        plus("mixture", "more_mixture").alias("score"),
        F.col("attention").alias("attention_score"),
    )
