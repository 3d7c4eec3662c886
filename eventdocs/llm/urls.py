"""URL filters: all glob rules at once, as one bit-parallel automaton.

Every rule is a host glob and a path glob. A host without wildcards stands for itself and all its subdomains, a
path without wildcards for all paths that start with it. Rules become token positions in multiword Shift-And
masks: a position advances when the next character fits it, and a position before ``*`` also stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventdocs.llm.common import UPPER

ALLOW, BLOCK = "allow", "block"
#: Classes of characters that no rule names: the mark between host and path, and all others.
MARK, OTHER = 0, 1


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Hosts that the method itself blocks where no explicit rule fits.
DEFAULT_GLOBS = (
    Rule(BLOCK, "*casino*", "*"),
    Rule(BLOCK, "*ads-track*", "*"),
    Rule(BLOCK, "*porn*", "*"),
    Rule(BLOCK, "*viagra*", "*"),
    Rule(BLOCK, "*malware*", "*"),
)


def tokens(rule: Rule) -> list[str | int]:
    """The rule over ``"." + host, MARK, path``: characters, MARK, and wildcards as "host*", "host?", "any*", "any?"."""
    wild = set(rule.host) & set("*?")
    host = list(rule.host) if wild else ["*", ".", *rule.host]
    host = [f"host{c}" if c in "*?" else c for c in (["?", *host] if wild else host)]
    path = list(rule.path) if set(rule.path) & set("*?") else [*rule.path, "*"]
    return [*host, MARK, *(f"any{c}" if c in "*?" else c for c in path)]


class Automaton:
    """Shift-And masks of all rules: bit i of ``step[c]``: class c moves on to position i; of ``stay[c]``: stays there."""

    def __init__(self, rules: Sequence[Rule]):
        named = sorted({t for r in rules for t in tokens(r) if isinstance(t, str) and len(t) == 1})
        self.codes = np.array([ord(c) for c in named], np.uint32)
        classes = len(named) + 2
        positions: list[tuple[str | int | None, str | None]] = []  # what moves on to it, what stays
        self.first, self.last = [], []
        for rule in rules:
            self.first.append(len(positions))
            positions.append((None, None))
            for token in tokens(rule):
                if token in ("host*", "any*"):
                    positions[-1] = (positions[-1][0], token)
                else:
                    positions.append((token, None))
            self.last.append(len(positions) - 1)
        words = max(1, -(-len(positions) // 64))
        self.step = np.zeros((classes, words), np.uint64)
        self.stay = np.zeros((classes, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        index = {ord(c): i + 2 for i, c in enumerate(named)}
        every, in_host = range(classes), range(1, classes)
        for i, (token, loop) in enumerate(positions):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            moved = {"host?": in_host, "any?": in_host}.get(token)
            if moved is None:
                moved = [] if token is None else [MARK] if token == MARK else [index[ord(token)]]
            for c in moved:
                self.step[c, word] |= bit
            for c in {"host*": in_host, "any*": every}.get(loop, ()):
                self.stay[c, word] |= bit
        for i in self.first:
            self.start[i // 64] |= np.uint64(1 << (i % 64))

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(self.codes):
            return np.full(len(codes), OTHER, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at + 2, OTHER)

    def hits(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Whether rule j fits url i. All urls advance together, one character at a time."""
        urls = [np.concatenate([self.classes("." + h), [MARK], self.classes(p)]) for h, p in zip(hosts, paths)]
        found = np.zeros((len(urls), len(self.first)), bool)
        if not urls:
            return found
        sizes = np.array([len(u) for u in urls])
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([urls[i] for i in order]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
        state = np.tile(self.start, (len(urls), 1))
        live = len(urls)
        for position in range(int(sizes.max())):
            while sizes[order[live - 1]] <= position:
                live -= 1
            c = flat[starts[:live] + position]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[c]) | (now & self.stay[c])
        for rule, last in enumerate(self.last):
            found[order, rule] = (state[:, last // 64] >> np.uint64(last % 64)) & np.uint64(1) > 0
        return found


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both are empty for a null url and one without ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, UPPER.lower())
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)})


def judge_urls(
    df: DataFrame,
    rules: Sequence[Rule],
    globs: Sequence[Rule] = DEFAULT_GLOBS,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(key, host, path, rule, verdict) of every row; other columns are not read.

    The longest rule that fits gives rule and verdict (of equally long ones that with the longer host, then the
    first). Where none fits, rule is null and the verdict is block if one of the method's globs fits, else allow. A null
    url and one without ``://`` have empty host and path and fit no host rule. Repeated rows and null keys are kept as
    they are; an empty table gives an empty one. No shuffle; a url may have any length.
    """
    # Latest rules win the argmax below, so the best one has the highest weight.
    ranked = sorted(range(len(rules)), key=lambda i: (len(rules[i].text), len(rules[i].host), -i))
    ordered = [rules[i] for i in ranked]
    machine = Automaton([*globs, *ordered])
    schema = T.StructType(
        [df.schema[key], *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict"))]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = machine.hits(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            own, fits = hits[:, : len(globs)].any(1), hits[:, len(globs) :]
            best = np.where(fits, np.arange(1, len(ordered) + 1), 0).max(1, initial=0)
            rule = [ordered[b - 1].text if b else None for b in best]
            verdict = [ordered[b - 1].verdict if b else BLOCK if o else ALLOW for b, o in zip(best, own)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    keyed = df.select(F.col(key), F.col(url).cast("string").alias("_url"))
    return with_host_and_path(keyed, "_url").select(key, "host", "path").mapInArrow(judge, schema)
