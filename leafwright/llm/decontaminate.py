"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, tidy

# Bytes of words: digits, a-z and everything outside ASCII; A-Z are lower-cased first.
_WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c in _WORD else 32) for c in range(256))
_SPAN = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences.

    A state stands for all substrings that end at the same places; `length` is its longest, and
    `link` leads to the state of the longest suffix that ends at more places.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        pairs = set()
        for _, ids in coded:
            at = 0
            for c in ids:
                at = self._extend(at, c)
            pairs.update(zip(ids, ids[1:]))
        self.names = [name for name, _ in coded]
        self.of_window: dict[int, set[int]] = {}  # state -> items with a window that ends in it
        self.of_short: dict[int, list[tuple[int, int]]] = {}  # state -> (length, item) of items shorter than a window
        for k, (_, ids) in enumerate(coded):
            for _, state, run in self.walk(ids):
                if run >= window:
                    self.of_window.setdefault(self._cut(state), set()).add(k)
            if len(ids) < window:
                self.of_short.setdefault(state, []).append((len(ids), k))
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        # states from which some suffix is a whole short item
        self.short_below = [False] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short_below[s] = s in self.of_short or self.short_below[self.link[s]]
        n = max(1, len(self.vocab))
        self.pairs = np.array(sorted(a * n + b for a, b in pairs), dtype=np.int64)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the substring that p and c make, parted from the longer ones of q."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _cut(self, state: int) -> int:
        """The state that holds the last `window` words of what led to `state`."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, ids) -> Iterator[tuple[int, int, int]]:
        """For each place: (place, state, words matched that end there)."""
        state = run = 0
        for i, c in enumerate(ids):
            while state and c not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if c in self.next[state]:
                state, run = self.next[state][c], run + 1
            yield i, state, run

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """The places inside an occurrence of a window, as a mask, and the items of those windows."""
        mask, found = np.zeros(len(ids), bool), set()
        for i, state, run in self.walk(ids.tolist()):
            if run >= self.window:
                mask[i - self.window + 1 : i + 1] = True
                found |= self.of_window[self._cut(state)]
            s = state
            while s > 0 and self.short_below[s]:
                for length, k in self.of_short.get(s, ()):
                    if length <= run:
                        mask[i - length + 1 : i + 1] = True
                        found.add(k)
                s = self.link[s]
        return mask, found

    def scan(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, set[int]]]:
        """hits() of each document. Only runs of word pairs that some item has go through the automaton."""
        get, n = self.vocab.get, max(1, len(self.vocab))
        out: list[tuple[np.ndarray, set[int]]] = []
        for words in docs:
            mask, found = np.zeros(len(words), bool), set()
            if len(words) >= self.shortest and self.vocab:
                ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                known = ids >= 0
                if self.shortest > 1:
                    key = np.where(known[:-1] & known[1:], ids[:-1] * n + ids[1:], -1)
                    at = np.flatnonzero(key >= 0)
                    ok = np.zeros(len(key), bool)
                    if len(at) and len(self.pairs):
                        k = np.minimum(np.searchsorted(self.pairs, key[at]), len(self.pairs) - 1)
                        ok[at] = self.pairs[k] == key[at]
                else:
                    ok = known
                edge = np.diff(np.concatenate([[0], ok.view(np.int8), [0]]))
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    b = b + (self.shortest > 1)  # pairs -> words
                    if b - a >= self.shortest:
                        m, f = self.hits(ids[a:b])
                        mask[a:b] |= m
                        found |= f
            out.append((mask, found))
        return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, most_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items in blocks of at most most_words words (an item alone may be longer)."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).orderBy(F.col(item_col).cast("string"), text_col).toLocalIterator():
        words = words_of(row[1])
        if block and size + len(words) > most_words:
            yield block
            block, size = [], 0
        block.append(("" if row[0] is None else row[0], words))
        size += len(words)
    yield block


def _runs(mask: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.tolist()


def _scan(docs: DataFrame, handle, with_text: bool) -> DataFrame:
    """docs(id, text, runs array<int>, items array<string>) with a block's hits added; text becomes
    null where it is not asked for, so that it need not come back from Python."""

    def over(batches):
        automaton = handle.value
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                docs = [words_of(t) for t in part.column("text").to_pylist()]
                runs, items = [], []
                for words, (mask, found), r, k in zip(docs, automaton.scan(docs), part.column("runs").to_pylist(), part.column("items").to_pylist()):
                    for a, b in zip(r[::2], r[1::2]):
                        mask[a:b] = True
                    runs.append(_runs(mask))
                    items.append(sorted({*k, *(automaton.names[i] for i in found)}))
                text = part.column("text") if with_text else pa.nulls(part.num_rows, pa.string())
                yield pa.record_batch([part.column("id"), text, pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(map(len, docs), pa.int64())], names=["id", "text", "runs", "items", "n_words"])

    return docs.mapInArrow(tidy(over), docs.select("id", "text", "runs", "items").schema.add("n_words", "long"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", most_words: int = 100_000, with_text: bool = True) -> DataFrame:
    """Per document: (id, text, runs, items, n_words); runs holds the half-open word ranges inside an
    occurrence of a window (start, end, start, end, ...), items the ids of the items it came from.

    The automaton of a block of at most most_words item words (a documented bound, about 60 MB) goes
    to every executor; a larger benchmark is gone through block by block, each pass written out. The
    documents are never shuffled.

    Null or empty texts have no words; items without words match nothing. Duplicate item ids count
    once. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("items"))
    blocks = item_blocks(benchmark, item_col, item_text_col, most_words)
    block, after = next(blocks), next(blocks, None)
    while True:
        out = _scan(out, spark.sparkContext.broadcast(SuffixAutomaton(block, window)), with_text or after is not None)
        if after is None:
            return out
        out = durable(out, "leaks").select("id", "text", "runs", "items")
        block, after = after, next(blocks, None)


def _hit_words():
    r = F.col("runs")
    return F.when(F.size(r) == 0, F.lit(0)).otherwise(F.expr("aggregate(transform(runs, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)"))


def leak_report(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.05, **options) -> DataFrame:
    """Per document (id, n_words, n_hit, n_items, items_sha256, contaminated): see find_leaks.

    contaminated: some word is hit, and at least `coverage` of the words are."""
    id_col = options.get("id_col", "doc_id")
    found = find_leaks(docs, benchmark, with_text=False, **options).withColumn("n_hit", _hit_words().cast("long"))
    times = round(1 / coverage)
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * times >= F.col("n_words"))).alias("contaminated"))


def cut_words(text: str, runs: list[int]) -> str:
    """text without the words of the runs, and without what stands between the words of one run."""
    raw = text.encode()
    spans = [m.span() for m in _SPAN.finditer(raw)]
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2]):
        out.append(raw[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.05, **options) -> DataFrame:
    """docs (all columns) without leaked test items: a document of which at least `coverage` is hit
    goes; from others the hit spans are cut, and clean documents stay as they are."""
    text_col = options.get("text_col", "text")
    names = docs.columns
    tagged = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in names]))
    found = find_leaks(tagged.select(F.col("__row").alias("__id"), F.col(text_col).alias("__text")), benchmark, **options | {"id_col": "__id", "text_col": "__text"})
    found = found.withColumn("n_hit", _hit_words()).where(~((F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / coverage) >= F.col("n_words"))))
    if docs.schema[text_col].dataType.simpleString() != "string":
        raise TypeError(f"{text_col} must be a string")

    def cut(batches):
        for b in batches:
            texts = [cut_words(t, r) if r else t for t, r in zip(b.column("text").to_pylist(), b.column("runs").to_pylist())]
            yield pa.record_batch([b.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    found = found.select("id", "text", "runs").mapInArrow(cut, found.select("id", "text").schema)
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col(f"id.`{c}`").alias(c) for c in names])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
