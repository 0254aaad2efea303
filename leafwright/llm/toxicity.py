"""Toxicity: class-conditional Kneser-Ney models of whole texts, compared by length-normalised likelihoods.

A text is a sequence of words, a word a sequence of letters between a start and an end mark. For each class k

    P_k(letter | context) = (max(n_k(context letter) - D, 0) + D kinds_k(context) P(letter | shorter context)) / n_k(context)

where the context is the word's letters before, at most order - 1 of them, and n_k counts every word of every labelled
text of the class. The shorter contexts are shared: interpolated Kneser-Ney over continuation counts (how many
different letters come before) of both classes together, so what is rare is smoothed alike for both. A letter that
neither class has seen after its context is left to these and speaks for neither.

A toxic text says ordinary words most of the time, so its model is (1 - share) P_0 + share P_1 for each word. A text is
scored by one number: the log-likelihood a word under the toxic model less that under the ordinary one; a logistic
curve makes it a score from 0 to 1.

Contexts end where words start. With the word before in the context as well, the held-out area under the curve fell
from 0.96 to 0.87 on the labelled texts of sf0.1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_batches, durable, tidy

_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The one splitter of training and scoring."""
    return _WORD.findall(text.lower()) if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """Letters of many words in one array, each with a start mark before and an end mark after it."""

    def __init__(self, words: list[str]):
        marked = ["\x02" + w + "\x03" for w in words]
        self.size = np.fromiter(map(len, marked), np.int64, len(marked))
        self.letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        starts = np.cumsum(self.size) - self.size
        self.depth = (np.arange(1, len(self.letters) + 1) - np.repeat(starts, self.size)).astype(np.int32)  # letters of the word up to here

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray]]:
        """(n, hash of the n letters that end at each place; only those with depth >= n lie in one word), n = 0 .. order."""
        yield 0, np.full(len(self.letters), 1, np.uint64)
        h = np.zeros(len(self.letters), np.uint64)
        for n in range(1, order + 1):
            back = np.zeros(len(self.letters), np.uint64)
            back[n - 1 :] = self.letters[: len(self.letters) - n + 1]
            h = _mix(h * _STEP + back + np.uint64(n))
            yield n, h


def _parts(words: list[str], order: int, most: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """All letters of the words in parts of about `most` letters: the part, which word each of its pieces is of, and
    which of its letters are spoken of here. Pieces of a longer word repeat order + 1 letters of the piece before."""
    pieces: list[tuple[int, int, bool, str]] = []
    size = 0

    def pack():
        of, lead, goes_on, text = zip(*pieces)
        w = Words(list(text))
        mine = w.depth > np.repeat(np.array(lead) + 1, w.size)  # the start mark is given, not predicted
        mine[(np.cumsum(w.size) - 1)[np.array(goes_on)]] = False
        return w, np.array(of), mine

    for i, word in enumerate(words):
        for at in range(0, max(1, len(word)), most):
            first = max(0, at - order - 1)
            pieces.append((i, at - first, at + most < len(word), word[first : at + most]))
            size += len(pieces[-1][3]) + 2
            if size >= most:
                yield pack()
                pieces, size = [], 0
    if pieces:
        yield pack()


def _before(g: np.ndarray) -> np.ndarray:
    """What stood one place before."""
    out = np.empty_like(g)
    out[1:], out[:1] = g[:-1], g[:1]
    return out


def _full_grams(w: Words, order: int) -> np.ndarray:
    """At each place the longest gram that a context may have: since the start mark, or of `order` letters."""
    full = np.zeros(len(w.letters), np.uint64)
    for n, g in w.grams(order):
        if n:
            here = np.minimum(w.depth, order) == n
            full[here] = g[here]
    return full


class Ratios:
    """log P_1 / P_0 of a letter after its context, by the hash of both; what was never counted has 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, order: int):
        at = np.argsort(keys)
        self.keys, self.values, self.order = keys[at], values[at], order

    def words(self, words: list[str], most: int = 200_000) -> np.ndarray:
        """log P_1(word) / P_0(word), of all its letters; about `most` letters at a time."""
        out = np.zeros(len(words))
        if len(self.keys):
            for w, of, mine in _parts(words, self.order, most):
                full = _full_grams(w, self.order)
                at = np.minimum(np.searchsorted(self.keys, full), len(self.keys) - 1)
                each = np.where(mine & (self.keys[at] == full), self.values[at], np.float32(0)).astype(float)
                np.add.at(out, of, np.add.reduceat(each, np.cumsum(w.size) - w.size))
        return out


def _gain(ratio, share: float):
    """log ((1 - share) P_0 + share P_1) / P_0 of a word with this log ratio."""
    return np.logaddexp(np.log1p(-share), np.log(share) + ratio)


class Toxicity:
    """The fitted models and the curve.

    ratios: the table of log ratios, broadcast; None if it is over `most_grams`, then `table` (gram, ratio) is joined.
    weights: of 1 and of the difference's level; bend: where the curve is steep."""

    def __init__(self, table: DataFrame, ratios: Broadcast | None, order: int, share: float, pad: int):
        self.table, self.ratios, self.order, self.share, self.pad = table, ratios, order, share, pad
        self.weights, self.bend = np.array([-2.0, 0.0]), (-40.0, 40.0)

    @property
    def least(self) -> float:
        """No difference is below this: that of a text which the toxic class never says."""
        return float(np.log1p(-self.share)) * (1 + 1e-6)

    def __getstate__(self):
        return self.__dict__ | {"table": None}  # tables stay with the driver

    def difference(self, total, n):
        """Log-likelihood difference a word. A text counts as `pad` words longer, words which neither class has seen, so that
        one odd word is no proof in a short text."""
        return (total + self.pad * _gain(0.0, self.share)) / (n + self.pad)

    def differences(self, texts: list[str | None], cache: dict[str, float], most: int = 200_000) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        if len(cache) > most:
            cache.clear()
        new = [w for w in {w for d in docs for w in d} if w not in cache]
        if new:
            cache.update(zip(new, _gain(self.ratios.value.words(new), self.share).tolist()))
        out = np.array([self.difference(sum(map(cache.__getitem__, d)), len(d)) for d in docs])
        for w in new:
            if len(w) > 64:  # long runs are scored whole, but hardly come again
                del cache[w]
        return out

    def level(self, x):
        """The logarithm of the difference over the least it can be, flat beyond the bounds of the curve's bend."""
        v = np.log(x - self.least)
        inside = np.clip(v, *self.bend)
        return inside + 0.1 * (v - inside)

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> None:
        """Logistic regression on the one number, by Newton's method. The curve bends between the upper quartile of ordinary
        texts and the lower one of toxic texts, where the classes meet; it rises everywhere."""
        self.weights, self.bend = np.array([-2.0, 0.0]), (-40.0, 40.0)
        if not len(y) or y.min() == y.max():
            return
        v = np.log(x - self.least)
        low, high = np.quantile(v[y == 0], 0.75), np.quantile(v[y == 1], 0.25)
        if low < high:
            self.bend = float(low), float(high)
        x = self.level(x)
        mean, scale = x.mean(), max(x.std(), 1e-9)
        a, w, penalty = np.column_stack([np.ones(len(x)), (x - mean) / scale]), np.zeros(2), np.diag([1e-6, ridge])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = np.array([w[0] - w[1] * mean / scale, w[1] / scale])


def _word_counts(texts: DataFrame) -> DataFrame:
    """texts (y, text) -> (w, a, b): how often each class says each word; all words of all texts."""

    def over(batches):
        seen: dict[str, list[int]] = {}

        def rows():
            a, b = zip(*seen.values())
            return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["w", "a", "b"])

        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                for w, n in Counter(words_of(text)).items():
                    seen.setdefault(w, [0, 0])[y] += n
            if len(seen) > 50_000:
                yield rows()
                seen = {}
        if seen:
            yield rows()

    return texts.mapInArrow(tidy(over), "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


_GRAM_SCHEMA = "n int, gram long, context long, suffix long, letter int, a long, b long"


def _grams(order: int, most: int = 1 << 20):
    """Word counts (w, a, b) -> what they count. n < 0: each full gram (of -n letters) with its counts. n > 0: each gram of
    n < order letters without a start mark, once with each letter before it. Both with the gram's context (all but its
    last letter) and suffix (all but its first)."""

    def rows(words: list[str], a: np.ndarray, b: np.ndarray):
        for w, of, mine in _parts(words, order, most):
            each = np.repeat(of, w.size)
            before = shorter = None
            for n, gram in w.grams(order):
                if n >= 2:  # the lower order n - 1 (here `shorter`), told apart by the letter before
                    at = np.flatnonzero(mine & (w.depth >= n))
                    at = at[np.unique(gram[at], return_index=True)[1]]
                    none = np.zeros(len(at), np.int64)
                    yield n - 1, shorter[at], _before(before)[at], before[at], w.letters[at - n + 1].astype(np.int32), none, none
                    at = np.flatnonzero(mine & (np.minimum(w.depth, order) == n))
                    key, k, back = np.unique(gram[at], return_index=True, return_inverse=True)
                    a_, b_ = (np.bincount(back, c[each[at]], len(key)).astype(np.int64) for c in (a, b))
                    yield -n, key, _before(shorter)[at[k]], shorter[at[k]], np.zeros(len(key), np.int32), a_, b_
                before, shorter = shorter, gram

    def over(batches):
        words, a, b, size = [], [], [], 0

        def out():
            for n, *columns in rows(words, np.concatenate(a), np.concatenate(b)):
                for i in range(0, len(columns[0]), 1 << 16):
                    part = [c[i : i + (1 << 16)] for c in columns]
                    part = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in part]
                    yield pa.record_batch([pa.array(np.full(len(part[0]), n, np.int32)), *part], names=["n", "gram", "context", "suffix", "letter", "a", "b"])

        for batch in batches:
            words += batch.column("w").to_pylist()
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            size += sum(map(len, words[len(words) - batch.num_rows :]))
            if size >= most:
                yield from out()
                words, a, b, size = [], [], [], 0
        if words:
            yield from out()

    return over


def letter_ratios(counts: DataFrame, order: int = 6, discount: float = 0.75) -> DataFrame:
    """(gram, ratio float): log P_1 / P_0 of the last letter of each full gram, from word counts (w, a, b).

    Everything is counted and smoothed by Spark, one order after the other; nothing comes to the driver but the number of
    different letters. No group is larger than the alphabet: those of a gram are the letters before it, those of a context
    the letters after it."""
    firsts = [F.first(c).alias(c) for c in ("context", "suffix")]
    grams = counts.mapInArrow(tidy(_grams(order)), _GRAM_SCHEMA).groupBy("n", "gram").agg(*firsts, F.size(F.collect_set("letter")).alias("c"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    grams = durable(grams, "toxicity-grams")
    d, lower, orders, after = F.lit(discount), None, None, Window.partitionBy("context")
    letters = max(2, grams.where("n = 1").count())
    for n in range(1, order):
        own = grams.where(F.col("n") == n).select("gram", "suffix", "c", F.sum("c").over(after).alias("total"), F.count("*").over(after).alias("kinds"))
        own = own.withColumn("q", F.lit(1.0 / letters)) if lower is None else own.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
        p = (F.greatest(F.col("c") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("q")) / F.col("total")
        lower = durable(own.select("gram", p.alias("p")), "toxicity-order")
        mine = lower.select(F.col("gram").alias("suffix"), "p")
        orders = mine if orders is None else orders.unionByName(mine)

    def of_class(c: str) -> F.Column:
        return F.when(F.col(f"t{c}") > 0, (F.greatest(F.col(c) - d, F.lit(0.0)) + d * F.col(f"k{c}") * F.col("p")) / F.col(f"t{c}")).otherwise(F.col("p"))

    totals = [x.over(after).alias(c) for c, x in zip(("ta", "tb", "ka", "kb"), (F.sum("a"), F.sum("b"), F.count_if(F.col("a") > 0), F.count_if(F.col("b") > 0)))]
    top = grams.where("n < 0").select("gram", "suffix", "a", "b", *totals).join(orders, "suffix")  # hashes of different lengths differ
    return durable(top.select("gram", (F.log(of_class("b")) - F.log(of_class("a"))).cast("float").alias("ratio")), "toxicity-ratios")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        part = [b.column("gram").to_numpy().astype("<i8").tobytes(), b.column("ratio").to_numpy().astype("<f4").tobytes()]
        yield pa.record_batch([pa.array([x], pa.binary()) for x in part], names=["grams", "ratios"])


def held_out(id_) -> F.Column:
    """crc32 of the id as text, mod 3, is 1. Null ids are never held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 6_000, order: int = 7, share: float = 0.01, pad: int = 50,
                   most_grams: int = 16_000_000, most_labels: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Fits the models on all words of all labelled rows that are not held out. Only the curve is fitted on a sample: at
    most per_class rows of each class, those of a quarter with the smallest hashes of their ids, which make no counts.

    Up to `most_grams` different grams (12 bytes each) the table of ratios is broadcast; a larger one is joined. So are more
    than `most_labels` labels. Rows without text, id or label are left out; of an id with several labels the largest counts. Without rows of both classes every
    text has the same low score.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    mine = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    mine = mine.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    picked = None
    for y in (0, 1):
        part = mine.where((F.col("y") == y) & (F.pmod("h", F.lit(4)) == 0)).orderBy("h", "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = durable(picked.select("id", "y"), "toxicity-picked")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # the sample is bounded, so it is sent to the texts
    sample = durable(texts.join(F.broadcast(picked), "id").select("text", "y"), "toxicity-train")
    mine = durable(mine.join(F.broadcast(picked.select("id")), "id", "left_anti").select("id", "y"), "toxicity-labels")
    rest = texts.join(F.broadcast(mine) if mine.count() <= most_labels else mine, "id")
    table = letter_ratios(_word_counts(rest.select("y", "text")), order)
    ratios = None
    if table.count() <= most_grams:
        pieces = [(np.frombuffer(r["grams"], "<u8"), np.frombuffer(r["ratios"], "<f4")) for r in table.mapInArrow(_packed, "grams binary, ratios binary").toLocalIterator()]
        pieces.append((np.empty(0, np.uint64), np.empty(0, np.float32)))
        ratios = spark.sparkContext.broadcast(Ratios(*(np.concatenate(x) for x in zip(*pieces)), order))
    tox = Toxicity(table, ratios, order, share, pad)
    fit = text_differences(sample, tox).select("x", "y").toArrow()  # at most per_class rows a class
    tox.calibrate(fit.column("x").to_numpy(), fit.column("y").to_numpy().astype(float))
    return tox


def text_differences(docs: DataFrame, tox: Toxicity, text_col: str = "text", keep: bool = False) -> DataFrame:
    """docs with x, the length-normalised difference, as last column; text_col goes unless it is kept.

    A table of ratios that is not broadcast meets the letters of the distinct words, and these the words of the distinct
    texts; texts that repeat, and words within a text, are counted first."""
    if tox.ratios is not None:
        at = docs.columns.index(text_col)
        schema = docs.schema if keep else docs.drop(text_col).schema
        names = [*schema.names, "x"]

        def over(batches):
            cache: dict[str, float] = {}
            for batch in batches:
                for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    x = pa.array(tox.differences(b.column(at).to_pylist(), cache), pa.float64())
                    yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if keep or i != at] + [x], names=names)

        return docs.mapInArrow(tidy(over), StructType([*schema.fields, StructField("x", DoubleType())]))

    order, share = tox.order, tox.share

    def tokens(batches):
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                c = Counter(words_of(text))
                for part in (list(c.items())[i : i + 20_000] for i in range(0, len(c), 20_000)):
                    w, n = zip(*part)
                    yield pa.record_batch([pa.array([h] * len(w)), pa.array(w), pa.array(n, pa.int64())], names=["h", "w", "n"])

    def letters(batches):
        for batch in batches:
            words = batch.column("w").to_pylist()
            for w, of, mine in _parts(words, order, 200_000):
                at = np.flatnonzero(mine)
                each = np.repeat(of, w.size)[at]
                yield pa.record_batch([pa.array([words[i] for i in each]), pa.array(_full_grams(w, order)[at].view(np.int64))], names=["w", "gram"])

    def gains(batches):
        for b in batches:
            yield pa.record_batch([b.column("w"), pa.array(_gain(b.column("r").to_numpy(), share))], names=["w", "gain"])

    keyed = docs.withColumn("__h", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    said = durable(keyed.groupBy(F.col("__h").alias("h")).agg(F.first(F.col(text_col), ignorenulls=True).alias("text")).mapInArrow(tokens, "h string, w string, n long"), "toxicity-words")
    ratio = said.select("w").distinct().mapInArrow(letters, "w string, gram long").join(tox.table, "gram", "left").groupBy("w").agg(F.sum(F.coalesce("ratio", F.lit(0.0)).cast("double")).alias("r"))
    sums = said.join(ratio.mapInArrow(gains, "w string, gain double"), "w").groupBy("h").agg(F.sum(F.col("n") * F.col("gain")).alias("total"), F.sum("n").alias("n"))
    total, n = F.coalesce("__total", F.lit(0.0)), F.coalesce("__n", F.lit(0))
    padded = (total + F.lit(float(tox.pad * _gain(0.0, share)))) / (n + tox.pad)
    out = keyed.join(sums.select(F.col("h").alias("__h"), F.col("total").alias("__total"), F.col("n").alias("__n")), "__h", "left")
    return out.select(*[F.col(c) for c in docs.columns if keep or c != text_col], padded.alias("x"))


def _curve(tox: Toxicity) -> F.Column:
    a, b = (float(w) for w in tox.weights)
    low, high = (F.lit(float(e)) for e in tox.bend)
    v = F.log(F.col("x") - tox.least)
    inside = F.least(F.greatest(v, low), high)
    return 1 / (1 + F.exp(-F.greatest(F.least(a + b * (inside + 0.1 * (v - inside)), F.lit(30.0)), F.lit(-30.0))))


def score_toxicity(docs: DataFrame, tox: Toxicity, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, held_out, score, predicted). Only the text is scored, all of it.

    Null and empty texts are scored as texts without words. Ids may be null or repeat, and rows that repeat have the same
    score. Other columns are ignored. With a broadcast table of ratios documents are not shuffled.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = text_differences(base, tox).select("id", "held_out", _curve(tox).alias("score"))
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, tox: Toxicity, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs (all columns, whatever their names) without those whose score reaches the threshold. Null and empty texts are
    scored as texts without words; rows that repeat fare alike."""
    bounded_batches(docs.sparkSession)
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    scored = text_differences(docs.toDF(*own.values()), tox, own[text_col], keep=True).where(_curve(tox) < threshold)
    return scored.select(*own.values()).toDF(*docs.columns)
