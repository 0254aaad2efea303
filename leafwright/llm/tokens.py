"""Token-ID output: tokenised documents in Parquet list columns, and readers of single columns of them."""

from __future__ import annotations

import json
import operator
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHES, bounded_batches, fresh_path, tidy

# The classes of the vocabulary's own splitting rule, for characters that neither normalisation nor
# lower-casing can join with their neighbours: ASCII and the accented Latin letters.
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
_PLAIN = re.compile(f"[!-~{_LETTER}]+")
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}


class _Recent(dict):
    """A dict of which at least the last `most` new or used keys stay; what a full generation leaves
    behind is looked up once more in the one before it."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.before = most, {}

    def __missing__(self, key):
        value = self[key] = self.before[key]
        return value

    def lacks(self, keys: set) -> set:
        return keys.difference(self).difference(self.before)

    def turn(self) -> None:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()


# The rules of a vocabulary that CachedTokenizer knows a short way for (fixed values).
_KNOWN_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}


class CachedTokenizer:
    """Token ids of whole texts, equal to those of the library on each text.

    A vocabulary of other rules than _KNOWN_RULES goes through the library text by text. The known rule drops white space and joins nothing across it, so a text is encoded by its
    words, and plain words by their pieces, which go straight to the library's model; each distinct one
    goes there once. Words beyond the plain letters, or with special tokens in them, go through the
    whole library. The caches hold about twice `most` entries, so memory is bounded.
    """

    def __init__(self, path: str, most: int = 80_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.known = all(rules.get(k) == v for k, v in _KNOWN_RULES.items()) and not rules["model"].get("dropout")
        self.library = Tokenizer.from_file(path)
        self.model, self.alphabet = self.library.model, _byte_letters()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special) or "\0"  # what all special tokens start with
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.packers = [struct.Struct(f"<{n}{'H' if self.kind.itemsize == 2 else 'I'}").pack for n in range(64)]
        self.words, self.pieces = _Recent(most), _Recent(most)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _learn(self, new: set[str]) -> None:
        tokenize, alphabet, pieces, pack, ident = self.model.tokenize, self.alphabet, self.pieces, self.packers, operator.attrgetter("id")
        pieces.turn()
        recent, earlier = pieces.get, pieces.before.get
        odd, words, mark = [], self.words, self.mark
        for w in new:
            if w.isalpha() and (w.isascii() or _PLAIN.fullmatch(w)):
                parts = (w.lower(),)
            elif mark in w or not _PLAIN.fullmatch(w):
                odd.append(w)
                continue
            else:
                parts = _PIECE.findall(w.lower())
            out = []
            for p in parts:
                ids = recent(p) or earlier(p)
                if ids is None:
                    found = tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(alphabet))
                    ids = pack[len(found)](*map(ident, found)) if len(found) < 64 else self._pack([t.id for t in found])
                    pieces[p] = ids
                out.append(ids)
            words[w] = out[0] if len(out) == 1 else b"".join(out)
        for w, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False)):
            self.words[w] = self._pack(e.ids)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has.

        Arrow splits the texts and numbers their distinct words; only those become Python strings."""
        if not self.known:
            found = [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*found, np.empty(0, self.kind)]), np.fromiter(map(len, found), np.int64, len(found))
        if not pc.any(pc.match_substring(texts, self.mark)).as_py():
            texts = pc.ascii_lower(texts)  # fewer distinct words; special tokens tell the cases apart
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.words.turn()
        self._learn(self.words.lacks(set(words)))
        ids = [self.words[w] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        flat, start = np.frombuffer(b"".join(ids), self.kind), np.cumsum(size) - size
        word = coded.indices.to_numpy()
        n = size[word]
        end = np.concatenate([[0], np.cumsum(n)])
        edges = split.offsets.to_numpy()
        return flat[np.repeat(start[word] - end[:-1], n) + np.arange(end[-1])], np.diff(end[edges - edges[0]])

    def encode(self, text: str) -> list[int]:
        return self.encode_array(pa.array([text]))[0].tolist()


def _tokenizer(path: str) -> CachedTokenizer:
    """Kept by the Python worker from task to task."""
    name = f"tokens:{path}"
    if name not in CACHES:
        CACHES[name] = CachedTokenizer(path)
    return CACHES[name]


def _parts(batch: pa.RecordBatch, rows: int = 2048, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of some thousand rows, with about `most` bytes of text at most (a text alone may be longer)."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
    at = 0
    while at < len(size):
        stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right"))
        stop = min(max(stop, at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
                 row_group_mb: int = 32, page_kb: int = 128) -> None:
    """Tokenises whole texts and writes them to Parquet in ascending order of id.

    Files follow each other in the order of ids (column part), and hold the columns
    id | part | offset, the ids before the document in its file | n_tokens | tokens list<int>.
    Token ids are dictionary encoded (their vocabulary fits a page of 16-bit codes), the ascending
    columns by delta; row groups and pages are bounded, and Parquet's page index lets a reader skip
    pages of one column without touching the others.

    Each text gets end_id after its last token; null counts as empty. Null ids come first. Rows that
    repeat an id are ordered by their text. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("tie", F.xxhash64("text"))
    dealt = base.repartitionByRange(F.col("id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "text")
    dealt = dealt.select("id", "text", F.spark_partition_id().alias("part"))

    def over(batches):
        encode, before = _tokenizer(tokenizer).encode_array, 0
        for batch in batches:
            for b in _parts(batch):
                ids, sizes = encode(b.column("text"))
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                flat, last = np.empty(ends[-1], np.int32), np.zeros(ends[-1], bool)
                last[ends - 1] = True
                flat[last], flat[~last] = end_id, ids
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                yield pa.record_batch([b.column("id"), b.column("part"), pa.array(before + ends - sizes), pa.array(sizes), tokens], names=["id", "part", "offset", "n_tokens", "tokens"])
                before += int(ends[-1])

    schema = dealt.select("id", "part").schema.add("offset", "long").add("n_tokens", "long").add("tokens", T.ArrayType(T.IntegerType()))
    rows = dealt.mapInArrow(tidy(over, keep=f"tokens:{tokenizer}"), schema)
    writer = rows.write.option("parquet.block.size", row_group_mb << 20).option("parquet.page.size", page_kb << 10)
    writer = writer.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 4 << 20).option("parquet.writer.version", "v2")
    for column in ("id", "offset", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("compression", "zstd").parquet(out)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, part, offset, n_tokens) and start, the ids of all documents before it. No token page is read."""
    rows = spark.read.parquet(path).select("id", "part", "offset", "n_tokens")
    return _with_start(rows, rows)


def _with_start(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows with `start`, from the sums of the files: one row a file."""
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(bases, F.col("part") == F.col("p")).withColumn("start", F.col("base") + F.col("offset")).drop("p", "base")


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """(id, tokens), of some documents only where ids are given; the filter reaches Parquet's page index."""
    rows = spark.read.parquet(path).select("id", "tokens")
    return rows if ids is None else rows.where(F.col("id").isin(ids))


def token_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: (id, start, n_tokens, ids_crc32). n_tokens counts what was read; the
    checksum is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    bounded_batches(spark)
    rows = spark.read.parquet(path)

    def over(batches):
        for b in batches:
            tokens = b.column("tokens")
            flat, at = tokens.values.to_numpy(zero_copy_only=False).astype("<u4"), tokens.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.record_batch([b.column("id"), b.column("part"), b.column("offset"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["id", "part", "offset", "n_tokens", "ids_crc32"])

    schema = rows.select("id", "part", "offset").schema.add("n_tokens", "long").add("ids_crc32", "long")
    got = rows.select("id", "part", "offset", "tokens").mapInArrow(tidy(over), schema)
    return _with_start(got, rows.select("part", "n_tokens")).select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")


def tokens_of(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as token files in the shared folder and returns what the files hold (token_digests)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return token_digests(spark, path, id_col)
