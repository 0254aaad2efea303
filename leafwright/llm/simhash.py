"""Near-duplicate detection: SimHash fingerprints, linked by tiled exact comparison.

simhash_groups links 64-bit fingerprints within a few bits, and misses none. drop_near_copies links texts of a given
similarity of their shingles (0.8 by default): for that 256 bits are compared, within the groups of a key that texts of
this similarity almost surely share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_LOWER, bounded_batches, connected_components, durable, local_components, tidy

_SMALL = 48  # rows; below it a tile of one group would be mostly empty


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """SimHash of the word shingles: a bit is 1 if it is set in over half of their XXH64 hashes."""
    words = text.encode().translate(BYTE_LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    stop = end[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, block):
        h = np.array([digest(line[a:b], seed) for a, b in zip(start[i : i + block], stop[i : i + block])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    def over(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("id"), pa.array(fp)], names=["id", "fp"])

    return docs.mapInArrow(tidy(over), docs.select("id").schema.add("fp", "long"))


def _bands(fp: F.Column, radius: int) -> F.Column:
    """Keys of which two fingerprints within the radius share at least one.

    radius + 1 blocks of bits: within the radius one block is equal, and of the rest, cut in radius + 1
    parts again, one part is. Each key names both, so it fixes about half the bits at radius 3.
    """
    k, keys = radius + 1, []
    edge = [64 * i // k for i in range(k + 1)]

    def bits(runs: list[tuple[int, int]]) -> F.Column:
        out = F.lit(0).cast("long")
        for a, b in runs:
            out = F.shiftleft(out, b - a).bitwiseOR(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        return out

    def cut(ranges: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        flat = [i for a, b in ranges for i in range(a, b)]
        parts = []
        for j in range(k):
            part = flat[len(flat) * j // k : len(flat) * (j + 1) // k]
            runs: list[tuple[int, int]] = []
            for i in part:
                if runs and runs[-1][1] == i:
                    runs[-1] = (runs[-1][0], i + 1)
                else:
                    runs.append((i, i + 1))
            parts.append(runs)
        return parts

    for i in range(k):
        block = (edge[i], edge[i + 1])
        rest = [(edge[j], edge[j + 1]) for j in range(k) if j != i]
        for j, part in enumerate(cut(rest, k)):
            keys.append(bits([block, *part]).bitwiseOR(F.lit((i * k + j) << 56)))
    return F.array(*keys)


def tile_links(fp: np.ndarray, radius: int, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join all of the fingerprints (uint64, one or a row of them) within the radius of
    each other: a spanning set of links. Tiles of rows sorted by population count are compared by
    exclusive-or and bit count; pairs of tiles whose counts differ beyond the radius are skipped."""
    fp = fp.reshape(len(fp), -1)
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    fp, ones = np.ascontiguousarray(fp[order].T), ones[order]
    n = len(ones)
    label = np.arange(n)
    for a in range(0, n, tile):
        for b in range(a, n, tile):
            if ones[b] - ones[min(a + tile, n) - 1] > radius:
                break
            apart = np.zeros((min(tile, n - a), min(tile, n - b)), np.uint16)
            for word in fp:
                apart += np.bitwise_count(word[a : a + tile, None] ^ word[None, b : b + tile])
            x, y = np.nonzero(apart <= radius)
            x, y = x + a, y + b
            new = label[x] != label[y]
            if new.any():
                label = label[local_components(n, label[x[new]], label[y[new]])]
                label = local_components(n, np.arange(n), label)
    far = np.flatnonzero(label != np.arange(n))
    return order[far], order[label[far]]


def _diagonals(key: np.ndarray, fp: np.ndarray, radius: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tiles of many small groups at once: rows sorted by (key, population count) against those s places on, as long as
    some of these are of the same group and their counts differ by no more than the radius."""
    if not len(key):
        return
    ones = np.bitwise_count(fp).reshape(len(fp), -1).sum(axis=1, dtype=np.int64)
    order = np.lexsort((ones, key))
    k, f, ones = key[order], fp[order], ones[order]
    for s in range(1, min(reach, len(k))):
        near = np.flatnonzero((k[s:] == k[:-s]) & (ones[s:] - ones[:-s] <= radius))
        if not len(near):
            return
        apart = np.bitwise_count(f[near + s] ^ f[near]).reshape(len(near), -1).sum(axis=1, dtype=np.int64)
        near = near[apart <= radius]
        yield order[near + s], order[near]


def _compare(rows: DataFrame, radius: int, node: str = "fp") -> DataFrame:
    """Links (u, v) between nodes within the groups of `key`, for rows (key, fp) or (key, node, fp) sorted by key in each
    partition; fp is a long, or the bytes of several. Groups of up to _SMALL rows go many at a time, larger ones tile by tile."""
    wide = node != "fp"

    def links(key: np.ndarray, name: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.diff(key)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        size = last - first
        of = np.repeat(size, size)
        few = np.flatnonzero((of > 1) & (of <= _SMALL))
        found = [(few[i], few[j]) for i, j in _diagonals(key[few], fp[few], radius, _SMALL)]
        for a, b in zip(first[size > _SMALL], last[size > _SMALL]):
            i, j = tile_links(fp[a:b], radius)
            found.append((i + a, j + a))
        for i, j in found:
            yield pa.record_batch([name[i], name[j]], names=["u", "v"])

    def over(batches):
        key, name, fp = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            new = batch.column("fp")
            new = np.frombuffer(b"".join(new.to_pylist()), np.uint64).reshape(len(new), -1) if wide else new.to_numpy().view(np.uint64)
            fp = new if fp is None else np.concatenate([fp, new])
            key, name = np.concatenate([key, batch.column("key").to_numpy()]), np.concatenate([name, batch.column(node).to_numpy()])
            if len(key) and key[0] != key[-1] and len(key) > 1 << 16:
                at = int(np.flatnonzero(key != key[-1])[-1]) + 1  # the last group may go on
                yield from links(key[:at], name[:at], fp[:at])
                key, name, fp = key[at:], name[at:], fp[at:]
        if len(key):
            yield from links(key, name, fp)

    return rows.select("key", *dict.fromkeys([node, "fp"])).mapInArrow(tidy(over), "u long, v long")


def _hot_links(rows: DataFrame, sizes: DataFrame, radius: int, tile: int, node: str = "fp") -> DataFrame:
    """Links within groups too large for a task. Each group is dealt into tiles by population count
    and, where one count has many rows, by hash; every pair of tiles within the radius is a task."""
    if node == "fp":
        ones = F.bit_count("fp").cast("int")
    else:
        bits = F.hex("fp")
        ones = sum((F.bit_count(F.conv(F.substring(bits, 8 * i + 1, 8), 16, 10).cast("long")) for i in range(8)), F.lit(0)).cast("int")
    rows = rows.withColumn("ones", ones)
    parts = rows.groupBy("key", "ones").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    mine = rows.join(parts, ["key", "ones"]).withColumn("part", F.pmod(F.xxhash64(node), F.col("parts")).cast("int"))
    tiles = parts.select("key", "ones", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = tiles.select("key", F.col("ones").alias("ones2"), F.col("part").alias("part2"))
    pairs = tiles.join(other, "key").where((F.col("ones2") - F.col("ones")).between(0, radius) & ((F.col("ones2") > F.col("ones")) | (F.col("part2") >= F.col("part"))))
    pairs = pairs.withColumn("pair", F.xxhash64("key", "ones", "part", "ones2", "part2"))
    a = pairs.select("key", "ones", "part", "pair")
    b = pairs.where("ones <> ones2 or part <> part2").select("key", F.col("ones2").alias("ones"), F.col("part2").alias("part"), "pair")
    dealt = mine.join(a.unionByName(b), ["key", "ones", "part"]).select(F.col("pair").alias("key"), *dict.fromkeys([node, "fp"]))
    return _compare(dealt.repartition("key").sortWithinPartitions("key"), radius, node)


def simhash_links(prints: DataFrame, radius: int = 3, hot: int = 20_000, tile: int = 4_096) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) within `radius` bits.

    Fingerprints that agree in one of (radius + 1)^2 choices of bits meet in a group and are compared
    there exactly, tile by tile; no pair within the radius is missed. Groups over `hot` rows are dealt
    into pairs of tiles, each a task of its own, so no group is cut short and none fills one task.
    """
    rows = prints.select("fp").distinct().select("fp", F.explode(_bands(F.col("fp"), radius)).alias("key"))
    big = durable(rows.groupBy("key").count().where(F.col("count") > hot), "simhash-hot")
    if big.isEmpty():
        return _compare(rows.repartition("key").sortWithinPartitions("key"), radius)
    cold = rows.join(big, "key", "left_anti")
    links = _compare(cold.repartition("key").sortWithinPartitions("key"), radius)
    return links.unionByName(_hot_links(rows.join(big.select("key"), "key", "left_semi"), big, radius, tile))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text",
                   hot: int = 20_000, tile: int = 4_096) -> DataFrame:
    """One row per input row: (id, fingerprint, component_id).

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest id that can be
    reached. Texts without words have fingerprint zero, linked like any other; null text counts as
    empty. Ids may be null (never a component_id unless the whole component has none) and may repeat.
    Copies share a fingerprint, so links are found between distinct fingerprints only. Other columns
    are ignored.
    """
    bounded_batches(docs.sparkSession)
    prints = durable(_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle), "simhash")
    nodes = connected_components(simhash_links(prints, radius, hot, tile))
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = firsts.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    best = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of = roots.join(best, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_MORE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)  # odd numbers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Sketch:
    """256 SimHash bits over the different word shingles of a text, and keys: least hashes (MinHash), `rows` to a key.

    Texts of similarity s share a key with probability 1 - (1 - s ** rows) ** bands: 0.9996 at 0.8 with 20 keys of 5. Of
    256 bits, texts of similarity s differ in about 256 acos(2 s / (1 + s)) / pi: 39 at 0.8."""

    def __init__(self, shingle: int = 5, bands: int = 20, rows: int = 5, seed: int = 42):
        self.shingle, self.bands, self.rows, self.seed = shingle, bands, rows, seed
        self.odd = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _MORE[0]) | np.uint64(1)

    def hashes(self, text: str | None) -> np.ndarray:
        words = text.encode().translate(BYTE_LOWER).split() if text else []
        n, digest = self.shingle, xxhash.xxh64_intdigest
        line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        pairs = zip((end - size).tolist(), end[min(n, len(words)) - 1 :].tolist()) if words else ()
        return np.unique(np.fromiter((digest(line[a:b], self.seed) for a, b in pairs), np.uint64))

    def of(self, text: str | None, block: int = 1 << 12) -> tuple[bytes, list[int]]:
        """(bits, keys). All texts without words are alike."""
        h = self.hashes(text)
        ones, least = np.zeros(256, np.int64), np.full(len(self.odd), np.iinfo(np.uint64).max, np.uint64)
        for part in (h[i : i + block, None] for i in range(0, len(h), block)):
            ones += np.unpackbits(_mix(part * _MORE).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
            least = np.minimum(least, _mix(part * self.odd).min(axis=0))
        band = np.zeros(self.bands, np.uint64)
        for j in range(self.rows):
            band = _mix(band * _MORE[1] + least[j :: self.rows])
        band = _mix(band + np.arange(self.bands, dtype=np.uint64))
        return np.packbits(2 * ones > len(h)).tobytes(), band.view(np.int64).tolist()

    def radius(self, similarity: float) -> int:
        """Bits in which all but a few of the pairs of this similarity differ at most: their mean and two deviations."""
        p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
        return int(256 * p + 2 * np.sqrt(256 * p * (1 - p)))


def near_texts(docs: DataFrame, similarity: float = 0.8, sketch: Sketch | None = None, hot: int = 20_000, tile: int = 4_096, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (id column unchanged, text key `th`), and the components of their distinct texts (th, root).

    th is the MD5 of the text; copies are compared once. Texts that share a key meet in a group, where their bits are
    compared tile by tile; groups over `hot` texts are dealt into pairs of tiles."""
    sketch = sketch or Sketch()
    bounded_batches(docs.sparkSession)

    def over(batches):
        for batch in batches:
            got = [sketch.of(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("th"), pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.list_(pa.int64()))], names=["th", "fp", "keys"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    sketched = docs.select(text_key(F.col(text_col)).alias("th"), text.alias("text")).mapInArrow(tidy(over), "th binary, fp binary, keys array<long>")
    texts = durable(sketched.groupBy("th").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")).withColumn("node", F.xxhash64("th")), "near-texts")
    rows = texts.select("node", "fp", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").count().where("count > 1")
    big = durable(sizes.where(F.col("count") > hot), "near-hot")
    # a key that one text alone has is no group
    meet, radius = rows.join(sizes.select("key"), "key", "left_semi"), sketch.radius(similarity)
    if big.isEmpty():
        links = _compare(meet.repartition("key").sortWithinPartitions("key"), radius, "node")
    else:
        cold = meet.join(big, "key", "left_anti")
        links = _compare(cold.repartition("key").sortWithinPartitions("key"), radius, "node").unionByName(_hot_links(rows.join(big.select("key"), "key", "left_semi"), big, radius, tile, "node"))
    nodes = connected_components(links)
    return texts, texts.select("th", "node").join(nodes, "node", "left").select("th", F.coalesce("root", "node").alias("root"))


def text_key(text: F.Column) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, sketch: Sketch | None = None, id_col: str = "doc_id", text_col: str = "text",
                     hot: int = 20_000, tile: int = 4_096) -> DataFrame:
    """docs (all columns, whatever their names) with one row of each group of near copies: that with the smallest id.

    Near copies have at least `similarity` of their word shingles (five words unless the sketch says otherwise) in common,
    after lower-casing A-Z; texts with fewer words are one shingle. Linked are pairs whose 256 bits differ by no more than
    the radius of that similarity, and groups are what links reach, so a link that is estimated wrongly may join texts of a
    lesser similarity. Null counts as empty, texts without words are copies of each other. A null id stays only if the
    whole group has none. Of rows that repeat id and text one stays, and of rows that repeat the smallest id one.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    id_, text = F.col(own[id_col]), F.col(own[text_col])
    rows = docs.toDF(*own.values())
    _, groups = near_texts(rows.select(text.alias("text")), similarity, sketch, hot, tile)
    named = rows.select(id_.alias("id"), text_key(text).alias("th")).groupBy("th").agg(F.min("id").alias("id"))
    # the first of a group: the smallest id, null last; of texts that share it the smallest key
    order = F.struct(F.col("id").isNull(), "id", "th")
    keep = named.join(groups, "th").groupBy("root").agg(F.min(order).alias("k")).select("k.id", "k.th")
    name = lambda i, t: F.md5(F.concat(F.coalesce(i.cast("string"), F.lit("null")).cast("binary"), F.lit(" ").cast("binary"), t))
    keep = keep.select(name(F.col("id"), F.col("th")).alias("k"))
    kept = rows.withColumn("k", name(id_, text_key(text))).join(keep, "k", "left_semi")
    once = Window.partitionBy("k").orderBy(F.lit(0))  # rows alike in id and text
    return kept.withColumn("nth", F.row_number().over(once)).where("nth = 1").select(*own.values()).toDF(*docs.columns)
