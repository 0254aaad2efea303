"""WARC archives with a two-level capture index: sorted keys in compressed blocks, and a sparse directory."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh_path

_EXACT = "X-Target-URI-Encoded"
_SALTS = 32
_SAFE = ":/?#[]@!$&()*+,;=%~'"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels in reverse, then path and query: com,example,www)/a?b. Scheme, user,
    port, fragment and letter case of the host are left out; a null URL has the key )/."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rest = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _plain(url: str) -> bool:
    """Can the URL stand in a header line as it is?"""
    return url.isprintable() and url == url.strip() and url != ""


def record(kind: str, id_: str, url: str, digest: str, payload: bytes | None, size: int, refers: str | None, date: str) -> bytes:
    """One gzip member holding one WARC record. A revisit has the HTTP head of its payload but not the payload. The target
    is the URL as it is; one that a header line cannot hold is percent-encoded as a whole in a line of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{id_}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {url}"] if _plain(url) else [f"WARC-Target-URI: {quote(url, safe=_SAFE)}", f"{_EXACT}: {quote(url, safe='')}"]
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """The fields of a record: type, id, url, digest, size (of the full payload), refers, payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(lines["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    urn = re.compile("<urn:page:(.*)>")
    refers = lines.get("WARC-Refers-To")
    return {"type": lines["WARC-Type"], "id": urn.fullmatch(lines["WARC-Record-ID"])[1], "url": unquote(lines[_EXACT]) if _EXACT in lines else lines["WARC-Target-URI"],
            "digest": lines["WARC-Payload-Digest"].removeprefix("sha256:"), "size": size,
            "refers": urn.fullmatch(refers)[1] if refers else None, "payload": payload}


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Out:
    """Files written one after the other, each named anew so that a repeated task harms none."""

    def __init__(self, uri: str, suffix: str, most: int):
        self.fs, self.root = _store(uri)
        self.suffix, self.most, self.file, self.name, self.at = suffix, most, None, "", 0
        self.fs.create_dir(self.root, recursive=True)

    def put(self, data: bytes) -> tuple[str, int]:
        if self.file is None or self.at > self.most:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.file = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        at = self.at
        self.file.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class _Ranges:
    """Range reads; the last few files stay open."""

    def __init__(self, uri: str, most: int = 32):
        self.fs, self.root = _store(uri)
        self.most, self.open = most, {}

    def get(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, offset)


def write_archive(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least: int = 100, date: str = "1970-01-01T00:00:00Z", block: int = 500, file_mb: int = 512,
                  most_copies: int = 500_000) -> DataFrame:
    """Writes a record per row and the index of all captures; returns the directory.

    Of rows with equal payloads of at least `least` bytes, those with the smallest id are responses, the
    others revisits of it. The directory has a row per index block: (first_key, last_key, file, offset,
    length, n). The payloads that have copies, a digest each, are broadcast up to `most_copies`. Only files that it or an index block names count; what a lost task wrote is never read.

    Null html is an empty payload, a null URL an empty one. Rows with a null id are responses or refer to
    the smallest id there is. Rows that repeat an id are written as often. Other columns are ignored.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("n_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        url_key(F.col(url_col)).alias("key"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("n_id").alias("first"), F.count("*").alias("n"))
    first = durable(first.where("n > 1 and first is not null").select(F.col("digest").alias("d"), "first"), "warc-copies")
    if first.limit(most_copies + 1).count() <= most_copies:
        rows = rows.join(F.broadcast(first), F.col("digest") == F.col("d"), "left")
    else:  # payloads of one digest are dealt over several tasks
        salt = F.pmod(F.xxhash64("id", "url"), F.lit(_SALTS)).cast("int")
        salted = first.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        rows = rows.withColumn("salt", salt).join(salted, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("n_id")), F.col("first").cast("string"))
    rows = rows.select("key", "id", "url", "digest", "size", refers.alias("refers"), F.when(refers.isNull(), F.col("html")).alias("html"))

    def write(batches) -> Iterator[pa.RecordBatch]:
        out = _Out(f"{uri}/archive", ".warc.gz", file_mb << 20)
        kept: list[tuple] = []
        for b in batches:
            for r in b.to_pylist():
                data = record("response" if r["refers"] is None else "revisit", r["id"] or "", r["url"], r["digest"], r["html"], r["size"], r["refers"], date)
                kept.append((r["key"], *out.put(data), len(data)))
            if len(kept) >= 10_000:
                yield _rows(kept, "key", "file", "offset", "length")
                kept = []
        out.close()
        if kept:
            yield _rows(kept, "key", "file", "offset", "length")

    captures = durable(rows.mapInArrow(write, "key string, file string, offset long, length long"), "warc-captures")
    ordered = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def index(batches) -> Iterator[pa.RecordBatch]:
        out, lines, done = _Out(f"{uri}/index", ".cdx.z", file_mb << 20), [], []

        def flush(part: list[tuple]) -> None:
            data = zlib.compress("\n".join(f"{quote(k, safe=',)/?=&:;+')} {f} {o} {n}" for k, f, o, n in part).encode())
            done.append((part[0][0], part[-1][0], *out.put(data), len(data), len(part)))

        for b in batches:
            lines += zip(*(c.to_pylist() for c in b.columns))
            while len(lines) >= block:
                flush(lines[:block])
                lines = lines[block:]
        if lines:
            flush(lines)
        out.close()
        if done:
            yield _rows(done, "first_key", "last_key", "file", "offset", "length", "n")

    return durable(ordered.mapInArrow(index, "first_key string, last_key string, file string, offset long, length long, n long"), "warc-directory")


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in zip(*rows)], names=list(names))


def _entries(block: bytes) -> list[tuple[str, str, int, int]]:
    lines = (x.split(" ") for x in zlib.decompress(block).decode().split("\n"))
    return [(unquote(k), f, int(o), int(n)) for k, f, o, n in lines]


_RECORD = "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def _records(records: _Ranges, found: list[tuple[str, int, int]], part: int = 250) -> Iterator[pa.RecordBatch]:
    """The records at these places, in the order of their files; the digest of every payload that is there is checked."""
    found = sorted(found)
    for i in range(0, len(found), part):
        got = [parse(records.get(*x)) for x in found[i : i + part]]
        for r in got:
            if r["type"] == "response" and (hashlib.sha256(r["payload"]).hexdigest() != r["digest"] or len(r["payload"]) != r["size"]):
                raise ValueError(f"the payload of {r['id']} is damaged")
        yield pa.record_batch([pa.array([r[k] if k != "payload" or r["type"] == "response" else None for r in got], t) for k, t in
                               (("id", pa.string()), ("url", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("refers", pa.string()), ("payload", pa.binary()))],
                              names=["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])


def _of_key(entries: list[tuple[str, str, int, int]], key: str) -> list[tuple[str, int, int]]:
    """Binary search of a block: the places of the captures of a key."""
    i = j = bisect_left(entries, (key,))
    while j < len(entries) and entries[j][0] == key:
        j += 1
    return [e[1:] for e in entries[i:j]]


def read_archive(directory: DataFrame, uri: str) -> DataFrame:
    """All captures, block after block of the index: (id, url, record_type, payload_bytes, payload_digest, refers_to, payload)."""

    def over(batches):
        blocks, records = _Ranges(f"{uri}/index"), _Ranges(f"{uri}/archive")
        for b in batches:
            for row in b.to_pylist():
                yield from _records(records, [x[1:] for x in _entries(blocks.get(row["file"], row["offset"], row["length"]))])

    spread = directory.repartition(max(8, int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(over, _RECORD)


class Directory:
    """Rows of the directory in the order of their keys, for binary search."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.first, self.last = [r["first_key"] for r in rows], [r["last_key"] for r in rows]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that may have the key."""
        for i in range(bisect_left(self.last, key), len(self.rows)):
            if self.first[i] > key:
                return
            yield self.rows[i]["file"], self.rows[i]["offset"], self.rows[i]["length"]


def _directories(directory: DataFrame, most: int) -> Iterator[Directory]:
    """The directory in pieces of at most `most` blocks, in order."""
    rows = []
    for r in directory.orderBy("last_key", "first_key", "file", "offset").toLocalIterator():
        rows.append(r.asDict())
        if len(rows) == most:
            yield Directory(rows)
            rows = []
    if rows:
        yield Directory(rows)


def find_captures(keys: DataFrame, directory: DataFrame, uri: str, key_col: str = "key", most: int = 500_000) -> DataFrame:
    """All captures of the keys (see url_key; repeated keys count once): columns as read_archive, and the key.

    The directory, a row for a block of captures, is broadcast and binary-searched for every key; one of over `most` blocks
    goes in pieces, each a pass over the keys. Then each block is read once, by whichever task has it, and searched for
    its keys, so a key with very many captures is spread over its blocks. Null keys find nothing."""
    spark, places = keys.sparkSession, None
    wanted = keys.select(F.col(key_col).alias("key")).where("key is not null").distinct()
    for piece in _directories(directory, most):
        handle = spark.sparkContext.broadcast(piece)

        def search(batches, handle=handle) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(k, *x) for k in b.column("key").to_pylist() for x in handle.value.blocks(k)]
                for i in range(0, len(rows), 10_000):
                    yield _rows(rows[i : i + 10_000], "key", "file", "offset", "length")

        part = wanted.mapInArrow(search, "key string, file string, offset long, length long")
        places = part if places is None else places.unionByName(part)
    if places is None:
        places = wanted.limit(0).selectExpr("key", "'' AS file", "0L AS offset", "0L AS length")

    def read(batches) -> Iterator[pa.RecordBatch]:
        blocks, records = _Ranges(f"{uri}/index"), _Ranges(f"{uri}/archive")
        at, entries = None, []
        for b in batches:
            for r in b.to_pylist():
                if (r["file"], r["offset"]) != at:
                    at, entries = (r["file"], r["offset"]), _entries(blocks.get(r["file"], r["offset"], r["length"]))
                for got in _records(records, _of_key(entries, r["key"])):
                    yield got.append_column("key", pa.array([r["key"]] * got.num_rows, pa.string()))

    # a place is a few bytes but stands for a record, so Spark must not put small partitions together
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), directory.count() // 20)
    dealt = durable(places, "warc-places").repartition(tasks, "file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(_joined(read), f"{_RECORD}, key string")


def _joined(over, rows: int = 250):
    """Small record batches of `over` put together."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in over(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


class Lookup:
    """Point lookups on the driver, for a directory of at most `most` blocks; find_captures has no such bound."""

    def __init__(self, directory: DataFrame, uri: str, most: int = 1_000_000):
        if directory.limit(most + 1).count() > most:
            raise ValueError(f"the directory has over {most} blocks")
        self.directory = next(_directories(directory, most), Directory([]))
        self.index, self.records = _Ranges(f"{uri}/index"), _Ranges(f"{uri}/archive")

    def captures(self, key: str) -> list[dict]:
        """All records with this key (see url_key)."""
        return [parse(self.records.get(*x)) for block in self.directory.blocks(key) for x in _of_key(_entries(self.index.get(*block)), key)]


def archive_round_trip(pages: DataFrame, spark: SparkSession | None = None, **options) -> DataFrame:
    """Writes the archive of pages into the shared folder and looks every URL up in it: (id, payload_bytes, payload_digest,
    record_type, refers_to) of what the index finds and the archive holds."""
    spark = spark or pages.sparkSession
    uri, id_col = fresh_path(spark, "warc"), options.get("id_col", "page_id")
    kind = pages.schema[id_col].dataType
    directory = write_archive(pages, uri, **options)
    got = find_captures(pages.select(url_key(F.col(options.get("url_col", "url"))).alias("key")), directory, uri)
    return got.select(F.when(F.col("id") != "", F.col("id")).cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
