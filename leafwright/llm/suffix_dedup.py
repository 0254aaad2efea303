"""Removal of repeated passages: every byte inside a 50-byte string that an earlier document has too.

The suffixes of the corpus are dealt out by anchors. Of the k-byte strings inside a window of `length`
bytes, the one with the smallest hash is the window's anchor, so equal windows have equal anchors at
equal places, and only about one position in fourteen is an anchor. Anchors that one document alone has
cannot lie in a repeated passage. For the others, the bytes that their windows span (a context) meet in
one task, where the suffixes that start equally far before the anchor are sorted: a merge sort whose
comparisons find the common extension of two suffixes by prefix polynomial hashes and binary search.
Neighbours that agree for `length` bytes are equal windows, checked byte by byte; the smallest document
of a run of equal windows owns them, and all others lose them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20  # bytes of text gone through at a time
_PLACE = np.uint64((1 << 21) - 1)
_SLICE = 1 << 14  # anchors, or contexts with their bytes, looked at together
_NONE = np.iinfo(np.int64).max  # stands for a null id: later than all others


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_BASE, 3 * _PIECE), _powers(_INVERSE, 3 * _PIECE)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Rule:
    """What all steps agree on. buckets: of anchors; groups: of documents."""

    def __init__(self, length: int, anchor: int, buckets: int, groups: int, hot: int):
        self.length, self.k, self.w = length, anchor, length - anchor + 1
        self.buckets, self.groups, self.hot = buckets, groups, hot
        self.span = length + self.w - 1  # longest context

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h & np.uint64(0xFFFFFF)) * np.uint64(self.buckets) >> np.uint64(24)).astype(np.int64)

    @staticmethod
    def tag(h: np.ndarray) -> np.ndarray:
        """The 40 bits by which anchors of a bucket are told apart."""
        return h >> np.uint64(24)

    def anchors(self, buf: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each run of windows with one anchor: hash of the anchor, first and last window, place of
        the anchor, and the prefix hashes of buf."""
        n = len(buf)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(buf * _POW[:n], out=prefix[1:])
        if n < self.length:
            e = np.empty(0, np.int64)
            return e.astype(np.uint64), e, e, e, prefix
        gram = _mix((prefix[self.k :] - prefix[: n - self.k + 1]) * _INV[: n - self.k + 1])
        least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
        span = 1
        while 2 * span <= self.w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        count = n - self.length + 1
        least = np.minimum(least[:count], least[self.w - span : self.w - span + count])
        at = (least & _PLACE).astype(np.int64)
        inside = segment[:count] == segment[self.length - 1 :]
        new = np.ones(count, bool)
        new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        ends = np.flatnonzero(np.concatenate([new[1:] | ~inside[1:], [True]]) & inside)
        return gram[at[first]], first, ends, at[first], prefix


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The texts in buffers of about _PIECE bytes, never more than _PLACE can number: bytes, segment of each byte, and the row and place of
    each segment. A longer text comes in several segments that share length - 1 bytes."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def pack():
        lens = np.fromiter((len(p[2]) for p in parts), np.int64, len(parts))
        buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        return buf, np.repeat(np.arange(len(parts)), lens), np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.cumsum(lens) - lens

    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), _PIECE):
            part = text[at : at + _PIECE + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > int(_PLACE):
                yield pack()
                parts, size = [], 0
            parts.append((row, at, part))
            size += len(part)
            if size >= _PIECE:
                yield pack()
                parts, size = [], 0
    if parts:
        yield pack()


def _pack40(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _encoded(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _anchor_rows(rule: Rule):
    """Per input batch and bucket: the anchors' tags, the groups of their documents, and in how many documents (255 at
    most) the batch has each of them in each group."""

    def over(batches):
        for batch in batches:
            for b in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                group, found = b.column("g").to_numpy(), []
                for buf, segment, row, _, _ in _pieces(_encoded(b.column("text")), rule.length):
                    h, first, _, _, _ = rule.anchors(buf, segment)
                    found.append((h, row[segment[first]]))
                if not found:
                    continue
                h, row = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, g = h[once], group[row[once]]
                order = np.lexsort((g, h))
                h, g = h[order], g[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                first = np.flatnonzero(first)
                n = np.minimum(np.diff(np.concatenate([first, [len(h)]])), 255).astype(np.uint8)
                h, g = h[first], g[first]
                bucket = rule.bucket(h)
                order = np.argsort(bucket, kind="stable")
                h, g, n, bucket = h[order], g[order], n[order], bucket[order]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]])
                yield pa.record_batch([
                    pa.array(bucket[cut[:-1]].astype(np.int32)),
                    pa.array([_pack40(rule.tag(h[i:j])) for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([g[i:j].astype("<u2" if rule.groups < 65536 else "<u4").tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([n[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], names=["bucket", "tags", "gs", "ns"])

    return over


def _shared(rule: Rule):
    """Of a bucket, for each group the anchors that two documents have; those of over rule.hot documents are marked."""

    def over(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        h = np.concatenate([_unpack40(x) for x in table.column("tags").to_pylist()])
        g = np.concatenate([np.frombuffer(x, "<u2" if rule.groups < 65536 else "<u4") for x in table.column("gs").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("ns").to_pylist()]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, g, n = h[order], g[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.repeat(np.add.reduceat(n, start), np.diff(np.concatenate([start, [len(h)]])))
        many, hot = size > 1, size > rule.hot
        h, g, hot = h[many], g[many], hot[many]
        order = np.lexsort((h, g))
        h, g, hot = h[order], g[order], hot[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        h, g, hot = h[once], g[once], hot[once]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(h)]]) if len(h) else np.zeros(1, int)
        return pa.table({
            "g": pa.array(g[cut[:-1]].astype(np.int32)), "bucket": pa.array(np.full(len(cut) - 1, bucket, np.int32)),
            "tags": pa.array([_pack40(h[i:j]) for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
            "hot": pa.array([np.packbits(hot[i:j]).tobytes() if hot[i:j].any() else b"" for i, j in zip(cut[:-1], cut[1:])], pa.binary())})

    return over


class _Contexts:
    """The contexts of a group's documents, and which of them are equal.

    The texts stand one behind the other, a byte apart. Instances: at (place of the first window there),
    windows, context. Distinct contexts: tag, size, off (of the anchor), first (place of its first instance),
    least (smallest id that has it). The order of both depends on nothing but the documents. Hot anchors have
    an instance a byte of text, so contexts are no more than places, and bytes are looked at _SLICE at a time."""

    def __init__(self, rule: Rule, docs: pa.Table, shared: pa.Table):
        ids, texts = docs.column("id").fill_null(_NONE).to_numpy(), _encoded(docs.column("text"))
        rows = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.texts = ids[rows], [texts[i] for i in rows]
        lens = np.fromiter(map(len, self.texts), np.int64, len(rows))
        self.starts = np.cumsum(lens + 1) - lens - 1
        joined = np.frombuffer(b"\0".join([*self.texts, bytes(rule.span)]), np.uint8)
        self.view = np.lib.stride_tricks.sliding_window_view(joined, rule.span)
        self.step = np.arange(rule.span)
        keys, hot = [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for b, t, x in zip(shared.column("bucket").to_pylist(), shared.column("tags").to_pylist(), shared.column("hot").to_pylist()):
            if t:
                tags = _unpack40(t)
                keys.append(tags * np.uint64(rule.buckets) + np.uint64(b))
                hot.append(np.unpackbits(np.frombuffer(x, np.uint8), count=len(tags)).astype(bool) if x else np.zeros(len(tags), bool))
        key, hot = np.concatenate(keys), np.concatenate(hot)
        order = np.argsort(key)
        key, hot = key[order], hot[order]
        place_type = np.int32 if len(joined) < 1 << 31 else np.int64
        e = np.empty(0, np.int64)
        instances = [(e.astype(place_type), e.astype(np.uint8), e.astype(np.int32))]
        found = [(e.astype(np.uint64), e.astype(np.uint64), e.astype(place_type), e.astype(np.uint8), e.astype(np.uint8))]
        n = 0
        for buf, segment, row, place, start in _pieces(self.texts, rule.length) if len(key) else ():
            h, first, last, at, prefix = rule.anchors(buf, segment)
            mine = rule.tag(h) * np.uint64(rule.buckets) + rule.bucket(h).astype(np.uint64)
            k = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            ok = np.flatnonzero(key[k] == mine)
            shift = self.starts[row] + place - start
            for part in (ok[i : i + _SLICE] for i in range(0, len(ok), _SLICE)):
                some = self._windows(rule, h[part], first[part], last[part], at[part], hot[k[part]], prefix)
                some = *some[:2], (some[2] + shift[segment[some[2]]]).astype(place_type), *some[3:]
                context, own = self._equal(*some)
                instances.append((some[2], some[3] - np.uint8(rule.length - 1), context + np.int32(n)))
                found.append(tuple(x[own] for x in some))
                n += len(own)
        self.at, self.windows, context = (np.concatenate(x) for x in zip(*instances))
        del instances
        found = [np.concatenate(x) for x in zip(*found)]
        of, own = self._equal(*found)
        self.context = of[context]
        self.h, _, self.first, self.size, self.off = (x[own] for x in found)
        self.least = self.ids[self.rows(self.first)]  # texts come by id

    @staticmethod
    def _windows(rule: Rule, h, first, last, at, hot, prefix) -> tuple[np.ndarray, ...]:
        """Hash of the anchor and of the whole, first window, size and place of the anchor inside."""
        if hot.any():  # windows of hot anchors are dealt out one by one, by their own hash
            n = (last - first + 1)[hot]
            f = np.repeat(first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = _mix((prefix[f + rule.length] - prefix[f]) * _INV[f] + np.uint64(1))
            h, first, last, at = (np.concatenate([x[~hot], y]) for x, y in ((h, own), (first, f), (last, f), (at, f)))
        size = last - first + rule.length
        own = _mix((prefix[first + size] - prefix[first]) * _INV[first] + (size * 256 + at - first).astype(np.uint64))
        return h, own, first, size.astype(np.uint8), (at - first).astype(np.uint8)

    def _equal(self, h, own, at, size, off) -> tuple[np.ndarray, np.ndarray]:
        """A number for each row, the same for equal contexts, and the first row of each number. Equal hashes are checked by bytes."""
        order = np.lexsort((own, h))
        a, b = order[:-1], order[1:]
        same = (h[b] == h[a]) & (own[b] == own[a]) & (size[b] == size[a]) & (off[b] == off[a])
        i = np.flatnonzero(same)
        for part in (i[k : k + _SLICE] for k in range(0, len(i), _SLICE)):
            x, y = order[part], order[part + 1]
            like = self.view[at[x]] == self.view[at[y]]
            same[part] = (like | (self.step >= size[x, None])).all(axis=1)
        new = np.ones(len(order), bool)
        new[1:] = ~same
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        return number, order[new]

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The texts that the places are in."""
        return np.searchsorted(self.starts, at, "right") - 1

    def bodies(self, contexts: np.ndarray) -> bytes:
        return self.view[self.first[contexts]][self.step < self.size[contexts, None]].tobytes()


def _starts(h, own, size, off, body) -> np.ndarray:
    """Where a run of equal contexts starts, in rows sorted by hash. Equal hashes are checked by bytes."""
    new = np.ones(len(h), bool)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (own[1:] == own[:-1]) & (size[1:] == size[:-1]) & (off[1:] == off[:-1])
        i = np.flatnonzero(same)
        same[i] = (body[i + 1] == body[i]).all(axis=1)
        new[1:] = ~same
    return new


def _context_rows(rule: Rule):
    """Cogrouped documents and shared anchors of a group -> its distinct contexts, by bucket."""

    def over(docs: pa.Table, shared: pa.Table) -> pa.Table:
        c = _Contexts(rule, docs, shared) if docs.num_rows and shared.num_rows else None
        buckets, blobs = [], []
        g = (docs if docs.num_rows else shared).column("g")[0].as_py()
        if c is not None and len(c.h):
            bucket = rule.bucket(c.h)
            order = np.argsort(bucket, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
            pack = zstandard.ZstdCompressor(level=1)
            for i, j in zip(cut[:-1], cut[1:]):
                o = order[i:j]
                raw = b"".join([np.array([len(o)], "<u4").tobytes(), _pack40(rule.tag(c.h[o])), o.astype("<u4").tobytes(), c.size[o].tobytes(),
                                c.off[o].tobytes(), c.least[o].astype("<i8").tobytes(), c.bodies(o)])
                buckets.append(int(bucket[order[i]]))
                blobs.append(pack.compress(raw))
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "g": pa.array([g] * len(buckets), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return over


def _unpack(rule: Rule, blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = int(np.frombuffer(raw, "<u4", 1)[0]), 4
    tag, at = _unpack40(raw[at : at + 5 * n]), at + 5 * n
    index, at = np.frombuffer(raw, "<u4", n, at).astype(np.int64), at + 4 * n
    size, at = np.frombuffer(raw, np.uint8, n, at).astype(np.int64), at + n
    off, at = np.frombuffer(raw, np.uint8, n, at).astype(np.int64), at + n
    least, at = np.frombuffer(raw, "<i8", n, at), at + 8 * n
    body = np.zeros((n, rule.span), np.uint8)
    body[np.arange(rule.span) < size[:, None]] = np.frombuffer(raw, np.uint8, offset=at)
    return tag, index, size, off, least, body


class Suffixes:
    """Suffixes of some byte strings (rows of body), compared over `length` bytes by prefix hashes."""

    def __init__(self, body: np.ndarray, row: np.ndarray, start: np.ndarray, length: int):
        self.body, self.row, self.start, self.length = body, row, start, length
        self.prefix = np.zeros((len(body), body.shape[1] + 1), np.uint64)
        np.cumsum(body * _POW[: body.shape[1]], axis=1, out=self.prefix[:, 1:])
        self.head = self.prefix[row, start]
        self.turn = _INV[start]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a[i] and b[i], at most `length`, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length + 1)
        ra, rb, sa, sb = self.row[a], self.row[b], self.start[a], self.start[b]
        ha, hb, ta, tb = self.head[a], self.head[b], self.turn[a], self.turn[b]
        while True:
            open_ = high - low > 1
            if not open_.any():
                return low
            mid = (low + high) // 2
            same = (self.prefix[ra, sa + mid] - ha) * ta == (self.prefix[rb, sb + mid] - hb) * tb
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid, high)

    def less(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """suffix a[i] < suffix b[i]; equal ones count as ties says."""
        n = self.common(a, b)
        at = np.minimum(n, self.length - 1)
        x, y = self.body[self.row[a], self.start[a] + at], self.body[self.row[b], self.start[b] + at]
        return np.where(n >= self.length, ties, x < y)

    def sort(self, segment: np.ndarray) -> np.ndarray:
        """Merge sort of the suffixes within runs of equal segment, all runs at once."""
        n = len(self.row)
        order = np.arange(n)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [n]])
        size = np.diff(cut)
        base, end = np.repeat(cut[:-1], size), np.repeat(cut[1:], size)
        at, width = np.arange(n) - base, 1
        while width < size.max(initial=0):
            right = (at // width) % 2 == 1
            own = base + at // width * width  # where the run of each place starts
            low0 = np.where(right, own - width, own + width)
            active = np.flatnonzero(low0 < end)
            low = low0[active]
            high = np.minimum(low + width, end[active])
            floor, me, late = low.copy(), order[active], right[active]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                before = self.less(order[mid], me[open_], late[open_])  # the left run's come first in ties
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
            place = np.arange(n)
            place[active] = np.where(late, own[active] - width, own[active]) + (active - own[active]) + (low - floor)
            merged = order.copy()
            merged[place] = order
            order, width = merged, 2 * width
        return order

    def equal_runs(self, segment: np.ndarray) -> np.ndarray:
        """A number for each suffix, the same for equal ones of a segment. Neighbours that the hashes hold
        equal are compared byte by byte; should a collision show, plain sorting of the bytes decides."""
        order = self.sort(segment)
        new = np.ones(len(order), bool)
        a, b = order[:-1], order[1:]
        i = np.flatnonzero(segment[a] == segment[b])
        like = self.common(a[i], b[i]) >= self.length
        i = i[like]
        place = self.row * self.body.shape[1] + self.start
        view = np.lib.stride_tricks.sliding_window_view(self.body.ravel(), self.length)
        for part in (i[k : k + 4 * _SLICE] for k in range(0, len(i), 4 * _SLICE)):
            if not (view[place[a[part]]] == view[place[b[part]]]).all():
                window = np.concatenate([segment.astype(">u4").view(np.uint8).reshape(-1, 4), view[place]], axis=1)
                return np.unique(np.ascontiguousarray(window).view(f"V{window.shape[1]}").ravel(), return_inverse=True)[1]
        new[i + 1] = False
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new) - 1
        return out


def _owned_earlier(rule: Rule, tag, size, off, least, body) -> np.ndarray:
    """For distinct contexts sorted by tag: as bits, which windows a context with a smaller id has."""
    mask = np.zeros(len(tag), np.uint64)
    edge = np.concatenate([[0], np.flatnonzero(tag[1:] != tag[:-1]) + 1, [len(tag)]]) if len(tag) else np.zeros(1, int)
    several = np.flatnonzero(np.diff(edge) > 1)
    at = 0
    while at < len(several):  # whole anchors, some ten thousand contexts at a time
        stop = at + 1
        while stop < len(several) and edge[several[stop] + 1] - edge[several[at]] < 30_000:
            stop += 1
        rows = np.concatenate([np.arange(edge[s], edge[s + 1]) for s in several[at:stop]])
        n = size[rows] - rule.length + 1
        row = np.repeat(np.arange(len(rows)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # suffixes of one anchor that start equally far before it
        seg = np.cumsum(np.concatenate([[0], tag[rows][1:] != tag[rows][:-1]]))[row] * (rule.span + 1) + off[rows][row] - start + rule.span
        order = np.argsort(seg, kind="stable")
        row, start, seg = row[order], start[order], seg[order]
        run = Suffixes(body[rows], row, start, rule.length).equal_runs(seg)
        owner = np.full(run.max() + 1, _NONE)
        np.minimum.at(owner, run, least[rows][row])
        lost = owner[run] < least[rows][row]
        np.bitwise_or.at(mask, rows[row[lost]], np.uint64(1) << start[lost].astype(np.uint64))
        at = stop
    return mask


def _resolve(rule: Rule):
    """The contexts of a bucket -> for each group, which windows of its contexts an earlier document has."""

    def over(table: pa.Table) -> pa.Table:
        parts = [_unpack(rule, b) for b in table.column("blob").to_pylist()]
        g = np.repeat(table.column("g").to_numpy(), [len(p[0]) for p in parts])
        tag, index, size, off, least, body = (np.concatenate(x) for x in zip(*parts))
        own = np.zeros(len(tag), np.uint64)
        for j in range(rule.span):
            own += body[:, j] * _POW[j]
        order = np.lexsort((least, off, size, own, tag))
        g, tag, index, size, off, least, body, own = (x[order] for x in (g, tag, index, size, off, least, body, own))
        first = np.flatnonzero(_starts(tag, own, size, off, body))
        same = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(tag)]])))
        mask = _owned_earlier(rule, tag[first], size[first], off[first], least[first], body[first])[same]
        full = (np.uint64(1) << (size - rule.length + 1).astype(np.uint64)) - np.uint64(1)
        mask = np.where(least > least[first][same], full, mask)  # first: the smallest id of equal contexts
        some = np.flatnonzero(mask)
        some = some[np.lexsort((index[some], g[some]))]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(g[some])) + 1, [len(some)]]) if len(some) else np.zeros(1, int)
        blobs = [zstandard.compress(index[some[i:j]].astype("<u4").tobytes() + mask[some[i:j]].astype("<u8").tobytes(), 1) for i, j in zip(cut[:-1], cut[1:])]
        return pa.table({"g": pa.array(g[some[cut[:-1]]].astype(np.int32)), "masks": pa.array(blobs, pa.binary())})

    return over


def _removed(rule: Rule, docs: pa.Table, side: pa.Table) -> tuple[_Contexts, list[np.ndarray]]:
    """The documents of a group in order, and for each the half-open byte ranges to remove."""
    shared = side.filter(pc.is_null(side.column("masks")))
    c = _Contexts(rule, docs, shared)
    mask = np.zeros(len(c.h), np.uint64)
    for blob in side.column("masks").drop_null().to_pylist():
        raw = zstandard.decompress(blob)
        n = len(raw) // 12
        mask[np.frombuffer(raw, "<u4", n)] = np.frombuffer(raw, "<u8", n, 4 * n)
    lost = np.zeros(len(c.view), bool)  # windows that an earlier document has, by their places
    for i in range(0, len(c.at), 4 * _SLICE):
        at, context = c.at[i : i + 4 * _SLICE], c.context[i : i + 4 * _SLICE]
        full = (np.uint64(1) << c.windows[i : i + 4 * _SLICE].astype(np.uint64)) - np.uint64(1)
        bits = np.where(c.ids[c.rows(at)] > c.least[context], full, mask[context])
        while bits.any():
            lost[at[(bits & np.uint64(1)).astype(bool)]] = True
            at, bits = at + 1, bits >> np.uint64(1)
    start = np.flatnonzero(lost)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > start[:-1] + rule.length  # always so between texts, which are a byte apart
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(start)]]) - 1 if len(a) else a
    out = [np.empty((0, 2), np.int64)] * len(c.texts)
    if len(a):
        row = c.rows(start[a])
        spans = np.stack([start[a], start[b] + rule.length], axis=1) - c.starts[row, None]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(a)]])
        for i, j in zip(cut[:-1], cut[1:]):
            out[row[i]] = spans[i:j]
    return c, out


def _keep(text: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in spans.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]) if out else text


def _apply(docs: DataFrame, emit, schema: str, length: int, anchor: int, group_mb: float, bucket_mb: float, hot: int, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mb = (base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / (1 << 20)
    rule = Rule(length, anchor, max(8, int(mb / bucket_mb)), max(8, int(mb / group_mb)), hot)
    base = base.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(rule.groups)).cast("int")).select("g", "id", "text")
    rows = base.select("g", "text").mapInArrow(_anchor_rows(rule), "bucket int, tags binary, gs binary, ns binary")
    shared = durable(rows.groupBy("bucket").applyInArrow(_shared(rule), "g int, bucket int, tags binary, hot binary"), "suffix-anchors")
    contexts = base.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_context_rows(rule), "bucket int, g int, blob binary")
    masks = contexts.groupBy("bucket").applyInArrow(_resolve(rule), "g int, masks binary")
    side = shared.withColumn("masks", F.lit(None).cast("binary")).unionByName(masks, allowMissingColumns=True)
    return base.groupBy("g").cogroup(side.groupBy("g")).applyInArrow(lambda d, s: emit(rule, d, s), schema)


def suffix_report(docs: DataFrame, length: int = 50, anchor: int = 24, group_mb: float = 4, bucket_mb: float = 16, hot: int = 1_000,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256).

    Every byte inside a `length`-byte string that also starts in a document with a smaller id is removed;
    strings are judged on the input. Ids are numbers; a null id is later than all others, and rows of one
    id (or of null ids) do not count against each other. Null text is empty. Texts are UTF-8 bytes, and
    what is kept need not be valid UTF-8. Other columns are ignored.

    Documents are cut into groups of about group_mb by hash, anchors into buckets that stand for about
    bucket_mb of text; a group or bucket is what one Python call holds. Anchors that over `hot` documents
    have are dealt out by the windows around them instead, so that a common passage is no bucket's alone; a group
    sends each different window once, whatever number of its documents have it.
    """

    def emit(rule: Rule, d: pa.Table, s: pa.Table) -> pa.Table:
        c, spans = _removed(rule, d, s)
        ids = pa.array(c.ids, mask=c.ids == _NONE)
        n = pa.array(np.fromiter(map(len, c.texts), np.int64, len(c.texts)))
        gone = pa.array(np.fromiter(((x[:, 1] - x[:, 0]).sum() for x in spans), np.int64, len(spans)))
        kept = [hashlib.sha256(_keep(t, x)).hexdigest() for t, x in zip(c.texts, spans)]
        return pa.table({"id": ids, "n_bytes": n, "n_removed": gone, "n_spans": pa.array([len(x) for x in spans], pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    out = _apply(docs, emit, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, anchor, group_mb, bucket_mb, hot, id_col, text_col)
    return out.withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, length: int = 50, anchor: int = 24, group_mb: float = 4, bucket_mb: float = 16, hot: int = 1_000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) without repeated passages (see suffix_report); bytes of a letter cut in two are dropped."""

    def emit(rule: Rule, d: pa.Table, s: pa.Table) -> pa.Table:
        c, spans = _removed(rule, d, s)
        kept = [_keep(t, x).decode("utf-8", "ignore") for t, x in zip(c.texts, spans)]
        return pa.table({"id": pa.array(c.ids, mask=c.ids == _NONE), "text": pa.array(kept, pa.string())})

    out = _apply(docs, emit, "id long, text string", length, anchor, group_mb, bucket_mb, hot, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col))
