"""A frame source: ordered scans of recorded videos with projection, time ranges and point lookups.

Decoding is an adapter, a function (path, start, end, width) -> iterator of (t, pts, grey array). Without a
media library the recorded adapter reads frames kept as NumPy archives (t, pts, frames). Each file and
time range is a partition; ranges overlap by the lag that the as-of difference needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..kernels import images

Decoder = Callable[[str, float, float, int], Iterator[tuple[float, int, np.ndarray]]]
EPS = 1e-6


def recorded(path: str, start: float, end: float, width: int) -> Iterator[tuple[float, int, np.ndarray]]:
    """Frames from start to end (both with 1 µs to spare) of a recorded archive, at `width` columns."""
    with np.load(path) as f:
        t, pts, frames = f["t"], f["pts"], f["frames"]
    for i in np.flatnonzero((t >= start - EPS) & (t <= end + EPS)):
        yield float(t[i]), int(pts[i]), images.resize(frames[i], width)


def ranges(spark: SparkSession, videos: list[tuple[str, str, float]], seconds: float, overlap: float = 2.0) -> DataFrame:
    """(video_id, path, read_from, start, end): time ranges of about `seconds`, read from `overlap` earlier."""
    rows = [(v, p, max(0.0, k * seconds - overlap), k * seconds, min(d, (k + 1) * seconds)) for v, p, d in videos for k in range(max(1, int(np.ceil(d / seconds))))]
    df = spark.createDataFrame(rows, "video_id string, path string, read_from double, start double, end double")
    return df.repartition(len(rows), "video_id", "start")


def frame_metrics(spans: DataFrame, decode: Decoder = recorded, width: int = 160, lag: float = 0.2) -> DataFrame:
    """(video_id, t, pts, motion, sharp, bright, sig, error) of every frame; a file that breaks off gives its frames
    up to there and an error row."""

    def over(batches):
        for b in batches:
            for s in b.to_pylist():
                rows, recent, error = [], [], None
                try:
                    for t, pts, img in decode(s["path"], s["read_from"], s["end"], width):
                        soft = images.blur(img)
                        recent.append((t, soft))
                        while len(recent) > 1 and recent[1][0] <= t - lag + EPS:
                            recent.pop(0)
                        if t >= s["start"] - EPS:
                            rows.append((t, pts, float(np.abs(soft - recent[0][1]).mean()), float(images.laplacian(img).var()), float(img.mean()), images.signature(img).tobytes()))
                except Exception as e:  # noqa: BLE001  what can be read counts
                    error = f"{type(e).__name__}: {e}"
                cols = list(zip(*rows)) if rows else [[]] * 6
                names = ["t", "pts", "motion", "sharp", "bright", "sig"]
                kinds = [pa.float64(), pa.int64(), pa.float32(), pa.float32(), pa.float32(), pa.binary()]
                n = len(rows) + (error is not None)
                arrays = [pa.array([*c, *([None] * (error is not None))], k) for c, k in zip(cols, kinds)]
                yield pa.record_batch([pa.array([s["video_id"]] * n), *arrays, pa.array([None] * len(rows) + [error] * (error is not None), pa.string())], names=["video_id", *names, "error"])

    out = spans.mapInArrow(over, "video_id string, t double, pts bigint, motion float, sharp float, bright float, sig binary, error string")
    return out.dropDuplicates(["video_id", "pts", "error"])


def grab(keys: DataFrame, videos: DataFrame, decode: Decoder = recorded, near: float = 3.0, width: int = 1_000_000) -> DataFrame:
    """Point lookups (video_id, t, pts) -> (video_id, pts, found, height, width, grey): keys of a video are sorted and
    those within `near` seconds share a scan. A key without a frame has found = false."""

    def over(table: pa.Table) -> pa.Table:
        rows = sorted({(r["t"], r["pts"], r["path"], r["video_id"]) for r in table.to_pylist()})
        got: dict[int, np.ndarray] = {}
        i = 0
        while i < len(rows):
            j = i
            while j + 1 < len(rows) and rows[j + 1][0] - rows[j][0] <= near:
                j += 1
            want = {r[1] for r in rows[i : j + 1]}
            for _, pts, img in decode(rows[i][2], rows[i][0], rows[j][0], width):
                if pts in want:
                    got[pts] = img
            i = j + 1
        out = [(v, p, p in got, *(got[p].shape if p in got else (None, None)), got[p].astype(np.uint8).tobytes() if p in got else None) for _, p, _, v in rows]
        cols = list(zip(*out))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("video_id", "pts", "found", "height", "width", "grey"), cols, kinds)})

    j = keys.join(videos.select("video_id", "path"), "video_id").select("video_id", "t", "pts", "path")
    return j.groupBy("video_id").applyInArrow(over, "video_id string, pts bigint, found boolean, height int, width int, grey binary")
