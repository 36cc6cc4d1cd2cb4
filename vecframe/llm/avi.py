"""Operator 3: media columns of AVI motion-JPEG.

``store`` turns texts into AVI files: the UTF-8 bytes, padded with spaces to a positive multiple of 192, are samples
of grey JPEG frames (one byte is one flat block, see jpeg.py), at most ``FRAME`` bytes in each; the last frame is
filled up with its own bytes again. ``probe_media`` parses a file by its RIFF index, decodes its intra frames, and
finds the payload, its digests, and shots. ``clips`` gives a row for each shot, with times. Both read any AVI whose
frames are baseline JPEG.

Shots: the luma histograms of neighbouring frames are compared; of our own files they leave out what isn't text. A
shot begins where the difference is over the mean of the last ``MEMORY`` ones of this shot by three of their
deviations, and over ``FLOOR``; until a shot has ``WARM`` differences, where it is over ``FIRST``. What frames of so
few samples differ by chance is added to the limit, so a last frame of a few bytes begins no shot.

Null texts count as empty (192 spaces); equal texts give equal files; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import binary_texts, column

UNIT, FRAME, FPS = 192, 3072, 25
BINS, MEMORY, FLOOR, WARM, FIRST = 32, 8, 0.25, 3, 0.5
#: Bytes of media after which a batch is passed on.
BATCH = 32 << 20


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def write(payload: bytes, n_bytes: int) -> bytes:
    """An AVI file of the payload; n_bytes of it are text."""
    frame = min(len(payload), FRAME)
    frames = [jpeg.encode(np.resize(np.frombuffer(payload, np.uint8, min(frame, len(payload) - i), i), frame).tobytes()) for i in range(0, len(payload), frame)]
    wide, high = jpeg.BLOCKS_WIDE * 8, frame // jpeg.BLOCKS_WIDE * 8
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, wide, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", f"payload {len(payload)} text {n_bytes}".encode() + b"\0"))
    movi, index, at = [], [], 4
    for x in frames:
        movi.append(_chunk(b"00dc", x))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(movi[-1])
    body = head + info + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of each chunk; lists are named by their kind."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        start, stop = at + 8, min(end, at + 8 + size)
        if name == b"LIST":
            yield data[start : start + 4], start + 4, stop
        else:
            yield name, start, stop
        at += 8 + size + size % 2


def parse(data: bytes) -> dict:
    """Of an AVI file: fps, comment, and the JPEG frames of its video, by the index if it has one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out, movi, index = {"fps": float(FPS), "comment": "", "frames": []}, None, None
    for name, start, end in _chunks(data, 12, len(data)):
        if name == b"hdrl":
            for inner, a, b in _chunks(data, start, end):
                if inner == b"avih":
                    out["fps"] = 1_000_000 / max(1, struct.unpack_from("<I", data, a)[0])
                elif inner == b"strl":
                    for deep, c, _ in _chunks(data, a, b):
                        if deep == b"strh" and data[c : c + 4] == b"vids":
                            scale, rate = struct.unpack_from("<II", data, c + 20)
                            out["fps"] = rate / scale if scale and rate else out["fps"]
        elif name == b"INFO":
            out["comment"] = next((data[a:b].rstrip(b"\0").decode("utf-8", "replace") for inner, a, b in _chunks(data, start, end) if inner == b"ICMT"), "")
        elif name == b"movi":
            movi = start, end
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, i) for i in range(start, end - 15, 16)]
    if movi is None:
        return out
    if index:
        first = next((x[2] for x in index), 0)
        base = movi[0] - 4 if first < movi[0] else 0  # offsets count from the list's kind, or from the file's start
        spans = [(base + at + 8, base + at + 8 + size) for name, _, at, size in index if name[2:] in (b"dc", b"db")]
    else:
        spans = [(a, b) for name, a, b in _chunks(data, *movi) if name[2:] in (b"dc", b"db")]
    out["frames"] = [data[a:b] for a, b in spans if b > a]
    return out


def histogram(samples: np.ndarray) -> np.ndarray:
    """How many samples each bin has."""
    return np.bincount(samples.ravel() >> 3, minlength=BINS)


def chance(n: int) -> float:
    """About half the absolute difference of two histograms of which the smaller has n samples."""
    return float(np.sqrt(BINS / (2 * np.pi * n)))


def shots(histograms: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, last) frame of each shot."""
    if not histograms:
        return []
    starts, recent = [0], []
    for i, (a, b) in enumerate(zip(histograms, histograms[1:], strict=False), 1):
        n, m = int(a.sum()), int(b.sum())
        if not n or not m:
            continue
        d = float(np.abs(a / n - b / m).sum()) / 2
        limit = FIRST if len(recent) < WARM else max(FLOOR, float(np.mean(recent) + 3 * np.std(recent)))
        if d > limit + chance(min(n, m)):
            starts.append(i)
            recent = []
        else:
            recent = [*recent[1 - MEMORY :], d]
    return list(zip(starts, [*[s - 1 for s in starts[1:]], len(histograms) - 1], strict=True))


def media(data: bytes) -> tuple[bytes | None, list[tuple[int, int]], float]:
    """Of an AVI file: the payload if it is one of ours, shots, frames per second."""
    found = parse(data)
    words = found["comment"].split()
    if words[:1] == ["payload"]:
        size, n_text, at, counts = int(words[1]), int(words[3]), 0, []
        values = [jpeg.blocks(x) for x in found["frames"]]
        for x in values:
            counts.append(histogram(x[: max(0, n_text - at)]))
            at += len(x)
        return b"".join(x.tobytes() for x in values)[:size], shots(counts), found["fps"]
    return None, shots([histogram(jpeg.decode(x)[0]) for x in found["frames"]]), found["fps"]


def describe(found: list[tuple[int, int]], fps: float) -> str:
    return f"fps={fps:g};frames={found[-1][1] + 1 if found else 0};shots=" + ",".join(f"{a}-{b}@{round(1000 * a / fps)}-{round(1000 * (b + 1) / fps)}ms" for a, b in found)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the AVI file of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

        for batch in batches:
            rows, size = [], 0
            for k, x in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), strict=True):
                rows.append((k, len(x), write(pad(x), len(x))))
                size += len(rows[-1][2])
                if size >= BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return docs.select(column(key).cast("long").alias("doc_id"), column(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


CLIPS = pa.list_(pa.struct([(n, pa.int32()) for n in ("first_frame", "last_frame", "start_ms", "end_ms")]))


def timed(found: list[tuple[int, int]], fps: float) -> list[dict]:
    return [{"first_frame": a, "last_frame": b, "start_ms": round(1000 * a / fps), "end_ms": round(1000 * (b + 1) / fps)} for a, b in found]


def probe_media(files: DataFrame) -> DataFrame:
    """From doc_id, n_bytes, media: payload and media sizes and digests, the shots as a string (feature) and as timed clips."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for x in batch.column(2).to_pylist():
                payload, found, fps = media(x or b"") if x else (None, [], float(FPS))
                row = (
                    None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest(),
                    None if payload is None else zlib.crc32(payload[-16:]), len(x or b""), hashlib.sha256(x or b"").hexdigest(), describe(found, fps), timed(found, fps),
                )
                for column_, value in zip(out, row, strict=True):
                    column_.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), CLIPS]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{schema}, clips array<struct<first_frame: int, last_frame: int, start_ms: int, end_ms: int>>")


def clips(files: DataFrame) -> DataFrame:
    """From doc_id, media: a row for each shot: doc_id, clip, first_frame, last_frame, start_ms, end_ms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, found, fps = media(x) if x else (None, [], 1.0)
                rows += [{"doc_id": k, "clip": i, **x} for i, x in enumerate(timed(found, fps))]
            schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int32()) for n in ("clip", "first_frame", "last_frame", "start_ms", "end_ms")]])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame int, last_frame int, start_ms int, end_ms int")
