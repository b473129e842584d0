"""Media columns: texts kept as WAV bytes, read by the wave module, and fingerprinted by spectral peaks.

The samples are cut into half-overlapping frames; a short-time Fourier transform gives each frame its
strongest bin in each of two bands; every peak is paired with the peaks of the frames that follow. A pair
(bin, bin, distance) with the time of its first peak is one landmark; a document's landmarks are an array
of time-coded integers, which the query prints as a string.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import small_batches

PAD, RATE = 64, 8000
FRAME, HOP, FAN = 512, 256, 2
#: Bins of a frame's two bands; bin 0 holds the mean and is left out.
BANDS = ((1, 64), (64, FRAME // 2 + 1))
#: Frames transformed at a time, so that memory does not follow a text's length.
BLOCK = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % PAD if data else PAD)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """(frames, bands) strongest bins. The last frame is filled up with zeros."""
    x = np.frombuffer(payload, np.uint8)
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    out = np.empty((n, len(BANDS)), np.int64)
    for a in range(0, n, BLOCK):
        k = min(BLOCK, n - a)
        part = np.zeros((k - 1) * HOP + FRAME, np.float32)
        have = x[a * HOP : a * HOP + len(part)]
        part[: len(have)] = have
        part[: len(have)] -= 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1))
        for j, (lo, hi) in enumerate(BANDS):
            out[a : a + k, j] = power[:, lo:hi].argmax(axis=1) + lo
    return out


def landmarks(p: np.ndarray) -> np.ndarray:
    """Time-coded pairs: time << 24 | bin << 13 | bin << 4 | distance, by time, band and distance."""
    n = len(p)
    parts = [
        (np.arange(n - d, dtype=np.int64) << 24) | (p[: n - d, j] << 13) | (p[d:, 1 - j] << 4) | d
        for d in range(1, FAN + 1) if n > d for j in range(p.shape[1])
    ]
    return np.sort(np.concatenate(parts)) if parts else (p[:, 0] << 13) | (p[:, 1] << 4)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, the digests of the payload read back, of its tail and of the stored WAV, landmarks.

    ``with_media`` adds the WAV bytes themselves. A null text counts as empty; an empty text is 64 zero
    bytes. Equal texts give equal values. A text must stay below 4 GB, the limit of the WAV format.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, landmarks array<bigint>" + ", media binary" * with_media

    def one(text: str | None) -> tuple:
        payload = padded(text)
        media = to_wav(payload)
        back = from_wav(media)
        marks = landmarks(peaks(back))
        return (
            len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]),
            len(media), hashlib.sha256(media).hexdigest(), marks, media,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "landmarks", "media"]
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                rows = [one(t.as_py()) for t in b.column(1).slice(a, 1024)]
                cols = list(zip(*rows))
                ends = np.cumsum([0, *map(len, cols[6])])
                marks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cols[6]), pa.int64()))
                arrays = [b.column(0).slice(a, 1024), *(pa.array(c, k) for c, k in zip(cols, kinds)), marks]
                if with_media:
                    arrays.append(pa.array(cols[7], pa.binary()))
                yield pa.record_batch(arrays, names=names[: len(arrays)])

    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, schema)
