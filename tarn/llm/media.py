"""Media columns: WAV through the wave module, short-time Fourier transforms, spectral-peak pair fingerprints.

A sound is 8-bit mono PCM. Its spectrogram has Hann-windowed frames that overlap by half, so that every sample has weight in some frame; a
peak is a bin (but for the constant one) that none of the frames next to its own exceeds within NEAR bins. A peak is paired with
the next FAN peaks, in order of time and frequency, that come within ZONE frames. A pair is stored at the time (frame) of its first
peak as f1 << 16 | f2 << 8 | dt, in two arrays: times and codes.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarn.llm.common import arrow_schema, map_columns, read_table

UNIT, RATE, FRAME, HOP, TAIL = 64, 8000, 256, 128, 64
#: Bins and frames around a peak that it is the largest of, pairs of a peak, and frames that a pair may span (a code has 8 bits for them).
NEAR, BESIDE, FAN, ZONE = 8, 1, 3, 255
#: Frames whose spectra are held at once.
FRAMES_AT_ONCE = 1024


NEW = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pairs")


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        if r.getnchannels() != 1 or r.getsampwidth() != 1:
            raise ValueError("expected 8-bit mono samples")
        return r.readframes(r.getnframes())


def power(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Bins 1 .. FRAME / 2 of frames first .. first + count - 1; frame t begins at sample (t - 1) * HOP. What lies outside the sound is silence.

    Rounded, so that what is equal is equal in spite of the arithmetic.
    """
    low, high = (first - 1) * HOP, (first + count) * HOP
    part = samples[max(0, low) : max(0, high)].astype(np.float32) - 128
    part = np.pad(part, (max(0, -low), max(0, high - max(len(samples), 0))))[: high - low]
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
    spectrum = np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)[:, 1:]
    return np.round(spectrum.real**2 + spectrum.imag**2)


def widest(a: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """The largest value within reach to either side along an axis; no value is below 0."""
    pad = [(0, 0)] * 2
    pad[axis] = (reach, reach)
    a, have, size = np.pad(a, pad), 1, 2 * reach + 1
    cut = lambda x, start, stop: x[start:stop] if axis == 0 else x[:, start:stop]
    while have < size:
        step = min(have, size - have)
        a = np.maximum(cut(a, 0, a.shape[axis] - step), cut(a, step, a.shape[axis]))
        have += step
    return a


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, by frame and bin. A long sound goes in blocks of frames, whole."""
    count = -(-len(samples) // HOP) + 1
    times, bins = [], []
    for at in range(0, count, FRAMES_AT_ONCE):
        end = min(count, at + FRAMES_AT_ONCE)
        low, high = max(0, at - BESIDE), min(count, end + BESIDE)
        p = power(samples, low, high - low)
        on = (p > 0) & (p >= widest(widest(p, NEAR, 1), BESIDE, 0))
        t, f = np.nonzero(on[at - low : end - low])
        times.append(t + at)
        bins.append(f + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprints(samples: np.ndarray, fan: int = FAN) -> tuple[np.ndarray, np.ndarray]:
    """times and codes of peak pairs, by time."""
    t, f = peaks(samples)
    times, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, fan + 1):
        dt = t[k:] - t[:-k]
        on = dt <= ZONE
        times.append(t[:-k][on])
        codes.append((f[:-k] << 16 | f[k:] << 8 | dt)[on])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def media_columns(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text to doc_id, n_bytes, media (WAV bytes), times and codes.

    A null text is empty, an empty one UNIT bytes 0; texts go whole up to the 4 GB that WAV can name. Equal texts have equal values; ids may be
    null or repeat. Further columns are left out. An empty table gives no rows.
    """
    ddl = "doc_id long, n_bytes long, media binary, times array<int>, codes array<int>"

    def run(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in rows:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in x["text"]]
            media = [to_wav(padded(d)) for d in data]
            found = [fingerprints(np.frombuffer(from_wav(m), np.uint8)) for m in media]
            yield {"doc_id": x["doc_id"], "n_bytes": [len(d) for d in data], "media": media, "times": [t for t, _ in found], "codes": [c for _, c in found]}

    return map_columns(docs.select("doc_id", "text"), run, ddl, rows=128)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of media_columns, and its times and codes; the stored bytes are read back for the payload's."""
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long, times array<int>, codes array<int>"
    schema = arrow_schema(ddl)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema if f.name in NEW}
            for media, *both in zip(*(batch.column(c) for c in ("media", "times", "codes")), strict=True):
                media, (t, c) = media.as_py(), (x.values.to_numpy(zero_copy_only=False).astype("<i4") for x in both)
                back = from_wav(media)
                row = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(t.tobytes() + c.tobytes()).hexdigest(), len(t))
                for name, value in zip(NEW, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return media_columns(read_table(spark, sf_dir, "documents")).mapInArrow(digest, ddl)
