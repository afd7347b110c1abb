"""Media columns: texts as WAV samples, short-time Fourier transforms and spectral-peak pair fingerprints.

The UTF-8 bytes of a text, zero-padded to a positive multiple of ``FRAME``, are 8-bit mono samples that the wave module
writes and reads back. Frames of the samples read back, half overlapping and windowed, are transformed; local maxima of
the spectrogram pair with the next peaks after them, and each pair is (time of its first peak, bins and distance). The
two columns of a fingerprint are arrays in order of time. Frames are transformed in blocks, so that a text of any length
needs bounded memory besides its own bytes. Equal texts give equal values.
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

from trackloom.llm.arrow_text import byte_slices, strings

FRAME, HOP, RATE = 64, 32, 8000
BLOCK = 1 << 14
FAN, REACH = 3, 63
WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


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


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and bins of the peaks: the loudest bin of a frame, where neither neighbouring frame is louder in any bin."""
    frames = max(1, (len(samples) - FRAME) // HOP + 1)
    loud, bins = np.zeros(frames, np.float32), np.zeros(frames, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for a in range(0, frames, BLOCK):
        part = (view[a : a + BLOCK].astype(np.float32) - 128.0) * WINDOW
        power = np.abs(np.fft.rfft(part, axis=1)[:, 1:]).astype(np.float32)
        best = power.argmax(1)
        bins[a : a + BLOCK] = best + 1
        loud[a : a + BLOCK] = np.round(power[np.arange(len(best)), best], 2)
    before, after = np.append(-1, loud[:-1]), np.append(loud[1:], -1)
    times = np.flatnonzero((loud >= before) & (loud > after))
    return times, bins[times]


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, hashes) of peak pairs: a hash is first bin, second bin and distance in frames, six bits each."""
    times, bins = spectral_peaks(samples)
    at, codes = [], []
    for k in range(1, FAN + 1):
        gap = times[k:] - times[:-k]
        near = gap <= REACH
        at.append(times[:-k][near] if k <= len(times) else times[:0])
        codes.append((bins[:-k] << 12 | bins[k:] << 6 | gap)[near])
    t, c = np.concatenate(at), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media binary, times array<int>, hashes array<int>, feature string"


def media_columns(docs: DataFrame, slice_bytes: int = 4 << 20, keep_media: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the stored WAV, digests of what is read back, and the fingerprint.

    ``times`` and ``hashes`` are the peak pairs; ``feature`` is the number of pairs and a SHA-256 of both arrays. A null
    text counts as empty and is one frame of bytes 0, as is the empty text. ``keep_media=False`` leaves the WAV itself
    null. Repeated rows give a row each, other columns of ``docs`` are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = strings(batch.column("text")).cast(pa.binary()), batch.column("doc_id")
            for a, b in byte_slices(texts, slice_bytes):
                rows = []
                for data in texts.slice(a, b - a).to_pylist():
                    media = to_wav(padded(data))
                    read = from_wav(media)
                    times, codes = fingerprint(np.frombuffer(read, np.uint8))
                    feature = f"{len(times)}:{hashlib.sha256(times.tobytes() + codes.tobytes()).hexdigest()}"
                    stored = media if keep_media else None
                    rows.append((len(data), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), stored, times, codes, feature))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
