"""Media columns: bytes stored as WAV, spectral-peak pair fingerprints as time-coded arrays."""

from __future__ import annotations

import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

FRAME = 576
HOP = 288
RATE = 8000
BANDS = 6
REACH = 3
FILLER = 255
_BLOCK_FRAMES = 512
_WINDOW = np.hanning(FRAME).astype(np.float32)
# Peaks are sought per band; the bands widen with frequency and leave out the constant part.
_EDGES = np.unique(np.geomspace(2, FRAME // 2 + 1, BANDS + 1).astype(int))


def wav_of(payload: bytes) -> bytes:
    """A mono WAV file whose 8-bit samples are the bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def samples_of(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        if file.getnchannels() != 1 or file.getsampwidth() != 1:
            raise ValueError("only mono files of 8-bit samples are read")
        return file.readframes(file.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest frequency of every band of every frame of the short-time Fourier transform, and which of them count.

    A peak counts when it stands above the mean strength of its band over the frames of its block.
    """
    if len(samples) < FRAME:
        samples = np.append(samples, np.full(FRAME - len(samples), 128, np.uint8))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins, strong = [], []
    for first in range(0, len(frames), _BLOCK_FRAMES):
        part = (frames[first : first + _BLOCK_FRAMES].astype(np.float32) - 128.0) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1))
        places, heights = [], []
        for low, high in zip(_EDGES[:-1], _EDGES[1:], strict=True):
            at = power[:, low:high].argmax(axis=1)
            places.append(at + low)
            heights.append(power[np.arange(len(power)), at + low])
        heights = np.array(heights).T
        bins.append(np.array(places).T)
        strong.append(heights >= heights.mean(axis=0))
    return np.concatenate(bins), np.concatenate(strong)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Pairs of counting peaks, ``time << 32 | first bin << 20 | second bin << 8 | frames between``, by time.

    Each peak is paired with the counting peaks of its own band in the next ``REACH`` frames, and with that of the next band in
    its own frame.
    """
    bins, strong = peaks(samples)
    times = np.arange(len(bins), dtype=np.int64)[:, None]
    found = []
    for gap in range(1, REACH + 1):
        if len(bins) > gap:
            both = strong[:-gap] & strong[gap:]
            codes = (times[:-gap] << 32) | (bins[:-gap].astype(np.int64) << 20) | (bins[gap:].astype(np.int64) << 8) | gap
            found.append(codes[both])
    both = strong[:, :-1] & strong[:, 1:]
    found.append(((times << 32) | (bins[:, :-1].astype(np.int64) << 20) | (bins[:, 1:].astype(np.int64) << 8))[both])
    return np.sort(np.concatenate(found))


def padded(raw: bytes, unit: int = FRAME) -> bytes:
    return raw + bytes([FILLER]) * ((unit - len(raw) % unit) if len(raw) % unit or not raw else 0)


@F.arrow_udf(BinaryType())
def _stored(texts: pa.Array) -> pa.Array:
    return pa.array((wav_of(padded((text or "").encode())) for text in texts.to_pylist()), pa.binary())


_READ = StructType([StructField("payload", BinaryType()), StructField("tail_crc32", LongType()), StructField("pairs", ArrayType(LongType()))])


@F.arrow_udf(_READ)
def _read(media: pa.Array) -> pa.Array:
    rows = []
    for file in media.to_pylist():
        if file is None:
            rows.append(None)
            continue
        payload = samples_of(file)
        rows.append({"payload": payload, "tail_crc32": zlib.crc32(payload[-32:]), "pairs": fingerprint(np.frombuffer(payload, np.uint8))})
    return pa.array(rows, pa.struct([("payload", pa.binary()), ("tail_crc32", pa.int64()), ("pairs", pa.list_(pa.int64()))]))


def stored(text: Column) -> Column:
    """WAV file of the UTF-8 bytes of a text, filled with bytes 255 up to a positive multiple of 576.

    Nothing is lost: one sample holds one byte.  A null text counts as empty, an empty one is one frame of filler.  Texts of any
    length are stored whole; memory is bounded by one text.
    """
    return _stored(text)


def features(media: Column) -> Column:
    """``payload, tail_crc32, pairs`` read back from a WAV column; ``pairs`` is the time-coded fingerprint.

    A null file gives null.  Equal files give equal features.
    """
    return _read(media)
