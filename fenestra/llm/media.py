"""Media columns: texts' bytes as WAV, and fingerprints of pairs of spectral peaks.

The bytes of a text, filled up with bytes 255 to a positive multiple of 576, are the 8-bit samples of a mono WAV that the
wave module writes. Features come from the stored file read back: a short-time Fourier transform (Hann window, half overlap), the
strongest bin of each frequency band where it stands out, and pairs of such peaks a few frames apart. A
pair is kept as a code (both bins and the distance in frames) with the time of its first peak, in two arrays of equal length.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.llm.batches import map_rows
from fenestra.llm.common import read

UNIT = 576
RATE = 8000
FRAME, HOP = 576, 288
#: Bands of bins, each with one peak a frame at most; a peak has to exceed the band's mean so many times.
BANDS = ((2, 12), (12, 40), (40, 110), (110, 289))
STANDS_OUT = 2.0
#: A peak is paired with those of so many later frames, over distances of 1 to REACH frames.
REACH = 3
#: Frames transformed at once; bounds memory for very long texts.
BLOCK = 2048


def payload(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes())


def spectral_peaks(samples: bytes) -> np.ndarray:
    """An array (frames, bands) of the peaks' bins, 0 for none."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128.0
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, found = np.hanning(FRAME), np.zeros((len(frames), len(BANDS)), np.int64)
    for at in range(0, len(frames), BLOCK):
        # rounded, so that the choice of a peak doesn't hang on the last bits of a sum
        strength = np.rint(np.abs(np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)) * 16)
        for k, (low, high) in enumerate(BANDS):
            band = strength[:, low:high]
            best = band.argmax(axis=1)
            top = band[np.arange(len(band)), best]
            found[at : at + BLOCK, k] = np.where(top > STANDS_OUT * band.mean(axis=1), best + low, 0)
    return found


def peak_pairs(peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes (first bin << 12 | second bin << 2 | distance) of the pairs, by time, then code."""
    times, codes = [], []
    for gap in range(1, REACH + 1):
        first, second = peaks[:-gap], peaks[gap:]
        for a in range(peaks.shape[1]):
            for b in range(peaks.shape[1]):
                at = np.flatnonzero((first[:, a] > 0) & (second[:, b] > 0))
                times.append(at)
                codes.append(first[at, a] << 12 | second[at, b] << 2 | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, n_peaks bigint, n_pairs bigint, pair_sha256 string, media binary, pair_times array<int>, pair_codes array<int>"


def fingerprint(docs: DataFrame, media: bool = True) -> DataFrame:
    """One row for each of `docs` (doc_id, text): the WAV as a binary column, its digests and its peak pairs as two arrays, times and codes.

    A null or empty text gives one unit of padding, a very long one a long WAV, transformed in blocks. Equal texts give equal values. With `media` false the WAV itself is null, and
    only its digests stay. Repeated rows give repeated results; an empty table gives an empty one; other columns of `docs` are not read.
    """

    def work():
        def each(doc_id, text):
            stored = to_wav(payload(text))
            samples = from_wav(stored)
            peaks = spectral_peaks(samples)
            times, codes = peak_pairs(peaks)
            pairs = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
            yield (
                doc_id, len(text or b""), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored), hashlib.sha256(stored).hexdigest(),
                int((peaks > 0).sum()), len(codes), pairs, stored if media else None, times, codes,
            )

        return each

    return map_rows(docs.select("doc_id", F.col("text").cast("binary")), work, SCHEMA)


def op7_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, by fingerprint(): digests of payload and media, a digest of the peak pairs, and the pairs' times and codes."""
    found = fingerprint(read(spark, sf_dir, "documents"), media=False)
    feature = F.concat_ws(":", "n_peaks", "n_pairs", "pair_sha256").alias("feature")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature, "pair_times", "pair_codes")
