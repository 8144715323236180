"""Media columns: bytes as WAV files, spectra, and fingerprints of spectral-peak pairs.

``to_wav`` stores bytes losslessly as 8-bit mono samples with the wave module. ``read_wav`` reads the
file back, gives the payload, and computes features: a short-time Fourier transform (frames of
``FRAME`` samples, half overlapping, Hann window), in each of five frequency bands the strongest bin of a frame, kept as a peak
where it is not weaker than the band's neighbours in time, and for each peak the pairs with the next ``FAN`` peaks
within ``REACH`` frames. A pair is ``(time, code)`` with the code made of both frequencies and the distance in time; they are
stored as two arrays of equal length.

Defined results: a null text is an empty one. Payloads are filled with bytes 255 to a positive multiple of ``FRAME``, so
nothing is shorter than a frame. Equal bytes give equal files and features; ties between bins go to the lower one. Very
long payloads are transformed in blocks. A null media column gives null. Rows keep their other columns.
"""
from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

FRAME, HOP, RATE = 576, 288, 8000
BANDS = (1, 10, 24, 56, 120, 289)
FAN, REACH, BLOCK = 3, 32, 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


def wav_bytes(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peak_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the spectral-peak pairs."""
    x = np.frombuffer(samples, np.uint8)
    if len(x) < FRAME:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    n, nb = len(frames), len(BANDS) - 1
    where, power = np.empty((n, nb), np.int32), np.empty((n, nb), np.float32)
    for at in range(0, n, BLOCK):
        block = (frames[at: at + BLOCK].astype(np.float32) - np.float32(128)) * _WINDOW
        spectrum = np.fft.rfft(block, axis=1)
        # Whole numbers, so that the last bits of a sum do not decide.
        level = np.round(np.log1p(spectrum.real**2 + spectrum.imag**2) * 1000)
        for b in range(nb):
            part = level[:, BANDS[b]: BANDS[b + 1]]
            best = part.argmax(axis=1)
            where[at: at + BLOCK, b] = best + BANDS[b]
            power[at: at + BLOCK, b] = part[np.arange(len(part)), best]
    edge = np.full((1, nb), -1, np.float32)
    peak = (power >= np.vstack([edge, power[:-1]])) & (power > np.vstack([power[1:], edge]))
    t, b = np.nonzero(peak)
    f = where[t, b]
    times, codes = [], []
    for k in range(1, FAN + 1):
        d = t[k:] - t[:-k]
        near = d <= REACH
        times.append(t[:-k][near])
        codes.append((f[:-k][near] << 18) | (f[k:][near] << 8) | d[near])
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def to_wav(text: Column) -> Column:
    """The WAV file of a text's UTF-8 bytes."""
    @F.pandas_udf("binary")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([wav_bytes(padded(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"")) for t in s], dtype=object)

    return run(text)


def read_wav(media: Column) -> Column:
    """Struct ``(payload, times, codes)`` read from stored WAV files."""
    @F.pandas_udf("payload binary, times array<int>, codes array<int>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            payload, times, codes = [], [], []
            for m in s:
                raw = None if m is None else wav_samples(m)
                t, c = (None, None) if raw is None else peak_pairs(raw)
                payload.append(raw)
                times.append(t)
                codes.append(c)
            yield pd.DataFrame({"payload": pd.Series(payload, dtype=object), "times": pd.Series(times, dtype=object), "codes": pd.Series(codes, dtype=object)})

    return run(media)
