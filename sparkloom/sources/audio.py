"""Waveforms of WAV files: decoding of their samples and band-limited resampling, as columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import portions

#: Zero crossings of the filter on either side, the share of the band that is kept, and outputs computed at once.
CROSSINGS, ROLLOFF, BLOCK = 32, 0.95, 1 << 14
# The codes of sample formats in the header.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def decoded(content: bytes | None) -> tuple[np.ndarray, int] | None:
    """(samples from -1 to 1, rate) of a WAV file, the mean of its channels; None for anything that can't be read whole.

    Integers of 8 (unsigned), 16, 24 and 32 bits and floats of 32 and 64 bits. A data chunk that is cut off is read as far as it goes.
    """
    if not content or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            code, channels, rate = (int.from_bytes(body[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8)))
            bits = int.from_bytes(body[14:16], "little")
            form = (int.from_bytes(body[24:26], "little") if code == EXTENSIBLE and len(body) >= 26 else code), channels, rate, bits
        elif name == b"data":
            if form is None or not form[1] or not form[2]:
                return None
            samples = _samples(body, form[0], form[3])
            if samples is None:
                return None
            whole = samples[: len(samples) // form[1] * form[1]].reshape(-1, form[1])
            return whole.mean(axis=1) if form[1] > 1 else whole[:, 0], form[2]
        at += 8 + size + size % 2
    return None


def _samples(body: bytes, code: int, bits: int) -> np.ndarray | None:
    width = bits // 8
    if not width or bits % 8 or (code, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
        return None
    body = body[: len(body) // width * width]
    if code == FLOAT:
        return np.frombuffer(body, f"<f{width}").astype(np.float64)
    if bits == 8:
        return (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        three = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8) / float(1 << 23)
    return np.frombuffer(body, f"<i{width}") / float(1 << (bits - 1))


@lru_cache(maxsize=2)
def _filter(up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """The inputs around an output, and their weights for each phase of it."""
    cut = ROLLOFF * min(1.0, up / down)
    half = math.ceil(CROSSINGS / cut)
    offsets = np.arange(-half, half + 1)
    phase = np.arange(up)[:, None] / up - offsets[None, :]  # distance of an output of this phase from each input around it
    window = np.i0(9.0 * np.sqrt(np.clip(1 - (phase / (half + 1)) ** 2, 0, None))) / np.i0(9.0)
    taps = cut * np.sinc(cut * phase) * window
    taps /= taps.sum(axis=1, keepdims=True)  # a constant stays one
    return offsets, taps


def resampled(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """samples at another rate: ceil(n * target / rate) values of the band-limited signal.

    A sinc filter below the lower of both Nyquist frequencies, in a Kaiser window; each of its phases is computed once, since the rates'
    ratio is a fraction. Beyond its ends the signal is silent.
    """
    if rate == target or not len(samples):
        return samples
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    offsets, taps = _filter(up, down)
    half = int(offsets[-1])
    n = -(-len(samples) * up // down)
    padded = np.concatenate([np.zeros(half), samples, np.zeros(half + 1)])
    out = np.empty(n)
    for start in range(0, n, BLOCK):
        place = np.arange(start, min(n, start + BLOCK)) * down
        base = place // up
        out[start : start + len(place)] = np.einsum("ij,ij->i", padded[base[:, None] + half + offsets[None, :]], taps[place % up])
    return out


def waves(rate: int) -> Callable[[Column], Column]:
    """Samples at rate from WAV files, handed back a portion of files at a time, as they are many times as large as the files."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for files in batches:
            for cut in portions([len(f) if f is not None else 0 for f in files]):
                out = []
                for f in files.iloc[cut]:
                    found = decoded(None if f is None else bytes(f))
                    out.append(None if found is None else resampled(*found, rate).astype(np.float32))
                yield pd.Series(out, dtype=object)

    return run


def waveform(content: Column, rate: int) -> Column:
    """The samples of WAV files at rate as array<float>; null where a file can't be read."""
    return waves(rate)(content)


def with_waveforms(audio: DataFrame, rate: int, content: str = "content") -> DataFrame:
    """audio with features (samples at rate) and input_length instead of content, as the feature cache holds them; unreadable files have nulls."""
    rows = audio.withColumn("features", waveform(F.col(content), rate)).drop(content)
    return rows.withColumn("input_length", F.when(F.col("features").isNotNull(), F.size("features")).cast("long"))
