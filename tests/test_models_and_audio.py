"""Beam search against all paths, batches for models, and waveforms against closed forms."""

import itertools
import math
import struct
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import sinks
from sparkloom.operators import decoding as D
from sparkloom.sources import audio as A


def all_paths(log_probs, blank=0):
    """The log probability of every labelling, by the sum over all paths of frames."""
    out = defaultdict(float)
    for path in itertools.product(range(log_probs.shape[1]), repeat=len(log_probs)):
        labels = tuple(k for k, _ in itertools.groupby(path) if k != blank)
        out[labels] += math.exp(sum(log_probs[t, s] for t, s in enumerate(path)))
    return out


@pytest.mark.parametrize("blank", [0, 2])
def test_beams_against_all_paths(blank):
    rng = np.random.default_rng(blank)
    for _ in range(15):
        lp = D.log_softmax(rng.normal(size=(6, 3)) * 2)
        want, got = all_paths(lp, blank), D.prefix_beams(lp, 10_000, blank)
        assert len(got) == len(want) and all(math.isclose(math.exp(p), want[k], rel_tol=1e-9) for k, p in got)
        assert [k for k, _ in got] == sorted(want, key=lambda k: (-dict(got)[k], k))
        assert D.prefix_beams(lp, 8, blank)[0][1] <= got[0][1] + 1e-12
    assert D.prefix_beams(np.zeros((0, 3)), 4) == [((), 0.0)]


def test_beam_beats_greedy_and_reads_a_bonus():
    lp = np.log(np.array([[0.6, 0.4], [0.6, 0.4]]))  # the best path is two blanks, the best labelling is one label
    assert D.prefix_beams(lp, 4)[0][0] == (1,) and math.isclose(math.exp(D.prefix_beams(lp, 4)[0][1]), 0.64)
    assert D.prefix_beams(lp, 4, bonus=lambda prefix, label: -5.0)[0][0] == ()


def test_batches_are_bounded_and_models_built_once_a_task(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 50 > 0, F.sequence(F.lit(1.0).cast("int"), (F.col("id") % 37 + 1).cast("int"))).cast("array<float>").alias("x")).repartition(3)

    def build():
        calls = []

        def model(arrays):
            calls.append(len(arrays) * max((len(a) for a in arrays), default=0))
            assert calls[-1] <= 60 or len(arrays) == 1
            return [float(a.sum()) + 1000 * (len(calls) > 1) for a in arrays]

        return model

    got = {r.id: r.y for r in D.predicted(rows, "x", build, "y", "double", budget=60).collect()}
    assert len(got) == 500 and all(got[i] % 1000 == (0 if i % 50 == 0 else (i % 37 + 1) * (i % 37 + 2) / 2) for i in got)
    assert sum(v < 1000 for v in got.values()) <= 60 * 8  # a model lives for its whole task


def test_beam_decode_rows(spark):
    rows = spark.createDataFrame([(1, [[0.0, 9.0, 0.0], [9.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 9.0]]), (2, None), (3, []), (4, [[9.0, 0.0, 0.0]])], "i int, f array<array<double>>")
    got = {r.i: (r.labels, round(r.log_prob, 2)) for r in D.beam_decode(rows, "f", 3).collect()}
    assert got == {1: ([1, 1, 2], got[1][1]), 2: ([], 0), 3: ([], 0), 4: ([], 0)} and -0.01 < got[1][1] <= 0
    assert D.beam_decode(rows.limit(0), "f", 3).collect() == []


def wav(samples, rate, bits=16, channels=1, code=1, extra=b"", extensible=False):
    if code == 3:
        data = np.asarray(samples, f"<f{bits // 8}").tobytes()
    elif bits == 8:
        data = np.round(np.asarray(samples) * 127 + 128).astype(np.uint8).tobytes()
    else:
        whole = np.round(np.asarray(samples) * ((1 << (bits - 1)) - 1)).astype(np.int64)
        data = b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in whole)
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    form += struct.pack("<HHIH", 22, bits, 4, code) + b"\0" * 14 if extensible else b""
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVE" + extra + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize(("bits", "code"), [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3), (64, 3)])
@pytest.mark.parametrize("extensible", [False, True])
def test_sample_formats(bits, code, extensible):
    x = np.sin(np.arange(500) / 9) * 0.9
    got, rate = A.decoded(wav(x, 22050, bits, code=code, extensible=extensible, extra=b"JUNK" + struct.pack("<I", 3) + b"abc\0"))
    assert rate == 22050 and np.abs(got - x).max() < (2 / 128 if bits == 8 else 2 / 32768 if bits == 16 else 1e-6)
    both, _ = A.decoded(wav(np.column_stack([x, -x]).ravel(), 8000, bits, channels=2, code=code))
    assert len(both) == 500 and np.abs(both).max() < 2 / 128


@pytest.mark.parametrize(("rate", "target"), [(8000, 16000), (44100, 16000), (48000, 16000), (16000, 22050), (11025, 16000)])
def test_resampled_sines(rate, target):
    """Sines in the band against their closed form; those above the new band are gone; a constant stays one."""
    n = rate // 2
    for hertz in (100, 440, 0.38 * min(rate, target)):
        got = A.resampled(np.sin(2 * np.pi * hertz * np.arange(n) / rate), rate, target)
        assert len(got) == -(-n * target // rate)
        inner = slice(target // 50, len(got) - target // 50)
        assert np.abs(got - np.sin(2 * np.pi * hertz * np.arange(len(got)) / target))[inner].max() < 2e-3
    if target < rate:
        gone = A.resampled(np.sin(2 * np.pi * 0.56 * target * np.arange(n) / rate), rate, target)
        assert np.abs(gone[target // 50 : -target // 50]).max() < 2e-3
    assert np.abs(A.resampled(np.ones(n), rate, target)[target // 50 : -target // 50] - 1).max() < 1e-9
    assert len(A.resampled(np.zeros(0), rate, target)) == 0 and len(A.resampled(np.ones(1), rate, target)) == -(-target // rate)


def test_waveforms_reach_the_feature_cache(spark, tmp_path):
    x = np.sin(np.arange(800) / 5)
    files = {"a": wav(x, 8000), "b": wav(x, 16000, 24), "cut": wav(x, 16000)[:-301], "bad": b"RIFF....WAVEnothing", "none": None, "odd": wav(x, 8000, 16).replace(b"\x10\x00data", b"\x07\x00data"), "empty": wav([], 8000)}
    df = spark.createDataFrame([(k, "train", bytearray(v) if v is not None else None) for k, v in files.items()], "audio_path string, source_split string, content binary")
    rows = A.with_waveforms(df, 16000)
    got = {r.audio_path: r.input_length for r in rows.collect()}
    assert got == {"a": 1600, "b": 800, "cut": 649, "bad": None, "none": None, "odd": None, "empty": 0}
    folder = sinks.save_features(rows, str(tmp_path), {"source": {"type": "paired"}, "feature_extractor": {"feature_extractor_type": "raw"}, "sampling_rate": 16000})
    back = {r.audio_path: r.features for r in sinks.load_features(spark, folder).collect()}
    assert np.abs(np.array(back["b"]) - x).max() < 1e-5 and back["bad"] is None
