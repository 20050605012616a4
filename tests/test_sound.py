"""Sound measures against naive loops, made-up tones, glides and pulse trains, and audio files of every form."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionweave.functions import sound
from sessionweave.operators import sound as measured
from sessionweave.operators import speech
from sessionweave.sources import audio


def tone(hz, rate, seconds, height=0.5):
    return height * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


def frequency(x, rate):
    """Of the strongest component, by a parabola through the spectrum's logarithm."""
    s = np.log(np.abs(np.fft.rfft(x * np.hanning(len(x)))) + 1e-12)
    k = int(np.argmax(s[1:-1])) + 1
    return (k + 0.5 * (s[k + 1] - s[k - 1]) / (2 * s[k] - s[k - 1] - s[k + 1])) * rate / len(x)


@pytest.mark.parametrize("rate", [8000, 11025, 22050, 44100, 48000])
def test_resampling_keeps_tones_and_drops_what_is_too_high(rate):
    out = sound.resampled(tone(440, rate, 0.7), rate, 16_000)
    assert len(out) == math.ceil(int(rate * 0.7) * 16_000 / rate)
    inner = out[800:-800]
    assert abs(frequency(inner, 16_000) - 440) < 0.1 and np.allclose(inner, tone(440, 16_000, 0.7)[800 : len(out) - 800], atol=2e-4)
    if rate > 20_000:
        assert np.abs(sound.resampled(tone(9500, rate, 0.3), rate, 16_000)[800:-800]).max() < 1e-3


def naive_frames(x, frame, hop):
    padded = [0.0] * (frame // 2) + list(x) + [0.0] * (frame // 2)
    return [padded[k * hop : k * hop + frame] for k in range(1 + len(x) // hop)]


@pytest.mark.parametrize("size", [0, 1, 5, 16, 67])
def test_frames_equal_naive_loops(size):
    rate, frame, hop, mels, n = 8000, 16, 4, 5, 4
    x = np.random.default_rng(size).normal(size=size)
    spectrum = sound.magnitudes(x, frame, hop)
    hz = [b * rate / frame for b in range(frame // 2 + 1)]
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)
    back = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * math.log(6.4) / 27)
    edges = [back(k * mel(rate / 2) / (mels + 1)) for k in range(mels + 2)]
    bands = []
    for k, cut in enumerate(naive_frames(x, frame, hop)):
        own = [abs(sum(v * (0.5 - 0.5 * math.cos(2 * math.pi * j / frame)) * np.exp(-2j * math.pi * b * j / frame) for j, v in enumerate(cut))) for b in range(frame // 2 + 1)]
        assert np.allclose(spectrum[k], own)
        assert math.isclose(sound.energies(x, frame, hop)[k], math.sqrt(sum(v * v for v in cut) / frame))
        total = sum(own)
        assert math.isclose(sound.centroids(spectrum, rate)[k], sum(f * m for f, m in zip(hz, own)) / total if total > 1e-300 else 0, abs_tol=1e-9)
        bands.append([10 * math.log10(max(1e-10, sum(m * m * max(0, min((f - a) / (b - a), (c - f) / (c - b))) * 2 / (c - a) for f, m in zip(hz, own)))) for a, b, c in zip(edges, edges[1:], edges[2:])])
    most = max(map(max, bands))
    wanted = [[sum(max(d, most - 80) * math.cos(math.pi * c * (2 * i + 1) / (2 * mels)) for i, d in enumerate(row)) * math.sqrt((1 if c == 0 else 2) / mels) for c in range(n)] for row in bands]
    assert np.allclose(sound.cepstra(spectrum, rate, mels, n), wanted)


def test_loud_stretches():
    x = np.concatenate([np.zeros(8192), tone(300, 16_000, 1), np.zeros(16384), tone(300, 16_000, 0.5, 0.2), np.zeros(9000)])
    (a, b), (c, d) = sound.speech(x)
    assert abs(a - 8192) <= 1024 and abs(b - 24192) <= 1536 and abs(c - 40576) <= 1024 and abs(d - 48576) <= 1536
    assert sound.speech(np.zeros(5000)) == [(0, 5000)] and sound.speech(np.zeros(0)) == []


def glide(start, end, rate, seconds):
    t = np.arange(int(rate * seconds)) / rate
    phase = 2 * np.pi * (start * t + (end - start) * t**2 / (2 * seconds))
    return sum(np.sin(k * phase) / k for k in (1, 2, 3)) * 0.3, start + (end - start) * t / seconds


@pytest.mark.parametrize(("start", "end"), [(100, 220), (300, 150), (440, 440)])
def test_pitch_of_glides_and_of_silence(start, end):
    rate = 16_000
    x, true = glide(start, end, rate, 1.5)
    x = np.concatenate([np.zeros(8000), x, np.zeros(8000)])
    times, hz = sound.pitch(x, rate)
    inside = (times > 0.55) & (times < 1.95)
    assert (hz[inside] > 0).all()
    assert np.abs(hz[inside] / np.interp(times[inside] - 0.5, np.arange(len(true)) / rate, true) - 1).max() < 0.01
    assert (hz[(times < 0.45) | (times > 2.05)] == 0).all()
    assert len(sound.pitch(np.zeros(100), rate)[0]) == 0 and (sound.pitch(np.zeros(16_000), rate)[1] == 0).all()
    assert (sound.pitch(np.random.default_rng(1).normal(size=16_000), rate)[1] > 0).mean() < 0.1


def pulses(rate, seconds, hz, jitter, shimmer):
    """Periods alternate by jitter and heights by shimmer, so that neighbours differ by these shares of the mean."""
    x, place, k = np.zeros(int(rate * seconds)), rate / hz, 0
    shape = np.arange(-40, 41)
    while place < len(x) - 60:
        whole = int(round(place))
        x[whole - 40 : whole + 41] += (0.5 + 0.25 * shimmer * (-1) ** k) * np.exp(-(((shape + whole - place) / 6) ** 2))
        place += rate / hz * (1 + 0.5 * jitter * (-1) ** k)
        k += 1
    return x


@pytest.mark.parametrize(("jitter", "shimmer"), [(0.0, 0.0), (0.02, 0.0), (0.0, 0.1), (0.03, 0.08)])
def test_known_perturbation_is_found(jitter, shimmer):
    rate = 16_000
    x = pulses(rate, 1.5, 120, jitter, shimmer)
    found = sound.perturbation(x, rate, sound.periods(x, rate))
    assert abs(found[0] - jitter) < 0.002 and abs(found[1] - shimmer) < 0.01


def test_harmonics_to_noise_of_known_noise():
    rate, rng = 16_000, np.random.default_rng(2)
    x = glide(150, 150, rate, 1.5)[0]
    clean = sound.harmonicity(x, rate)
    for wanted in (20.0, 10.0):
        noise = rng.normal(size=len(x)) * np.sqrt(np.mean(x**2) / 10 ** (wanted / 10))
        assert abs(sound.harmonicity(x + noise, rate) - wanted) < 1.5
    assert clean > 35 and math.isnan(sound.harmonicity(np.zeros(0), rate))


def test_columns_of_clips(spark):
    x = np.concatenate([np.zeros(4000), glide(120, 160, 16_000, 0.6)[0], np.zeros(4000)])
    clips = spark.createDataFrame([("a", x.tolist()), ("b", []), ("c", None), ("d", [0.0] * 3000)], "rms string, frame array<double>")
    spectrum = measured.spectrum_frames(clips, ["rms"], "frame").toDF("k", "frame", "rms", "centroid")
    counts = {r["k"]: r["count"] for r in spectrum.groupBy("k").count().collect()}
    assert counts == {"a": 1 + len(x) // 512, "b": 1, "c": 1, "d": 6}
    stats = {r["k"]: r for r in speech.spectrum_stats(spectrum, ["k"]).collect()}
    assert math.isclose(stats["a"]["rms_mean"], sound.energies(x).mean()) and stats["d"]["spectral_centroid_mean"] == 0.0
    cepstra = speech.mfcc_stats(measured.mfcc_frames(clips, ["rms"], "frame").withColumnRenamed("rms", "k"), ["k"])
    assert {r["k"] for r in cepstra.collect()} == set("abcd")
    regions = {r["rms"]: r["intervals"] for r in measured.speech_regions(clips, ["rms"], "frame").collect()}
    assert len(regions["a"]) == 1 and regions["b"] == [] and [tuple(i) for i in regions["d"]] == [(0, 3000)]
    pitch = speech.pitch_stats(measured.pitch_frames(clips, ["rms"], "frame").withColumnRenamed("rms", "k"), ["k"]).first()
    assert pitch["k"] == "a" and abs(pitch["f0_min"] - 120) < 4 and abs(pitch["f0_max"] - 160) < 4
    voice = {r["rms"]: r for r in measured.voice_quality(clips, ["rms"], "frame").collect()}
    assert voice["a"]["hnr_mean"] > 20 and tuple(voice["b"])[1:] == (0.0, 0.0, 0.0) == tuple(voice["d"])[1:]


def stored(values, rate, kind):
    form, bits, data = {
        "u8": (1, 8, np.rint(values * 128 + 128).clip(0, 255).astype(np.uint8).tobytes()),
        "i16": (1, 16, np.rint(values * 32768).astype("<i2").tobytes()),
        "i24": (1, 24, np.rint(values * 2**31).astype("<i4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()),
        "i32": (1, 32, np.rint(values * 2**31).astype("<i4").tobytes()),
        "f32": (3, 32, values.astype("<f4").tobytes()),
        "f64": (3, 64, values.astype("<f8").tobytes()),
    }[kind]
    channels = values.shape[1]
    head = struct.pack("<HHIIHH", form, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if kind == "i24":  # by the longer description
        head = struct.pack("<H", 0xFFFE) + head[2:] + struct.pack("<HHIH14x", 22, 24, 3, 1)
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"odd\0" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize("kind", ["u8", "i16", "i24", "i32", "f32", "f64"])
def test_audio_of_every_form(kind):
    values = np.stack([tone(200, 8000, 0.1), tone(200, 8000, 0.1, 0.25)], axis=1)
    found, rate = audio.parse_riff(stored(values, 8000, kind))
    assert rate == 8000 and np.allclose(found, values, atol=1e-2 if kind == "u8" else 1e-4)


def test_audio_is_loaded_and_written(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    both = np.stack([tone(440, 44_100, 0.5), tone(440, 44_100, 0.5, 0.3)], axis=1)
    whole = stored(both, 44_100, "i16")
    for name, data in {"good.wav": whole, "deep/cut.wav": whole[: len(whole) // 2 + 1], "bad.wav": b"RIFFxxxxWAVE", "text.wav": b"text", "empty.wav": stored(both[:0], 8000, "f32"), "odd.wav": whole.replace(struct.pack("<HH", 1, 2), struct.pack("<HH", 7, 2), 1), "other.mp3": b""}.items():
        (tmp_path / "in" / name).write_bytes(data)
    loaded = audio.read_audio(spark, str(tmp_path / "in")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = {r["name"]: r for r in loaded.collect()}
    assert set(rows) == {"good.wav", "cut.wav", "bad.wav", "text.wav", "empty.wav", "odd.wav"}
    good = np.array(rows["good.wav"]["audio"])
    assert rows["good.wav"]["rate"] == 16_000 and rows["good.wav"]["duration_sec"] == 0.5 and np.allclose(good[500:-500], tone(440, 16_000, 0.5, 0.4)[500:-500], atol=1e-3)
    assert rows["cut.wav"]["status"] == "available" and 0.2 < rows["cut.wav"]["duration_sec"] < 0.3
    reasons = {n: rows[n]["error"] for n in ("bad.wav", "text.wav", "empty.wav", "odd.wav")}
    assert reasons == {"bad.wav": "no description of the sound", "text.wav": "not a RIFF audio file", "empty.wav": "the audio is empty", "odd.wav": "sound of form 7 and 16 bits"}
    out = str(tmp_path / "out")
    written = {r["name"]: r for r in audio.write_audio(loaded.withColumn("name", F.split("name", r"\.")[0]), out, "name").collect()}
    assert {n: r["samples"] for n, r in written.items()} == {"good": 8000, "cut": len(rows["cut.wav"]["audio"])}
    again = {r["path"].split("/")[-1]: r for r in audio.read_audio(spark, out).collect()}
    assert set(again) == {"good.wav", "cut.wav"} and np.allclose(again["good.wav"]["audio"], good, atol=1e-4)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["cut.wav", "good.wav"]
