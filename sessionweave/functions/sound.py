"""Measures of sampled sound as numpy functions of one clip: resampling, frames, spectra, cepstra, pitch and voice quality.

Frames are centred: frame k is around sample k * hop, and zeros stand for samples before and after the clip. Transforms are taken of many frames
at once, in steps that bound memory.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np

#: Length of a frame, step, mel bands and coefficients of the speech features.
FRAME, HOP, MELS, COEFFICIENTS = 2048, 512, 128, 13
#: Floor of a power, decibels below the loudest that are kept, and decibels below the loudest frame that count as speech.
LEAST_POWER, RANGE_DB, SPEECH_DB = 1e-10, 80.0, 28.0
#: Frames transformed at once.
_STEP = 1024
#: Zero crossings of the resampling filter on each side, and the shape of its window.
_CROSSINGS, _BETA = 32, 9.0


def resampled(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Samples at another rate, by a windowed sinc below the lower rate's half; each phase of the output has weights of its own."""
    samples = np.asarray(samples, np.float64)
    if rate == wanted or not len(samples):
        return samples
    up, down = wanted // gcd(rate, wanted), rate // gcd(rate, wanted)
    cutoff = min(1.0, up / down)
    half = int(np.ceil(_CROSSINGS / cutoff))
    out = np.empty(-(-len(samples) * up // down))
    padded = np.concatenate([np.zeros(half), samples, np.zeros(half + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    taps = np.arange(-half, half + 1)
    for phase in range(min(up, len(out))):
        at = np.arange(phase, len(out), up)
        whole, rest = divmod(phase * down, up)
        distance = taps - rest / up
        weights = cutoff * np.sinc(cutoff * distance) * np.i0(_BETA * np.sqrt(np.maximum(0, 1 - (distance / (half + 1)) ** 2))) / np.i0(_BETA)
        first = whole + np.arange(len(at)) * down
        for k in range(0, len(at), 4 * _STEP):
            out[at[k : k + 4 * _STEP]] = windows[first[k : k + 4 * _STEP]] @ weights
    return out


def frame_count(n: int, hop: int = HOP) -> int:
    return 1 + n // hop


def frames(samples: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, frame) views of the clip, zeros around it."""
    padded = np.pad(np.asarray(samples, np.float64), frame // 2)
    if len(padded) < frame:
        padded = np.pad(padded, (0, frame - len(padded)))
    return np.lib.stride_tricks.sliding_window_view(padded, frame)[::hop][: frame_count(len(samples), hop)]


@lru_cache(maxsize=8)
def _window(frame: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)


def magnitudes(samples: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, frame / 2 + 1) absolute values of the windowed frames' transforms."""
    cut = frames(samples, frame, hop)
    return np.concatenate([np.abs(np.fft.rfft(cut[k : k + _STEP] * _window(frame), axis=1)) for k in range(0, len(cut), _STEP)])


def _to_hz(mel: np.ndarray) -> np.ndarray:
    """Linear below 1000 Hz, logarithmic above: 15 mels at 1000 Hz, 27 more at 6.4 times that."""
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def _to_mel(hz: float) -> float:
    return hz * 3 / 200 if hz < 1000 else 15 + 27 * np.log(hz / 1000) / np.log(6.4)


@lru_cache(maxsize=8)
def mel_filters(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """(mels, frame / 2 + 1) triangles of equal area, evenly spaced in mels up to half the rate."""
    edges = _to_hz(np.linspace(0, _to_mel(rate / 2), mels + 2))
    hz = np.linspace(0, rate / 2, frame // 2 + 1)
    rising = (hz - edges[:-2, None]) / np.diff(edges)[:-1, None]
    falling = (edges[2:, None] - hz) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rising, falling)) * (2 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache(maxsize=8)
def _cosines(mels: int, coefficients: int) -> np.ndarray:
    k = np.arange(coefficients)[:, None]
    scale = np.where(k == 0, np.sqrt(1 / mels), np.sqrt(2 / mels))
    return scale * np.cos(np.pi * k * (2 * np.arange(mels) + 1) / (2 * mels))


def cepstra(spectrum: np.ndarray, rate: int, mels: int = MELS, coefficients: int = COEFFICIENTS) -> np.ndarray:
    """(frames, coefficients) of magnitudes: cosine transform of the mel bands' decibels, which are at most RANGE_DB below the clip's highest."""
    bands = spectrum**2 @ mel_filters(rate, 2 * (spectrum.shape[1] - 1), mels).T
    loud = 10 * np.log10(np.maximum(LEAST_POWER, bands))
    return np.maximum(loud, loud.max(initial=-np.inf) - RANGE_DB) @ _cosines(mels, coefficients).T


def energies(samples: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Root mean square of each frame."""
    cut = frames(samples, frame, hop)
    return np.concatenate([np.sqrt(np.mean(cut[k : k + _STEP] ** 2, axis=1)) for k in range(0, len(cut), _STEP)])


def centroids(spectrum: np.ndarray, rate: int) -> np.ndarray:
    """Mean frequency of each frame, weighted by magnitude; 0 for a silent frame."""
    total = spectrum.sum(axis=1)
    return spectrum @ np.linspace(0, rate / 2, spectrum.shape[1]) / np.where(total > np.finfo(np.float64).tiny, total, 1)


def speech(samples: np.ndarray, frame: int = FRAME, hop: int = HOP, below: float = SPEECH_DB) -> list[tuple[int, int]]:
    """Samples between start and end where frames are at most `below` decibels under the loudest."""
    if not len(samples):
        return []
    power = np.maximum(LEAST_POWER, energies(samples, frame, hop) ** 2)
    loud = 10 * np.log10(power) - 10 * np.log10(max(LEAST_POWER, power.max())) > -below
    edges = np.flatnonzero(np.diff(np.concatenate([[False], loud, [False]]).astype(np.int8))) * hop
    return [(int(a), int(b)) for a, b in np.minimum(edges, len(samples)).reshape(-1, 2)]


#: Seconds between pitch frames, lowest and highest pitch.
PITCH_STEP, PITCH_FLOOR, PITCH_CEILING = 0.01, 75.0, 500.0
#: Fixed values of the path search: candidates of a frame, strength below which a frame is unvoiced, share of the highest peak below which it is silent,
#: costs of an octave (preferring high candidates), of an octave's jump and of a change of voicing.
CANDIDATES, VOICED, SILENT, OCTAVE, JUMP, SWITCH = 15, 0.45, 0.03, 0.01, 0.35, 0.14


def _candidates(samples: np.ndarray, rate: int, floor: float, ceiling: float, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, and frequencies and strengths of each frame's candidates; the first is unvoiced (frequency 0)."""
    length = int(round(3 * rate / floor))
    half = length // 2
    n = int((len(samples) / rate - length / rate) / step) + 1 if len(samples) >= length else 0
    times = (len(samples) / rate - (n - 1) * step) / 2 + np.arange(n) * step
    frequencies, strengths = np.zeros((n, CANDIDATES)), np.full((n, CANDIDATES), -np.inf)
    window = np.hanning(2 * half + 2)[1:-1]
    size = 1 << (3 * half).bit_length() + 1
    own = np.fft.irfft(np.abs(np.fft.rfft(window, size)) ** 2)[: 2 * half]
    own /= own[0]
    peak = np.max(np.abs(samples - samples.mean())) if n else 0.0
    lags = np.arange(max(2, int(rate / ceiling) - 1), min(int(rate / floor) + 2, 2 * half - 1))
    for a in range(0, n, _STEP):
        centre = np.round(times[a : a + _STEP] * rate).astype(np.int64)
        rows = np.lib.stride_tricks.sliding_window_view(np.pad(samples, (half, half + 1)), 2 * half)[np.clip(centre, 0, len(samples))]
        rows = rows - rows.mean(axis=1, keepdims=True)
        local = np.max(np.abs(rows), axis=1)
        power = np.fft.irfft(np.abs(np.fft.rfft(rows * window, size)) ** 2)[:, : 2 * half]
        r = power / np.where(power[:, :1] > 0, power[:, :1], 1) / own
        strengths[a : a + _STEP, 0] = VOICED + np.maximum(0, 2 - (local / peak if peak else np.zeros(len(rows))) / SILENT * (1 + VOICED))
        before, here, after = r[:, lags - 1], r[:, lags], r[:, lags + 1]
        top = (here > before) & (here >= after) & (here > 0.5 * VOICED)
        bend = 2 * here - before - after
        shift = np.divide(0.5 * (after - before), bend, out=np.zeros_like(here), where=bend > 0)
        hz, height = rate / (lags + shift), np.minimum(here + 0.25 * (after - before) * shift, 1.0)
        worth = np.where(top & (hz >= floor) & (hz <= ceiling), height - OCTAVE * np.log2(floor / np.where(hz > 0, hz, 1)), -np.inf)
        best = np.argsort(-worth, axis=1)[:, : CANDIDATES - 1]
        found = np.take_along_axis(worth, best, axis=1)
        frequencies[a : a + _STEP, 1 : 1 + best.shape[1]] = np.where(np.isfinite(found), np.take_along_axis(hz, best, axis=1), 0)
        strengths[a : a + _STEP, 1 : 1 + best.shape[1]] = found
    return times, frequencies, strengths


def pitch(samples: np.ndarray, rate: int, floor: float = PITCH_FLOOR, ceiling: float = PITCH_CEILING, step: float = PITCH_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Times and fundamental frequencies of frames, 0 where unvoiced: peaks of the autocorrelation divided by the window's, and the best path
    through them."""
    times, hz, worth = _candidates(np.asarray(samples, np.float64), rate, floor, ceiling, step)
    if not len(times):
        return times, np.zeros(0)
    factor = 0.01 / step
    chosen, score = np.zeros(hz.shape, np.int64), worth[0]
    for k in range(1, len(times)):
        a, b = hz[k - 1][:, None], hz[k][None]
        both = (a > 0) & (b > 0)
        jump = np.abs(np.log2(np.where(both, a, 1) / np.where(both, b, 1))) * JUMP
        total = score[:, None] - factor * np.where(both, jump, np.where((a > 0) != (b > 0), SWITCH, 0))
        chosen[k] = np.argmax(total, axis=0)
        score = total[chosen[k], np.arange(hz.shape[1])] + worth[k]
    path = np.zeros(len(times), np.int64)
    path[-1] = int(np.argmax(score))
    for k in range(len(times) - 1, 0, -1):
        path[k - 1] = chosen[k, path[k]]
    return times, hz[np.arange(len(times)), path]


def _peak_near(samples: np.ndarray, first: int, last: int) -> tuple[float, float]:
    """Place and height of the highest sample in a range, between samples by a parabola."""
    first, last = max(first, 1), min(last, len(samples) - 1)
    if first >= last:
        return np.nan, 0.0
    k = first + int(np.argmax(samples[first:last]))
    a, b, c = samples[k - 1], samples[k], samples[k + 1]
    bend = 2 * b - a - c
    shift = 0.5 * (c - a) / bend if bend > 0 else 0.0
    return k + shift, b + 0.25 * (c - a) * shift


def periods(samples: np.ndarray, rate: int, floor: float = PITCH_FLOOR, ceiling: float = PITCH_CEILING) -> list[np.ndarray]:
    """Places (in samples) of one mark a period, for each voiced stretch: from its highest peak outwards, each next mark where the waveform
    resembles that around the last one most, 0.8 to 1.25 periods away."""
    samples = np.asarray(samples, np.float64)
    times, hz = pitch(samples, rate, floor, ceiling)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hz > 0, [False]]).astype(np.int8))).reshape(-1, 2)
    out = []
    for a, b in edges:
        first, last = int((times[a] - PITCH_STEP / 2) * rate), int((times[b - 1] + PITCH_STEP / 2) * rate)
        first, last = max(first, 0), min(last, len(samples))
        at = lambda place: rate / np.interp(place / rate, times[a:b], hz[a:b])  # noqa: E731, B023
        middle = (first + last) / 2
        start, _ = _peak_near(samples, int(middle - at(middle) / 2), int(middle + at(middle) / 2) + 1)
        if not np.isfinite(start):
            continue
        marks = [start]
        for way in (-1, 1):
            place = start
            while True:
                period = at(place)
                half = int(period / 2)
                pattern = samples[max(int(place) - half, 0) : int(place) + half]
                lags = np.arange(int(0.8 * period), int(1.25 * period) + 2)
                starts = max(int(place) - half, 0) + way * lags
                starts = starts[(starts >= max(first - half, 0)) & (starts + len(pattern) <= min(last + half, len(samples)))]
                if not len(starts) or not len(pattern):
                    break
                views = np.lib.stride_tricks.sliding_window_view(samples, len(pattern))[starts]
                likeness = views @ pattern / np.sqrt(np.maximum((views**2).sum(axis=1) * (pattern @ pattern), 1e-300))
                k = int(np.argmax(likeness))
                if likeness[k] < 0.3:
                    break
                shift = starts[k] - max(int(place) - half, 0)
                near, _ = _peak_near(samples, int(place + shift) - max(2, half // 4), int(place + shift) + max(2, half // 4) + 1)
                if not np.isfinite(near) or not first <= near <= last or (near - place) * way <= 0:
                    break
                marks.append(near)
                place = near
        out.append(np.sort(np.array(marks)))
    return out


#: Shortest and longest period in seconds, largest ratio of neighbouring periods and of neighbouring peaks that count.
SHORTEST, LONGEST, PERIOD_RATIO, PEAK_RATIO = 0.0001, 0.02, 1.3, 1.6


def perturbation(samples: np.ndarray, rate: int, marks: list[np.ndarray]) -> tuple[float, float]:
    """Jitter and shimmer: mean absolute difference of neighbouring periods, and of neighbouring peaks, over their mean; NaN without any."""
    samples = np.asarray(samples, np.float64)
    lengths, gaps, heights, steps = [], [], [], []
    for own in marks:
        t = np.diff(own) / rate
        fine = (t >= SHORTEST) & (t <= LONGEST)
        lengths += t[fine].tolist()
        pair = fine[1:] & fine[:-1] & (np.maximum(t[1:], t[:-1]) <= PERIOD_RATIO * np.minimum(t[1:], t[:-1]))
        gaps += np.abs(np.diff(t))[pair].tolist()
        tops = np.array([_peak_near(samples, int(m) - 1, int(m) + 3)[1] for m in own])
        if len(own) < 2:
            continue
        heights += tops.tolist()
        near = fine & (tops[1:] > 0) & (tops[:-1] > 0) & (np.maximum(tops[1:], tops[:-1]) <= PEAK_RATIO * np.minimum(tops[1:], tops[:-1]))
        steps += np.abs(np.diff(tops))[near].tolist()
    ratio = lambda x, y: float(np.mean(x) / np.mean(y)) if x and y and np.mean(y) > 0 else float("nan")
    return ratio(gaps, lengths), ratio(steps, heights)


def harmonicity(samples: np.ndarray, rate: int, floor: float = PITCH_FLOOR, silent: float = 0.1) -> float:
    """Mean ratio of the periodic to the other part in decibels over frames that are loud and periodic; NaN without any."""
    samples = np.asarray(samples, np.float64)
    half, step = int(round(rate / floor)), int(round(PITCH_STEP * rate))
    peak = np.max(np.abs(samples), initial=0.0)
    found = []
    lags = np.arange(max(2, int(rate / PITCH_CEILING)), half)
    for centre in range(2 * half, len(samples) - 2 * half, step):
        base = samples[centre - half : centre + half]
        if np.max(np.abs(base)) < silent * peak:
            continue
        views = np.lib.stride_tricks.sliding_window_view(samples[centre - half : centre + 2 * half], 2 * half)[lags]
        r = views @ base / np.sqrt(np.maximum((views**2).sum(axis=1) * (base @ base), 1e-300))
        k = int(np.argmax(r))
        top = r[k]
        if 0 < k < len(r) - 1 and (bend := 2 * r[k] - r[k - 1] - r[k + 1]) > 0:
            top = r[k] + 0.125 * (r[k + 1] - r[k - 1]) ** 2 / bend
        if top > 0:
            top = min(top, 1 - 1e-10)
            found.append(10 * np.log10(top / (1 - top)))
    return float(np.mean(found)) if found else float("nan")
