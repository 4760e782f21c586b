"""Numerical kernels on NumPy alone: filter design, zero-phase filtering, Welch spectra, peak picking, beat detection.

They are written from the public definitions (Butterworth prototype, bilinear
transform, odd extension with steady-state start, periodic Hann window) and run
inside Arrow-batched grouped functions, one recording at a time.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np


@lru_cache(256)
def butter(order: int, low: float | None, high: float | None, fs: float) -> np.ndarray:
    """Second-order sections of a Butterworth low-pass (``low`` None), high-pass (``high`` None) or band-pass."""
    nyq = fs / 2
    warp = lambda f: 2 * math.tan(math.pi * min(max(f / nyq, 1e-5), 0.9995) / 2)
    proto = [complex(math.cos(t), math.sin(t)) for t in (math.pi * (2 * k + order + 1) / (2 * order) for k in range(order))]
    if low is None:
        poles, zeros, gain = [warp(high) * p for p in proto], [], warp(high) ** order
    elif high is None:
        poles, zeros, gain = [warp(low) / p for p in proto], [0j] * order, 1.0
    else:
        a, b = warp(low), warp(high)
        bw, w0 = b - a, math.sqrt(a * b)
        half = [p * bw / 2 for p in proto]
        root = [np.sqrt(complex(h * h - w0 * w0)) for h in half]
        poles, zeros, gain = [h + r for h, r in zip(half, root, strict=True)] + [h - r for h, r in zip(half, root, strict=True)], [0j] * order, bw**order
    # bilinear transform with sampling at 1 Hz (frequencies are warped for that)
    to_z = lambda s: (2 + s) / (2 - s)
    gain *= float(np.real(np.prod([2 - z for z in zeros] or [1]) / np.prod([2 - p for p in poles])))
    zp, zz = [to_z(p) for p in poles], [to_z(z) for z in zeros]
    zz += [-1 + 0j] * (len(zp) - len(zz))
    up = sorted((p for p in zp if p.imag > 1e-12), key=abs)
    real = sorted((p.real for p in zp if abs(p.imag) <= 1e-12), key=abs)
    zs = sorted((z.real for z in zz), reverse=True)
    sections = []
    pairs = [(-2 * p.real, abs(p) ** 2) for p in up]
    while real:
        r = real.pop()
        if real:
            q = real.pop()
            pairs.append((-(r + q), r * q))
        else:
            pairs.append((-r, 0.0))
    for a1, a2 in pairs:
        n = 1 if a2 == 0.0 and len(zs) % 2 else 2
        mine = [zs.pop(0), zs.pop()] if n == 2 and len(zs) >= 2 else [zs.pop(0)] if zs else []
        num = np.poly(mine) if mine else np.array([1.0])
        sections.append([*np.pad(num, (0, 3 - len(num))), 1.0, a1, a2])
    sos = np.array(sections)
    sos[0, :3] *= gain
    return sos


@lru_cache(256)
def notch(freq: float, q: float, fs: float) -> np.ndarray:
    """A second-order notch as one section."""
    w = 2 * math.pi * freq / fs
    beta = math.tan(w / q / 2)
    g = 1 / (1 + beta)
    return np.array([[g, -2 * g * math.cos(w), g, 1.0, -2 * g * math.cos(w), 2 * g - 1]])


def sos_state(sos: np.ndarray) -> np.ndarray:
    """The state of a filter that has seen a constant 1 for ever."""
    out, scale = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        out[i] = scale * np.array([gain - b0, b2 - a2 * gain])
        scale *= gain
    return out


BLOCK = 64


@lru_cache(256)
def _block_form(raw: bytes) -> tuple[np.ndarray, ...]:
    """A cascade over ``BLOCK`` samples as matrices: output from input and from state, state from input and from state."""
    sos = np.frombuffer(raw).reshape(-1, 6)
    k, pulse = 2 * len(sos), np.eye(1, BLOCK)[0]
    h, _ = _by_sample(sos, pulse, np.zeros((len(sos), 2)))
    out = np.zeros((BLOCK, BLOCK))
    for i in range(BLOCK):
        out[i:, i] = h[: BLOCK - i]
    free, move, feed = np.zeros((BLOCK, k)), np.zeros((k, k)), np.zeros((k, BLOCK))
    for j in range(k):
        y, s = _by_sample(sos, np.zeros(BLOCK), np.eye(k)[j].reshape(-1, 2))
        free[:, j], move[:, j] = y, s.ravel()
    state = np.zeros((len(sos), 2))
    for i, v in enumerate(pulse):
        _, state = _by_sample(sos, np.array([v]), state)
        feed[:, BLOCK - 1 - i] = state.ravel()
    return out, free, feed, move


def sos_filter(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Causal filtering (transposed direct form II) with carried state: whole blocks by matrix products, the rest sample by sample."""
    state = np.zeros((len(sos), 2)) if state is None else state.copy()
    n = len(x) // BLOCK
    if n < 4:
        return _by_sample(sos, x, state)
    out, free, feed, move = _block_form(np.ascontiguousarray(sos, float).tobytes())
    blocks = x[: n * BLOCK].reshape(n, BLOCK)
    enter, at = blocks @ feed.T, np.empty((n, 2 * len(sos)))
    s = state.ravel()
    for i in range(n):
        at[i] = s
        s = move @ s + enter[i]
    y = (blocks @ out.T + at @ free.T).ravel()
    rest, state = _by_sample(sos, x[n * BLOCK :], s.reshape(-1, 2))
    return np.concatenate([y, rest]), state


def _by_sample(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y, state = x.tolist(), state.copy()
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
        s0, s1 = state[i].tolist()
        out = []
        push = out.append
        for v in y:
            w = b0 * v + s0
            s0 = b1 * v - a1 * w + s1
            s1 = b2 * v - a2 * w
            push(w)
        y, state[i] = out, (s0, s1)
    return np.array(y), state


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, over an odd extension, from the steady state."""
    trailing = min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    pad = 3 * (2 * len(sos) + 1 - trailing)
    if len(x) <= pad:
        return x.copy()
    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    zi = sos_state(sos)
    y, _ = sos_filter(sos, ext, zi * ext[0])
    y, _ = sos_filter(sos, y[::-1], zi * y[-1])
    return y[::-1][pad:-pad]


def bandpass(x: np.ndarray, band: tuple[float, float], order: int, fs: float) -> np.ndarray:
    nyq = fs / 2
    lo, hi = max(band[0] / nyq, 1e-5) * nyq, min(band[1] / nyq, 0.9995) * nyq
    return zero_phase(butter(order, lo, hi, fs), x) if lo < hi else x.copy()


def welch(x: np.ndarray, fs: float, nperseg: int = 256) -> tuple[np.ndarray, np.ndarray]:
    n = min(nperseg, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segs = np.lib.stride_tricks.sliding_window_view(x, n)[:: n - n // 2]
    spec = np.fft.rfft((segs - segs.mean(1, keepdims=True)) * window)
    p = (np.abs(spec) ** 2).mean(0) / (fs * (window**2).sum())
    p[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def fill_gaps(x: np.ndarray) -> np.ndarray:
    ok = np.isfinite(x)
    if ok.all():
        return x
    if ok.sum() < 2:
        return np.where(ok, x, 0.0)
    return np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok])


def moving_mean(x: np.ndarray, w: int) -> np.ndarray:
    """Centred mean with replicated edges; an even window leans to the left."""
    ext = np.r_[np.full(w // 2, x[0]), x, np.full(w - 1 - w // 2, x[-1])]
    c = np.cumsum(np.r_[0.0, ext])
    return (c[w:] - c[:-w]) / w


def baseline(x: np.ndarray, fs: float, seconds: float = 0.6) -> np.ndarray:
    w = max(1, min(len(x) - 1, max(3, int(seconds * fs))))
    return moving_mean(x, w + 1 - w % 2)


def trailing_mean(x: np.ndarray, w: int) -> np.ndarray:
    c = np.cumsum(x)
    return np.r_[c[:w] / np.arange(1, min(w, len(x)) + 1), (c[w:] - c[:-w]) / w]


def derivative(x: np.ndarray, fs: float) -> np.ndarray:
    d = np.zeros_like(x)
    d[1:-1] = (x[2:] - x[:-2]) * fs / 2
    d[0], d[-1] = d[1], d[-2]
    return d


def find_peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Local maxima (middle of a plateau), then by height, then greedily by distance, then by prominence."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.r_[0, edge + 1], np.r_[edge, len(x) - 1]
    inner = np.arange(1, len(starts) - 1)
    top = inner[(x[starts[inner]] > x[starts[inner - 1]]) & (x[starts[inner]] > x[starts[inner + 1]])]
    peaks = every = (starts[top] + ends[top]) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1 and len(peaks):
        lo = np.searchsorted(peaks, peaks - distance + 1).tolist()
        hi = np.searchsorted(peaks, peaks + distance).tolist()
        keep = bytearray(b"\1") * len(peaks)
        for i in np.argsort(x[peaks], kind="stable")[::-1].tolist():
            if keep[i]:
                keep[lo[i] : hi[i]] = bytes(hi[i] - lo[i])
                keep[i] = 1
        peaks = peaks[np.frombuffer(keep, np.uint8) == 1]
    if prominence is not None and len(peaks):
        peaks = peaks[_prominences(x, every)[np.searchsorted(every, peaks)] >= prominence]
    return peaks


def _valleys(heights: list[float], floors: list[float]) -> list[float]:
    """For each maximum the lowest sample since the last higher one; ``floors`` lie before each of them.

    The stack has the maxima that nothing higher has followed, highest first,
    with their own valleys: each goes on and off it once.
    """
    stack: list[tuple[float, float]] = []
    out = []
    for h, low in zip(heights, floors, strict=True):
        while stack and stack[-1][0] <= h:
            low = min(low, stack.pop()[1])
        stack.append((h, low))
        out.append(low)
    return out


def _prominences(x: np.ndarray, maxima: np.ndarray) -> np.ndarray:
    """How far each of all local maxima stands above the higher of its two valleys, in linear time.

    Between two maxima the wave falls and rises once, so the way to the next
    higher sample has its lowest one among the floors between maxima.
    """
    floors = np.minimum.reduceat(x, np.r_[0, maxima])
    h = x[maxima].tolist()
    left = _valleys(h, floors[:-1].tolist())
    right = _valleys(h[::-1], floors[:0:-1].tolist())[::-1]
    return x[maxima] - np.maximum(left, right)


def refine(x: np.ndarray, at: int, reach: int) -> int:
    """The signed extreme near a candidate; an isolated spike leaves the candidate where it is."""
    lo, hi = max(0, at - reach), min(len(x), at + reach + 1)
    part = x[lo:hi]
    k = int(part.argmax()) if abs(part.max()) >= abs(part.min()) else int(part.argmin())
    k += lo
    near = [abs(x[j]) for j in (k - 1, k + 1) if 0 <= j < len(x)]
    return at if lo < k < hi - 1 and max(near) < 0.05 * abs(x[k]) else k


def detect_beats(x: np.ndarray, fs: float, searchback: bool = True, gap_factor: float = 1.66, searchback_s: float = 0.36) -> np.ndarray:
    """Adaptive-threshold beat detection over a band-passed wave.

    After it, an interval of over ``gap_factor`` medians is searched for
    ``searchback_s`` from the end of its first beat's refractory time on.
    """
    refractory, w = int(0.2 * fs), max(1, int(0.15 * fs))
    if len(x) < 2 * refractory:
        return np.zeros(0, np.int64)
    mwi = trailing_mean(derivative(x, fs) ** 2, w)
    calib = mwi[: max(1, min(int(2 * fs), len(mwi) // 4))]
    first = find_peaks(calib, distance=refractory)
    spki = float(mwi[first].mean()) if len(first) else 0.5 * float(calib.max(initial=0))
    npki = 0.1 * spki
    reach, found = int(0.04 * fs), []
    for c in find_peaks(mwi, distance=max(1, refractory // 2)):
        if mwi[c] > npki + 0.25 * (spki - npki) and (not found or c - found[-1] >= refractory):
            spki = 0.125 * mwi[c] + 0.875 * spki
            r = refine(x, int(c), reach)
            if r not in found[-2:]:
                found.append(r)
        else:
            npki = 0.125 * mwi[c] + 0.875 * npki
    if searchback and len(found) >= 3:
        limit, half = gap_factor * np.median(np.diff(found)), 0.5 * (npki + 0.25 * (spki - npki))
        more = []
        for a, b in zip(found, found[1:], strict=False):
            if b - a > limit:
                lo = a + refractory
                hi = min(len(mwi), lo + int(searchback_s * fs))
                if lo < hi:
                    k = lo + int(mwi[lo:hi].argmax())
                    r = refine(x, k, reach)
                    span = refractory + reach
                    near = found[bisect_left(found, k - span) : bisect_right(found, k + span)] + more[-8:]
                    if mwi[k] > half and all(abs(k - f) >= refractory and abs(r - f) >= refractory for f in near):
                        more.append(r)
        found = sorted({*found, *more})
    return np.array(found, np.int64)


def detect_chunked(x: np.ndarray, fs: float, chunk_s: float = 60.0, overlap_s: float = 1.0) -> np.ndarray:
    """Chunks that overlap; a later chunk gives only the beats past its overlap."""
    n, over = int(chunk_s * fs), int(overlap_s * fs)
    if len(x) <= n + over:
        return detect_beats(x, fs)
    found: set[int] = set()
    for k, a in enumerate(range(0, len(x), n - over)):
        for p in detect_beats(x[a : a + n], fs):
            if k == 0 or p >= over:
                found.add(a + int(p))
    return np.array(sorted(found), np.int64)


def pan_tompkins(x: np.ndarray, fs: float) -> np.ndarray:
    mwi = trailing_mean(np.diff(x, prepend=x[0]) ** 2, max(1, int(0.15 * fs)))
    return find_peaks(mwi, height=0.25 * mwi.max(), distance=int(0.2 * fs))


def hamilton(x: np.ndarray, fs: float) -> np.ndarray:
    y = trailing_mean(np.abs(np.diff(x, prepend=x[0])), max(1, int(0.08 * fs)))
    return find_peaks(y, height=0.35 * y[: int(2 * fs)].mean(), distance=int(0.2 * fs))


def christov(x: np.ndarray, fs: float) -> np.ndarray:
    y = trailing_mean((np.gradient(x) if len(x) > 1 else np.zeros(len(x))) ** 2 + x**2, max(1, int(0.05 * fs)))
    return find_peaks(y, height=0.5 * np.percentile(y, 75), distance=int(0.2 * fs))


def search_again(x: np.ndarray, mwi: np.ndarray, beats: np.ndarray, fs: float) -> list[int]:
    """Beats missed in intervals of over 1.66 medians: peaks of the integral of at least 0.4 of its maximum, a refractory time apart, each moved to the largest deflection near it."""
    if len(beats) < 2:
        return []
    gaps, reach, have, added = np.diff(beats), int(0.04 * fs), set(beats.tolist()), []
    limit, least = 1.66 * np.median(gaps), 0.4 * float(mwi.max())
    for a, b in zip(beats[:-1][gaps > limit].tolist(), beats[1:][gaps > limit].tolist(), strict=True):
        for f in find_peaks(mwi[a:b], height=least, distance=max(1, int(0.2 * fs))).tolist():
            lo = max(0, a + f - reach)
            r = lo + int(np.abs(x[lo : a + f + reach + 1]).argmax())
            if a + f not in have and r not in have:
                have.add(r)
                added.append(r)
    return sorted(added)


def modular_beats(x: np.ndarray, fs: float) -> np.ndarray:
    """Beats of the adaptive detector, with those that a second search of its long intervals finds."""
    first = detect_beats(x, fs, searchback=False)
    mwi = trailing_mean(derivative(x, fs) ** 2, max(1, int(0.15 * fs))) if len(first) else x
    return np.array(sorted({*first.tolist(), *search_again(x, mwi, first, fs)}), np.int64)


DETECTORS = {"adaptive": detect_beats, "modular": modular_beats, "pan_tompkins": pan_tompkins, "hamilton": hamilton, "christov": christov}


def pulse_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    return find_peaks(x, distance=max(1, int(60 / 220 * fs)), prominence=0.3 * x.std())


def snr_proxy(x: np.ndarray) -> float | None:
    x = x[np.isfinite(x)]
    if len(x) < 20:
        return None
    amp, noise = np.subtract(*np.percentile(x, [95, 5])), np.diff(x).std() / math.sqrt(2)
    return None if noise < 1e-12 or amp < 1e-9 else float(np.clip(20 * math.log10(amp / noise), -20, 60))


def kurtosis(x: np.ndarray) -> float:
    c = x - x.mean()
    v = (c**2).mean()
    return float((c**4).mean() / v**2 - 3) if v > 0 else 0.0


def powerline(freqs: np.ndarray, p: np.ndarray, n: int, fs: float, freq: float) -> bool:
    if n < int(2 * fs) or fs / 2 <= freq * 1.05:
        return False
    k = int(np.abs(freqs - freq).argmin())
    out = np.ones(len(p), bool)
    out[max(0, k - 5) : k + 6] = False
    if not out.any():
        return False
    floor = float(np.median(p[out])) + 1e-30
    return 10 * math.log10(max(float(p[k]), 1e-30) / floor) > 10


def emg(x: np.ndarray, freqs: np.ndarray, p: np.ndarray, fs: float) -> tuple[float, str]:
    """Share of power above 100 Hz, or a kurtosis stand-in where the rate is too low for it."""
    if fs / 2 <= 100:
        r = float(np.clip(kurtosis(np.diff(x)) / 20, 0, 1))
    else:
        r = float(p[freqs > 100].sum() / (p.sum() + 1e-30))
    return r, "SEVERE EMG" if r >= 0.35 else "MODERATE EMG" if r >= 0.15 else "MILD EMG" if r >= 0.05 else "CLEAN"


def spectral_entropy(x: np.ndarray, fs: float) -> float | None:
    if len(x) < 2 * fs:
        return None
    _, p = welch(x, fs, 1024)
    q = p / max(p.sum(), 1e-30)
    q = q[q > 0]
    return float(np.clip(-(q * np.log2(q)).sum() / math.log2(len(p)), 0, 1)) if len(p) > 1 else None
