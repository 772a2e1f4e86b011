"""Signal primitives on numpy; every filter works on the last axis of a batch of rows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def butter_sos(order: int, band, fs: float, kind: str = "band") -> np.ndarray:
    """Butterworth sections (b0 b1 b2 a0 a1 a2): analogue poles, warped edges, bilinear transform."""
    edges = np.atleast_1d(np.asarray(band, float))
    w = 2 * fs * np.tan(np.pi * edges / fs)
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    if kind == "low":
        p, z, dc = poles * w[0], np.full(order, -1.0), 1.0
    elif kind == "high":
        p, z, dc = w[0] / poles, np.full(order, 1.0), -1.0
    else:
        mid, width = np.sqrt(w[0] * w[1]), w[1] - w[0]
        half = poles * width / 2
        root = np.sqrt(half**2 - mid**2 + 0j)
        p = np.concatenate([half + root, half - root])
        z = np.concatenate([np.full(order, 1.0), np.full(order, -1.0)])
        dc = np.exp(1j * 2 * np.arctan(mid / (2 * fs)))
    pz = (1 + p / (2 * fs)) / (1 - p / (2 * fs))
    upper = sorted(pz[pz.imag > 1e-12], key=lambda v: (abs(v), v.imag))
    real = sorted(pz[np.abs(pz.imag) <= 1e-12].real)
    pairs = [(v, np.conj(v)) for v in upper] + [(real[i], real[i + 1] if i + 1 < len(real) else None) for i in range(0, len(real), 2)]
    ones, minus = list(z[z > 0]), list(z[z < 0])
    sos = []
    for a, b in pairs:
        zz = []
        for _ in range(2 if b is not None else 1):
            src = ones if len(ones) >= len(minus) else minus
            zz.append(src.pop())
        num = np.poly(zz)
        den = np.real(np.poly([a] if b is None else [a, b]))
        sos.append(np.concatenate([np.pad(num, (0, 3 - len(num))), np.pad(den, (0, 3 - len(den)))]))
    sos = np.array(sos)
    at = 1.0
    for s in sos:
        at *= np.polyval(s[:3], dc) / np.polyval(s[3:], dc) if not (s[2] == 0 and s[5] == 0) else np.polyval(s[:2], dc) / np.polyval(s[3:5], dc)
    sos[0, :3] /= abs(at)
    return sos


def _steady(sos: np.ndarray) -> np.ndarray:
    """State of each section for a constant input of 1."""
    out, scale = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z1 = b2 - a2 * gain
        out[i] = [scale * (b1 - a1 * gain + z1), scale * z1]
        scale *= gain
    return out


def sosfilt(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Run the sections over time, all rows at once; state has shape (sections, 2, rows)."""
    y = np.array(x, float).T.copy()
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        z1, z2 = state[i]
        for t in range(len(y)):
            v = y[t]
            o = b0 * v + z1
            z1 = b1 * v - a1 * o + z2
            z2 = b2 * v - a2 * o
            y[t] = o
    return y.T


@lru_cache(maxsize=32)
def _responses(raw: bytes, sections: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` samples of the impulse response, and of what the steady state for 1 leaves behind without input.

    A causal filter's first n outputs depend on no more of its impulse response, so filtering by
    these is exact up to rounding, and the loop over time runs once per filter and length."""
    sos = np.frombuffer(raw).reshape(sections, 6)
    x = np.zeros((1, n))
    free = sosfilt(sos, x, np.repeat(_steady(sos)[:, :, None], 1, axis=2))[0]
    x[0, 0] = 1
    return sosfilt(sos, x, np.zeros((sections, 2, 1)))[0], free


def sosfiltfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering with odd reflection at both ends."""
    x = np.atleast_2d(np.asarray(x, float))
    taps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad = min(3 * taps, x.shape[1] - 1)
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2: -pad - 2: -1]], axis=1) if pad > 0 else x
    n = ext.shape[1]
    impulse, free = _responses(sos.tobytes(), len(sos), n)
    size = 1 << (2 * n - 1).bit_length()
    gain = np.fft.rfft(impulse, size)
    for _ in range(2):
        ext = (np.fft.irfft(np.fft.rfft(ext, size, axis=1) * gain, size, axis=1)[:, :n] + ext[:, :1] * free)[:, ::-1]
    return ext[:, pad: pad + x.shape[1]] if pad > 0 else ext


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power density: periodic Hann windows, half overlapping, each less its mean."""
    x = np.atleast_2d(np.asarray(x, float))
    size = min(size, x.shape[1])
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    step = max(1, size - size // 2)
    parts = np.stack([x[:, i: i + size] for i in range(0, x.shape[1] - size + 1, step)], axis=1)
    spec = np.abs(np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * win, axis=2)) ** 2 / (fs * (win**2).sum())
    spec[:, :, 1: (None if size % 2 else -1)] *= 2
    return np.fft.rfftfreq(size, 1 / fs), spec.mean(axis=1)


def find_peaks(x: np.ndarray, height: float, distance: int = 1) -> np.ndarray:
    """Local maxima (the middle of a plateau) of at least ``height``; the higher of two closer than ``distance`` stays."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.empty(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    stop = np.append(edge[1:], len(x))
    v = x[edge]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    at = (edge[top] + stop[top] - 1) // 2
    at = at[x[at] >= height]
    if distance > 1 and len(at):
        keep = np.ones(len(at), bool)
        for i in np.argsort(x[at], kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(at - at[i]) < distance
                near[i] = False
                keep[near] = False
        at = at[keep]
    return at


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1: (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1)


def true_runs(flag: np.ndarray) -> np.ndarray:
    """Half-open (start, stop) of the runs of true."""
    d = np.diff(np.concatenate([[0], np.asarray(flag, np.int8), [0]]))
    return np.stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)], axis=1)


def moving_average(x: np.ndarray, size: int) -> np.ndarray:
    return np.convolve(x, np.ones(size) / size, mode="same")


def fir_band(taps: int, band, fs: float) -> np.ndarray:
    """Band-pass by windowed sincs under a Hamming window, of unit gain at the band's middle; an even length gets one tap more."""
    taps += 1 - taps % 2
    t = np.arange(taps) - taps // 2
    low, high = (2 * np.asarray(band, float) / fs)
    h = (high * np.sinc(high * t) - low * np.sinc(low * t)) * (0.54 + 0.46 * np.cos(2 * np.pi * t / (taps - 1)))
    return h / np.abs(h @ np.exp(-1j * np.pi * (low + high) / 2 * t))


def firfiltfilt(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A symmetric filter run forth and back, with odd reflection at both ends: its squared response without delay."""
    pad = min(3 * len(h), len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2: -pad - 2: -1]]) if pad > 0 else x
    size = 1 << (len(ext) + 2 * len(h)).bit_length()
    y = np.fft.irfft(np.fft.rfft(ext, size) * np.fft.rfft(h, size) ** 2, size)
    return y[len(h) - 1 + pad: len(h) - 1 + pad + len(x)]


def notch_sos(freq: float, q: float, fs: float) -> np.ndarray:
    """Second-order notch with a width of freq / q."""
    w = 2 * np.pi * freq / fs
    beta = np.tan(w / q / 2)
    gain = 1 / (1 + beta)
    return np.array([[gain, -2 * gain * np.cos(w), gain, 1.0, -2 * gain * np.cos(w), 2 * gain - 1]])
