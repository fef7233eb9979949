"""Signal kernels in numpy, for one signal at a time."""

from __future__ import annotations

import numpy as np

# fixed values: coefficients of the cosine-sum windows
WINDOWS = {"hann": [0.5, 0.5], "hamming": [0.54, 0.46], "blackman": [0.42, 0.5, 0.08], "flattop": [0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368]}


def window(name: str, n: int) -> np.ndarray:
    """A periodic window."""
    if name == "bartlett":
        return 1 - np.abs(2 * np.arange(n) / n - 1)
    x = 2 * np.pi * np.arange(n) / n
    return sum((-1) ** k * a * np.cos(k * x) for k, a in enumerate(WINDOWS[name]))


def segments(x: np.ndarray, size: int, step: int) -> np.ndarray:
    n = (len(x) - size) // step + 1
    return np.lib.stride_tricks.sliding_window_view(x, size)[::step][:n] if n > 0 else np.zeros((0, size))


def periodograms(x: np.ndarray, fs: float, size: int, overlap: int, name: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided density of each segment), each segment less its mean."""
    size = min(size, len(x))
    if size == 0:
        return np.zeros(0), np.zeros((0, 0))
    w = window(name, size)
    s = segments(x, size, max(1, size - min(overlap, size - 1)))
    p = np.abs(np.fft.rfft((s - s.mean(1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w * w).sum())
    p[:, 1 : (size + 1) // 2 if size % 2 else size // 2] *= 2
    return np.fft.rfftfreq(size, 1 / fs), p


def butter_bandpass(order: int, low: float, high: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth band-pass by the bilinear transform."""
    lo, hi = 4 * np.tan(np.pi * np.array([low, high]) / fs)  # prewarped for a sample rate of 2
    k = np.arange(1, order + 1)
    p = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    band, centre = hi - lo, np.sqrt(lo * hi)
    h = p * band / 2
    p = np.concatenate([h + np.sqrt(h * h - centre**2), h - np.sqrt(h * h - centre**2)])
    gain = band**order * np.real(np.prod(4.0 * np.ones(order)) / np.prod(4.0 - p))
    z = np.concatenate([np.ones(order), -np.ones(order)])
    return np.real(gain * np.poly(z)), np.real(np.poly((4 + p) / (4 - p)))


def settle(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state of a filter that has seen a step for ever."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[np.arange(n - 1), np.arange(1, n)] = 1
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    z, bs, as_ = state.tolist(), b.tolist(), a.tolist()
    n, out = len(z), []
    for v in x.tolist():
        y = bs[0] * v + z[0]
        for k in range(n - 1):
            z[k] = bs[k + 1] * v + z[k + 1] - as_[k + 1] * y
        z[n - 1] = bs[n] * v - as_[n] * y
        out.append(y)
    return np.array(out)


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with odd mirrored ends of three times the filter's length."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        raise ValueError(f"a signal needs more than {pad} samples")
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    z = settle(b, a)
    y = lfilter(b, a, y, z * y[0])[::-1]
    return lfilter(b, a, y, z * y[0])[::-1][pad:-pad]


def find_peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima (the middle of a plateau) of some height; of near ones the taller stays."""
    if len(x) < 3:
        return np.zeros(0, int)
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    stop = np.concatenate([edge[1:], [len(x)]]) - 1
    top = [(s + e) // 2 for s, e in zip(edge, stop) if s > 0 and e < len(x) - 1 and x[s - 1] < x[s] and x[e + 1] < x[e]]
    p = np.array([t for t in top if x[t] >= height], int)
    keep = np.ones(len(p), bool)
    for k in np.argsort(x[p], kind="stable")[::-1]:
        if keep[k]:
            keep &= (np.abs(p - p[k]) >= distance) | (np.arange(len(p)) == k)
    return p[keep]


def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A cubic spline without knots at the second and second last point, carried on beyond the ends."""
    n = len(x)
    if n < 4:
        c = np.polyfit(x, y, n - 1)
        return np.polyval(c, at)
    h = np.diff(x)
    m = np.zeros((n, n)) if n <= 400 else None
    slope = np.diff(y) / h
    rhs = np.zeros(n)
    rhs[1:-1] = 6 * np.diff(slope)
    if m is not None:
        m[0, :3] = h[1], -(h[0] + h[1]), h[0]
        m[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
        for i in range(1, n - 1):
            m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        k = np.linalg.solve(m, rhs)
    else:  # the end conditions eliminated, the rest by one sweep down and one up
        lo, d, up, r = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), rhs[1:-1].copy()
        d[0] += lo[0] * (h[0] + h[1]) / h[1]
        up[0] -= lo[0] * h[0] / h[1]
        d[-1] += up[-1] * (h[-2] + h[-1]) / h[-2]
        lo[-1] -= up[-1] * h[-1] / h[-2]
        for i in range(1, len(d)):
            f = lo[i] / d[i - 1]
            d[i] -= f * up[i - 1]
            r[i] -= f * r[i - 1]
        s = np.zeros(len(d))
        s[-1] = r[-1] / d[-1]
        for i in range(len(d) - 2, -1, -1):
            s[i] = (r[i] - up[i] * s[i + 1]) / d[i]
        k = np.concatenate([[((h[0] + h[1]) * s[0] - h[0] * s[1]) / h[1]], s, [((h[-2] + h[-1]) * s[-1] - h[-1] * s[-2]) / h[-2]]])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = x[i + 1] - at, at - x[i]
    return (k[i] * a**3 + k[i + 1] * b**3) / (6 * h[i]) + (y[i] / h[i] - k[i] * h[i] / 6) * a + (y[i + 1] / h[i] - k[i + 1] * h[i] / 6) * b


def compress_frequencies(x: np.ndarray, fs: float, offset: float, factor: float) -> np.ndarray:
    """Frequencies above ``offset`` drawn towards it by ``factor``, on a linearly interpolated spectrum."""
    spec, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / fs)
    moved = np.where(f > offset, offset + (f - offset) * factor, f)
    new = np.interp(f, moved, spec.real, right=0) + 1j * np.interp(f, moved, spec.imag, right=0)
    return np.fft.irfft(new, len(x))


def spectral_features(x: np.ndarray, fs: float = 100.0) -> dict[str, float]:
    """The spectral part of an event's features; bins are spread evenly over 0 to fs/2."""
    s = np.abs(np.fft.fft(x))[: len(x) // 2] if len(x) else x
    if not len(s):
        return dict.fromkeys(("dom_freq", "dom_mag", "mean_mag", "centroid", "spread", "rolloff", "psd", "entropy", "low", "mid", "high"), 0.0)
    f, total, e = np.linspace(0, fs / 2, len(s)), s.sum() + 1e-10, s * s
    c = (f * s).sum() / total
    over = np.flatnonzero(np.cumsum(e) >= 0.85 * e.sum())
    p = s / total
    bands = np.array([e[f < 3].sum(), e[(f >= 3) & (f < 8)].sum(), e[f >= 8].sum()])
    low, mid, high = bands / (bands.sum() + 1e-10)
    return {"dom_freq": f[s.argmax()], "dom_mag": s.max(), "mean_mag": s.mean(), "centroid": c, "spread": np.sqrt(((f - c) ** 2 * s).sum() / total), "rolloff": f[over[0]] if len(over) else fs / 2, "psd": e.sum(), "entropy": -(p * np.log(p + 1e-10)).sum(), "low": low, "mid": mid, "high": high}
