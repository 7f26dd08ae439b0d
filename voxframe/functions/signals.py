"""Waves: WAV files, pitch, a spectral gate, resampling by a rational ratio, levels and noise. Functions of one wave each."""

from __future__ import annotations

import math
import struct
from fractions import Fraction

import numpy as np

#: Pitches that are looked for, in Hz, and how far from a repetition a frame may be to have one.
LOWEST, HIGHEST, VOICED = 70.0, 1000.0, 0.2
FRAME, HOP = 2048, 512


def write_wav(wave: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """PCM of 16, 24 or 32 bits; columns are channels."""
    x = np.atleast_2d(np.asarray(wave, float).T).T
    whole = np.clip(np.rint(x * 2 ** (bits - 1)), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1).astype("<i4")
    data = whole.astype("<i2").tobytes() if bits == 16 else whole.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    block = x.shape[1] * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, x.shape[1], rate, rate * block, block, bits) + b"data" + struct.pack("<I", len(data)) + data


def read_wav(content: bytes) -> tuple[np.ndarray, int, int]:
    """(samples by channels in -1 to 1, rate, bits) of PCM or float WAV; ValueError tells what is wrong with a file.

    Chunks of other kinds are passed over; data that is cut off is an error.
    """
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    at, form, data = 12, None, None
    while at + 8 <= len(content) and data is None:
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError(f"chunk {name.decode('latin-1')} is cut off")
        if name == b"fmt ":
            if size < 16:
                raise ValueError("short format chunk")
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("no format or no data")
    kind, channels, rate, _, block, bits = form
    if not channels or not rate or block != channels * bits // 8 or len(data) % max(block, 1):
        raise ValueError("format and data don't agree")
    if kind == 3 and bits == 32:
        x = np.frombuffer(data, "<f4").astype(float)
    elif kind in (1, 0xFFFE) and bits in (8, 16, 24, 32):
        if bits == 8:
            x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
        elif bits == 16:
            x = np.frombuffer(data, "<i2") / 2.0**15
        else:
            raw = np.frombuffer(data, np.uint8).reshape(-1, bits // 8)
            wide = np.zeros((len(raw), 4), np.uint8)
            wide[:, 4 - bits // 8 :] = raw
            x = wide.view("<i4")[:, 0] / 2.0**31
    else:
        raise ValueError(f"format {kind} of {bits} bits")
    return x.reshape(-1, channels), rate, bits


def framed(wave: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Frames of a wave, one a row; a shorter wave is one frame ended by zeros."""
    x = np.asarray(wave, float)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def pitches(wave: np.ndarray, rate: int) -> np.ndarray:
    """Pitch by frame; nan where a frame repeats nothing.

    The mean squared difference of a frame and itself so many samples later, over that of all shorter lags, falls near
    nought where the wave repeats; the first deep enough trough is the period, placed by a parabola through its neighbours.
    All lags are found at once by one Fourier transform.
    """
    out = []
    lo, hi = max(2, int(rate / HIGHEST)), min(FRAME // 2, int(rate / LOWEST) + 1)
    for f in framed(wave):
        if not np.any(f):
            out.append(np.nan)
            continue
        w = FRAME - hi
        spectrum = np.fft.rfft(f, 2 * FRAME)
        head = np.fft.rfft(f[:w], 2 * FRAME)
        dot = np.fft.irfft(np.conj(head) * spectrum)[: hi + 1]
        energy = np.concatenate([[0.0], np.cumsum(f**2)])
        apart = energy[w] + (energy[np.arange(hi + 1) + w] - energy[: hi + 1]) - 2 * dot
        apart = np.maximum(apart, 0.0)
        mean = np.cumsum(apart[1:]) / np.arange(1, hi + 1)
        d = np.concatenate([[1.0], apart[1:] / np.maximum(mean, 1e-12)])
        deep = [k for k in range(lo, hi) if d[k] < VOICED and d[k] <= d[k - 1] and d[k] <= d[k + 1]]
        if not deep:
            out.append(np.nan)
            continue
        k = deep[0]
        a, b, c = d[k - 1], d[k], d[k + 1]
        bend = a - 2 * b + c
        out.append(rate / (k + (0.5 * (a - c) / bend if bend > 0 else 0.0)))
    return np.array(out)


def mean_pitch(wave: np.ndarray, rate: int) -> float | None:
    p = pitches(wave, rate)
    return float(np.nanmean(p)) if np.isfinite(p).any() else None


def denoised(wave: np.ndarray, size: int = 512, floor_share: float = 0.2, over: float = 2.0, least: float = 0.05) -> np.ndarray:
    """A spectral gate: each band's noise is a low quantile of its levels over time; what stands no more than ``over`` times
    above it falls to a small share, what stands higher keeps what is above. Half-overlapping frames add up to the wave."""
    x = np.asarray(wave, float)
    if not len(x):
        return x
    hop = size // 2
    window = np.sqrt(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size))
    padded = np.pad(x, (hop, size + hop - len(x) % hop))
    frames = framed(padded, size, hop) * window
    bands = np.fft.rfft(frames, axis=1)
    level = np.abs(bands)
    floor = np.quantile(level, floor_share, axis=0)
    # a quantile of a steady tone is the tone: what stands far above its neighbouring bands is no noise
    around = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(floor, 16, mode="edge"), 33), axis=1)
    floor = np.minimum(floor, 1.5 * around)
    gain = np.clip(1 - over * floor / np.maximum(level, 1e-12), least, 1.0)
    back = np.fft.irfft(bands * gain, size, axis=1) * window
    out = np.zeros(hop * (len(frames) - 1) + size)
    for i, f in enumerate(back):
        out[i * hop : i * hop + size] += f
    return out[hop : hop + len(x)]


def resampled(wave: np.ndarray, up: int, down: int, zeros: int = 16) -> np.ndarray:
    """A wave at up/down times its rate: a windowed sinc below both halves of the rates, only the taps that meet samples.

    Each output sample is a dot product of its neighbours with one of ``up`` phases of the filter.
    """
    x = np.asarray(wave, float)
    f = Fraction(up, down)
    up, down = f.numerator, f.denominator
    n = max(1, -(-len(x) * up // down)) if len(x) else 0
    if not n or up == down:
        return x
    cut = min(1.0, up / down)
    half = int(math.ceil(zeros / cut))
    k = np.arange(n)
    at, phase = (k * down) // up, (k * down) % up
    taps = np.arange(-half + 1, half + 1)
    # distance of each tap from the place of each phase
    far = taps[None, :] - np.arange(up)[:, None] / up
    filters = cut * np.sinc(cut * far) * np.where(np.abs(far) < half, 0.5 + 0.5 * np.cos(np.pi * far / half), 0.0)
    filters /= filters.sum(1, keepdims=True)
    padded = np.pad(x, (half, half + 1))
    return np.einsum("ij,ij->i", padded[at[:, None] + taps[None, :] + half], filters[phase])


def change_speed(wave: np.ndarray, speed: float) -> np.ndarray:
    """A wave that plays so much faster at the same rate."""
    f = Fraction(speed).limit_denominator(100)
    return resampled(wave, f.denominator, f.numerator)


def properties(content: bytes) -> dict:
    """What a WAV file is and how it sounds: rate, bits, channels, clipped samples, crossings, spectrum's centre, pitch."""
    x, rate, bits = read_wav(content)
    mono = x.mean(1)
    if not len(mono):
        raise ValueError("no samples")
    frames = framed(mono)
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1))
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    centre = (power * hz).sum(1) / np.maximum(power.sum(1), 1e-12)
    return {"stereo": x.shape[1] > 1, "rate": rate, "bits": bits, "samples": len(mono), "clipped": int((np.abs(mono) >= 0.999).sum()), "crossings": float((np.diff(np.signbit(mono)) != 0).mean()) if len(mono) > 1 else 0.0, "centroid": float(centre.mean()), "f0": mean_pitch(mono, rate)}
