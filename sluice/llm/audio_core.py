"""Audio: WAV bytes, polyphase resampling, log-mel filterbanks, energy segments (no Spark here)."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: The stored sample rate, and the rate that features are computed at.
STORED_RATE, RATE = 12_000, 8_000
FRAME, HOP, FFT, MELS, PATCH = 200, 80, 256, 32, 64
#: Energy (dB of full scale, per frame) that opens a segment, and that ends it.
OPEN_DB, CLOSE_DB = -11.0, -13.0
_TAPS = 16  # of each phase
_BLOCK = 4096  # frames handled at once


def wav(samples: bytes, rate: int = STORED_RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples, without loss."""
    pad = len(samples) % 2
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def read_wav(data: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of a mono 8-bit PCM WAV file; chunks may come in any order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, samples = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            samples = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if rate is None or samples is None:
        raise ValueError("the WAV file lacks a chunk")
    return rate, samples


@lru_cache(maxsize=4)
def _phases(up: int, down: int) -> np.ndarray:
    """A windowed-sinc low-pass filter, cut into up phases of _TAPS taps."""
    n = up * _TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    taps = up * cut * np.sinc(cut * t) * np.hamming(n)
    return np.ascontiguousarray(taps.reshape(_TAPS, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up / down times its rate; each output sample takes the taps of one phase only."""
    if up == down:
        return x.astype(np.float32)
    phases = _phases(up, down)
    n = -(-len(x) * up // down)
    before = _TAPS // 2
    padded = np.zeros(len(x) + 2 * _TAPS, np.float32)
    padded[before : before + len(x)] = x
    windows = np.lib.stride_tricks.sliding_window_view(padded, _TAPS)
    out = np.empty(n, np.float32)
    for r in range(up):  # outputs r, r + up, ... have one phase, and inputs a whole number of samples apart
        if r < n:
            k = len(range(r, n, up))
            first, phase = divmod(r * down, up)
            out[r::up] = windows[first :: down][:k] @ phases[phase]
    return out


@lru_cache(maxsize=1)
def mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of an FFT frame."""
    top = 2595 * np.log10(1 + RATE / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * RATE / FFT
    rise = (bins - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    fall = (hz[2:, None] - bins) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log filterbank energies of overlapping frames, and each frame's energy in dB."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, _BLOCK):  # blocks depend on the text alone, so equal texts give equal bits
        part = frames[a : a + _BLOCK]
        power = np.abs(np.fft.rfft(part * _WINDOW, FFT, axis=1)).astype(np.float32) ** 2
        mel[a : a + _BLOCK] = np.log(power @ mel_bank() + 1e-6)
        energy[a : a + _BLOCK] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-10)
    return mel, energy


def segments(energy: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """Frame spans that begin where the energy reaches open_db and end where it falls below close_db."""
    state = np.where(energy >= open_db, 1, np.where(energy < close_db, 0, -1))  # -1: as before
    known = np.flatnonzero(state >= 0)
    if not len(known):
        return []
    before = np.searchsorted(known, np.arange(len(state)), "right") - 1
    on = np.where(before >= 0, state[known[np.maximum(before, 0)]], 0) == 1
    edges = np.flatnonzero(np.diff(on, prepend=False, append=False))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


@dataclass
class Features:
    """What one audio gives: its filterbanks as patches of PATCH frames, their spans and the speech segments, in seconds."""

    mel: np.ndarray
    energy: np.ndarray
    spans: list[tuple[float, float]]

    def patches(self, dtype: type = np.float32) -> np.ndarray:
        """(n, PATCH, MELS), the last one filled up with the filterbank's floor."""
        n = -(-len(self.mel) // PATCH)
        out = np.full((n * PATCH, MELS), np.log(np.float32(1e-6)), dtype)
        out[: len(self.mel)] = self.mel
        return out.reshape(n, PATCH, MELS)

    def patch_spans(self) -> list[tuple[float, float]]:
        return [(k * HOP / RATE, (min(k + PATCH, len(self.mel)) - 1) * HOP / RATE + FRAME / RATE) for k in range(0, len(self.mel), PATCH)]


def digest(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """Frames, segments and their seconds, and mean and spread of eight bands."""
    bands = mel.reshape(len(mel), 8, -1).mean(axis=2, dtype=np.float64)
    total = sum(b - a for a, b in spans)
    part = lambda v: ",".join(f"{y:.3f}" for y in v.tolist())
    return f"frames={len(mel)};segments={len(spans)};seconds={total:.3f};mean={part(bands.mean(axis=0))};spread={part(bands.std(axis=0))}"


def analyse(data: bytes) -> Features:
    """Features of a WAV file."""
    rate, samples = read_wav(data)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    common = int(np.gcd(rate, RATE))
    mel, energy = log_mel(resample(x, RATE // common, rate // common))
    spans = [(a * HOP / RATE, ((b - 1) * HOP + FRAME) / RATE) for a, b in segments(energy)]
    return Features(mel, energy, spans)


def payload(text: bytes | None) -> bytes:
    """The UTF-8 bytes, filled up with zeros to a positive multiple of 64."""
    text = text or b""
    return text + b"\0" * (64 * max(1, -(-len(text) // 64)) - len(text))
