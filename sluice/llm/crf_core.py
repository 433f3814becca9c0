"""Line features and a two-state linear-chain CRF (no Spark session here)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .words import code_points, power_tables

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _OTHER, _SYMBOL = range(1, 8)
NAMES = ["log_length", "lower", "upper", "digit", "space", "stop", "other", "symbol", "word_length", "ends_sentence", "begins_upper", "repeated", "log_words", "empty", "echo"]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.islower():
            out[c] = _LOWER
        elif x.isupper():
            out[c] = _UPPER
        elif x.isalpha():
            out[c] = _LOWER  # letters without case read as running text
        elif x.isdigit():
            out[c] = _DIGIT
        elif x.isspace():
            out[c] = _SPACE
    for x in ".,;:?'\"()-":
        out[ord(x)] = _STOP
    for x in "!#$%&*+/<=>@[\\]^_`{|}~":
        out[ord(x)] = _SYMBOL
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of the texts: own features (len(NAMES) columns), length in characters, and lines of each text.

    A text has one line more than it has line feeds; so an empty text has one empty line.
    """
    codes = code_points("\n".join(texts))
    feed = codes == 10
    n_lines = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    ends = np.r_[np.flatnonzero(feed), len(codes)]
    begins = np.r_[0, ends[:-1] + 1]
    length = ends - begins
    n = len(length)
    classes = _classes()[codes]
    line = np.repeat(np.arange(n), np.r_[length[:-1] + 1, length[-1:]])
    counts = np.bincount(line * 8 + np.where(feed, 0, classes), minlength=8 * n).reshape(n, 8).astype(np.float64)
    space = classes == _SPACE
    starts = ~space & np.r_[True, space[:-1]]
    words = np.bincount(line[starts], minlength=n)
    some = np.maximum(length, 1)
    has = length > 0
    last = np.where(has, classes[np.maximum(ends - 1, 0)] if len(codes) else 0, 0)
    first = np.where(has, classes[np.minimum(begins, max(0, len(codes) - 1))] if len(codes) else 0, 0)
    # hashes of words and lines from running sums of a polynomial
    up, down = power_tables(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    w_begin = np.flatnonzero(starts)
    w_end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1 if len(codes) else w_begin
    w_hash, w_line = (total[w_end] - total[w_begin]) * down[w_begin], line[w_begin]
    echo = np.bincount(w_line[1:][(w_hash[1:] == w_hash[:-1]) & (w_line[1:] == w_line[:-1])], minlength=n) / np.maximum(words, 1)
    # a line that stands elsewhere in its text as well
    hashes = (total[ends] - total[begins]) * down[begins]
    text = np.repeat(np.arange(len(texts)), n_lines)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    twin = np.zeros(n, np.bool_)
    same = (h[1:] == h[:-1]) & (t[1:] == t[:-1]) & has[order][1:]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    share = counts[:, 1:] / some[:, None]
    own = np.column_stack([np.log1p(length), share, np.log1p(length / np.maximum(words, 1)), (last == _STOP), (first == _UPPER), twin, np.log1p(words), ~has, echo])
    return own, length, n_lines


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after; zeros and a mark where there is none."""
    n = len(own)
    ends = np.cumsum(n_lines)
    head, tail = np.zeros(n, np.bool_), np.zeros(n, np.bool_)
    head[ends - n_lines] = True
    tail[ends - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[head] = 0
    after[tail] = 0
    return np.column_stack([own, before, after, head, tail, np.ones(n)])


def _scan(emit: np.ndarray, step: np.ndarray, begin: np.ndarray, head: np.ndarray, longest: int) -> np.ndarray:
    """Normalised forward messages of all chains at once: products of 2x2 matrices by doubling.

    A chain's first matrix has equal rows and so forgets what stood before it.
    """
    m = step[None, :, :] * emit[:, None, :]
    m[head] = (begin * emit[head])[:, None, :]
    m /= m.max(axis=(1, 2), keepdims=True)
    d = 1
    while d < longest:
        m[d:] = m[:-d] @ m[d:]
        m /= np.maximum(m.max(axis=(1, 2), keepdims=True), 1e-300)
        d *= 2
    out = m[:, 0, :]
    return out / out.sum(axis=1, keepdims=True)


@dataclass
class Crf:
    """State scores are linear in the features; two states, bad (0) and good (1)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the state good, against bad
    trans: np.ndarray  # 2x2 scores of neighbouring states
    begin: np.ndarray
    shift: float = 0.0
    slope: float = 1.0

    def pack(self) -> np.ndarray:
        """All numbers in one array."""
        return np.concatenate([self.mean, self.scale, self.weights, self.trans.ravel(), self.begin, [self.shift, self.slope]])

    @staticmethod
    def unpack(numbers: np.ndarray) -> Crf:
        n = len(NAMES)
        mean, scale, weights, trans, begin, rest = np.split(np.asarray(numbers, np.float64), np.cumsum([n, n, 3 * n + 3, 4, 2]))
        return Crf(mean, scale, weights, trans.reshape(2, 2), begin, float(rest[0]), float(rest[1]))

    def messages(self, x: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip(x @ self.weights, -30, 30)
        good = 1 / (1 + np.exp(-z))
        emit = np.column_stack([1 - good, good]) + 1e-12
        ends = np.cumsum(n_lines)
        head, tail = np.zeros(len(x), np.bool_), np.zeros(len(x), np.bool_)
        head[ends - n_lines] = True
        tail[ends - 1] = True
        step, longest = np.exp(self.trans), int(n_lines.max(initial=1))
        forward = _scan(emit, step, np.exp(self.begin), head, longest)
        backward = _scan(emit[::-1].copy(), step.T, np.ones(2), tail[::-1], longest)[::-1]
        marginal = forward * backward / emit
        return emit, head, marginal / marginal.sum(axis=1, keepdims=True), np.stack([forward, backward])

    def lines(self, own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Marginal probability of good for each line."""
        return self.messages(with_neighbours((own - self.mean) / self.scale, n_lines), n_lines)[2][:, 1]

    def raw(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of each text's line marginals; all lines count alike where all are empty."""
        return self.pooled(*line_features(texts))

    def pooled(self, own: np.ndarray, length: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        good = self.lines(own, n_lines)
        begins = np.cumsum(n_lines) - n_lines
        weight = np.add.reduceat(length, begins)
        even = np.repeat(weight == 0, n_lines)
        w = np.where(even, 1, length)
        return np.add.reduceat(good * w, begins) / np.add.reduceat(w, begins)

    def score(self, texts: list[str]) -> np.ndarray:
        """raw(), calibrated on the training documents."""
        q = np.clip(self.raw(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.shift + self.slope * np.log(q / (1 - q)), -30, 30)))


def fit(own: np.ndarray, length: np.ndarray, n_lines: np.ndarray, good: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood with a ridge, from line_features() and the documents' labels; every line has its document's label. Classes weigh alike."""
    mean, scale = own.mean(axis=0), own.std(axis=0)
    scale[scale < 1e-9] = 1
    x = with_neighbours((own - mean) / scale, n_lines)
    y = np.repeat(good.astype(np.int64), n_lines)
    size = np.repeat(1 / n_lines, n_lines)  # a document counts once, however many lines it has
    share = np.array([max(1, (good == k).sum()) for k in (0, 1)])
    size = size / share[y] / 2
    crf = Crf(mean, scale, np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(2))
    params = [crf.weights, crf.trans, crf.begin]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for k in range(1, rounds + 1):
        emit, head, marginal, (forward, backward) = crf.messages(x, n_lines)
        pair = forward[:-1, :, None] * np.exp(crf.trans)[None] * backward[1:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        inner = (size[1:] * ~head[1:])[:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1], y[1:]), inner[:, 0, 0])
        start = np.zeros(2)
        np.add.at(start, y[head], size[head])
        grads = [x.T @ (size * (y - marginal[:, 1])), seen - (pair * inner).sum(axis=0), start - (marginal[head] * size[head][:, None]).sum(axis=0)]
        for p, g, (a, b) in zip(params, grads, moments, strict=True):
            g = g - ridge * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += 0.1 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    _calibrate(crf, crf.pooled(own, length, n_lines), good)
    return crf


def _calibrate(crf: Crf, raw: np.ndarray, good: np.ndarray) -> None:
    """Platt's two numbers, by Newton steps with smoothed targets."""
    q = np.clip(raw, 1e-6, 1 - 1e-6)
    z = np.log(q / (1 - q))
    n1, n0 = good.sum(), (1 - good).sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(target - p).sum(), ((target - p) * z).sum()])
        h = np.array([[w.sum(), (w * z).sum()], [(w * z).sum(), (w * z * z).sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a + size * step[0], b + size * step[1]
        if np.abs(step).max() < 1e-7:
            break
    crf.shift, crf.slope = float(a), float(max(b, 1e-3))
