"""Small linear models on hashed sparse features, in numpy."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np

#: A sparse example: (sorted feature numbers, values).
Sparse = tuple[np.ndarray, np.ndarray]
_MUL = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1 << 16)
def _hash_word(word: str, seed: int) -> int:
    h = 1469598103934665603 ^ seed
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h ^ h >> 29


def hash_words(words: list[str], bits: int, seed: int = 0) -> np.ndarray:
    """A feature number for each string, the same in every process."""
    mask = (1 << bits) - 1
    return np.array([_hash_word(w, seed) & mask for w in words], np.int64)


def hash_ngrams(text: str, sizes: tuple[int, ...], bits: int, seed: int = 0) -> np.ndarray:
    """Feature numbers of all byte n-grams of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    parts, h = [], np.full(len(raw), np.uint64(seed), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(max(sizes), len(raw))):
            h = (h[: len(raw) - k] ^ raw[k:]) * _MUL
            h ^= h >> np.uint64(31)
            if k + 1 in sizes:
                parts.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def block(numbers: np.ndarray, weight: float, sublinear: bool = True) -> Sparse:
    """Counts of feature numbers as a vector of length `weight` (empty where there are none)."""
    if not len(numbers):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    if len(numbers) > 1000:  # counted without sorting
        counts = np.bincount(numbers)
        index = np.flatnonzero(counts != 0)
        counts = counts[index]
    else:
        seen = Counter(numbers.tolist())
        index = np.array(sorted(seen), np.int64)
        counts = np.array([seen[i] for i in index.tolist()])
    v = np.log1p(counts) if sublinear else np.ones(len(index))
    return index, (v * (weight / np.sqrt((v * v).sum()))).astype(np.float32)


def join(parts: list[Sparse]) -> Sparse:
    """The sum of sparse vectors."""
    index = np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)])
    value = np.concatenate([p[1] for p in parts] or [np.empty(0, np.float32)])
    where, inverse = np.unique(index, return_inverse=True)
    return where, np.bincount(inverse, value, minlength=len(where)).astype(np.float32)


def fit_svm(rows: list[Sparse], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12, seed: int = 7, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Linear support-vector classifier (hinge loss), by dual coordinate descent.

    `y` is 1 or -1, `weight` multiplies the cost of each row. With one class only
    the result is a constant decision for it.
    """
    w, b = np.zeros(size, np.float64), 0.0
    if not len(rows) or (y == y[0]).all():
        return w, float(y[0]) if len(rows) else -1.0
    most = cost * (weight if weight is not None else np.ones(len(rows)))
    norm = np.array([float((v * v).sum()) + 1.0 for _, v in rows])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            index, value = rows[i]
            gradient = y[i] * (float(w[index] @ value) + b) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[index] += step * value
                b += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, weight: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """Weights, the bias last, of an L2-penalised logistic regression on dense features (Newton with conjugate gradients)."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x1.shape[1])
    s = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x1.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (s * (p - y)) + ridge * w
        if np.abs(gradient).max() < 1e-3 * max(1, len(x) ** 0.5):
            break
        curve = s * p * (1 - p) + 1e-6
        d, r = np.zeros_like(w), -gradient
        q = r.copy()
        rr = r @ r
        for _ in range(25):
            hq = x1.T @ (curve * (x1 @ q)) + ridge * q
            a = rr / max(q @ hq, 1e-12)
            d += a * q
            r -= a * hq
            new = r @ r
            if new < 1e-6 * rr or new < 1e-10:
                break
            q = r + (new / rr) * q
            rr = new
        w = w + d
    return w


def fit_scale(score: np.ndarray, y: np.ndarray, prior: float = 4.0) -> tuple[float, float]:
    """Slope and offset of a score whose logistic function is the probability of `y` (Platt).

    A quadratic prior of weight `prior` round (1, 0) keeps few rows from bending it far.
    """
    x, w = np.stack([score, np.ones(len(score))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + prior * (w - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior * np.eye(2), gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])
