"""Hashed character n-grams of whole batches, and linear support-vector machines on them."""

from __future__ import annotations

import numpy as np

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def hashed(values: np.ndarray, bits: int) -> np.ndarray:
    """The upper ``bits`` bits of a multiplicative hash."""
    x = (values ^ (values >> np.uint64(31))) * _A
    return (((x ^ (x >> np.uint64(29))) * _B) >> np.uint64(64 - bits)).astype(np.int64)


def ngrams(codes: np.ndarray, starts: np.ndarray, orders: tuple[int, ...], bits: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of every n-gram of the given orders that lies in one row.

    ``codes`` holds the symbols of all rows one after another, ``starts`` where each row begins (and,
    last, the total). Rows may be empty.
    """
    lengths = np.diff(starts)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    features, owners = [], []
    wide = codes.astype(np.uint64) + np.uint64(1)
    for n in orders:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        value = np.full(count, np.uint64(salt * 64 + n))
        for k in range(n):
            value = value * np.uint64(1_000_003) + wide[k : k + count]
        inside = rows[:count] == rows[n - 1 :]
        features.append(hashed(value[inside], bits))
        owners.append(rows[:count][inside])
    if not features:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(features), np.concatenate(owners)


def row_scores(features: np.ndarray, rows: np.ndarray, n_rows: int, weights: np.ndarray) -> np.ndarray:
    """Sum of weights over each row's features divided by the root of their number; one column per machine.

    ``weights`` is (machines, 2**bits). Rows without features score 0.
    """
    counts = np.bincount(rows, minlength=n_rows)
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    return np.stack([np.bincount(rows, weights=w[features], minlength=n_rows) * scale for w in weights], axis=1)


def sparse_rows(features: np.ndarray, rows: np.ndarray, n_rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, values) of each row, scaled as in ``row_scores``."""
    counts = np.bincount(rows, minlength=n_rows)
    order = np.argsort(rows, kind="stable")
    parts = np.split(features[order], np.cumsum(counts)[:-1])
    out = []
    for part in parts:
        index, times = np.unique(part, return_counts=True)
        out.append((index.astype(np.int32), (times / np.sqrt(max(len(part), 1))).astype(np.float32)))
    return out


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, epochs: int = 12, penalty: float = 1e-4, seed: int = 1, most: float = 5.0, importance: np.ndarray | None = None
) -> np.ndarray:
    """A linear support-vector machine (hinge loss, L2 penalty) by averaged stochastic subgradient steps.

    ``labels`` are +1 and -1. Steps of the rarer class are larger, up to ``most`` times; a row's step is
    also multiplied by its ``importance``. The last place of the result is the bias, which is not penalised.
    """
    rng = np.random.default_rng(seed)
    positive = max((labels > 0).mean(), 1e-9) if len(labels) else 0.5
    factor = {1: min(most, max(1.0, (1 - positive) / positive)), -1: min(most, max(1.0, positive / max(1 - positive, 1e-9)))}
    importance = np.ones(len(rows)) if importance is None else importance
    v, scale, bias = np.zeros(size), 1.0, 0.0
    mean, mean_bias, taken = np.zeros(size), 0.0, 0
    step = 0
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            step += 1
            rate = 1.0 / (1 + penalty * 40 * step) * 0.5
            index, value = rows[i]
            y = int(labels[i])
            margin = y * (scale * (v[index] @ value) + bias)
            scale *= 1 - rate * penalty
            if margin < 1:
                pull = rate * y * factor[y] * importance[i]
                v[index] += (pull / scale) * value
                bias += 0.05 * pull
        if epoch >= epochs // 2:
            mean += v * scale
            mean_bias += bias
            taken += 1
    return np.append(mean / max(taken, 1), mean_bias / max(taken, 1))
