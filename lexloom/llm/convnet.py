"""A small convolutional classifier of id sequences, trained in numpy from random weights.

Ids are embedded (the sum of one row of each table), filters of several widths slide over the
embeddings, each filter's greatest response anywhere in the sequence is kept, and a softmax
layer reads those. Training may begin with a soft maximum, which shows every position to the
gradient, and harden it from epoch to epoch; the last epochs, and the net, use the maximum itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ConvNet:
    tables: list[np.ndarray]  # (vocabulary + 1, d); the last row is padding and stays zero
    filters: dict[int, np.ndarray]  # width -> (width, d, filters)
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    @property
    def most(self) -> int:
        return max(self.filters)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def of(self, i: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.state.setdefault(i, (np.zeros_like(value), np.zeros_like(value)))

    def step(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.t += 1
        for i, (value, grad) in enumerate(pairs):
            m, v = self.of(i, value)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def pool(y: np.ndarray, size: np.ndarray, beta: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(pooled responses of consecutive sequences, each response's share in its sequence's).

    Without ``beta`` the maximum; with it log(mean(exp(beta * y))) / beta.
    """
    starts, own = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    top = np.maximum.reduceat(y, starts)
    e = (y == top[own]).astype(np.float32) if beta is None else np.exp(beta * (y - top[own]))
    total = np.add.reduceat(e, starts)
    pooled = top if beta is None else top + np.log(total / size[:, None].astype(np.float32)) / np.float32(beta)
    return pooled, e / total[own]


@dataclass
class Learner:
    """A net while it learns: the steps' averages beside it. Ids that are never seen keep their rows."""

    net: ConvNet
    squares: list[np.ndarray]
    adam: _Adam
    row_rate: float = 0.1

    @staticmethod
    def begin(classes: int, vocabulary: int, n_tables: int, *, dim: int, widths: tuple[int, ...], filters: int, rate: float, row_rate: float, scale: float, rng: np.random.Generator) -> Learner:
        tables = [np.concatenate((rng.normal(0, scale, (vocabulary, dim)), np.zeros((1, dim)))).astype(np.float32) for _ in range(n_tables)]
        weights = {w: rng.normal(0, (w * dim) ** -0.5, (w, dim, filters)).astype(np.float32) for w in widths}
        net = ConvNet(tables, weights, np.zeros(filters * len(widths), np.float32), rng.normal(0, 0.5, (filters * len(widths), classes)).astype(np.float32), np.zeros(classes, np.float32))
        return Learner(net, [np.full(len(t), 1e-12, np.float32) for t in tables], _Adam(rate), row_rate)

    def step(self, sequences: list[np.ndarray | tuple[np.ndarray, np.ndarray]], labels: np.ndarray, beta: float | None, weights: np.ndarray | None = None) -> list[np.ndarray]:
        """One step; returns the ids of each table that it changed. A pair gives ids and the places whose responses count."""
        net, rows = self.net, len(sequences)
        widths, filters, most, dim = list(net.filters), next(iter(net.filters.values())).shape[2], net.most, net.tables[0].shape[1]
        vocabulary, n_tables = len(net.tables[0]) - 1, len(net.tables)
        pad = np.full((most, n_tables), vocabulary, np.int64)
        bodies = [s[0] if isinstance(s, tuple) else s for s in sequences]
        places = [s[1] if isinstance(s, tuple) else np.arange(max(1, len(s))) for s in sequences]
        ids = np.concatenate([x for s in bodies for x in (s, pad)])
        size = np.array([len(p) for p in places])
        begin = np.cumsum([0, *(len(s) + most for s in bodies)])[:-1]
        owner = np.repeat(np.arange(rows), size)
        live = begin[owner] + np.concatenate(places)
        x = sum(t[ids[:, j]] for j, t in enumerate(net.tables))
        parts = [pool(sum(x[live + j] @ net.filters[w][j] for j in range(w)), size, beta) for w in widths]
        features = np.maximum(np.concatenate([p for p, _ in parts], axis=1) + net.bias, 0)
        p = softmax(features @ net.out + net.shift)
        p[np.arange(rows), labels] -= 1
        p /= rows
        if weights is not None:
            p *= weights[:, None].astype(p.dtype)
        d_features = (p @ net.out.T) * (features > 0)
        steps = [(net.out, features.T @ p), (net.shift, p.sum(axis=0)), (net.bias, d_features.sum(axis=0))]
        d_x = np.zeros_like(x)
        for k, w in enumerate(widths):
            g = d_features[owner, k * filters : (k + 1) * filters] * parts[k][1]
            steps.append((net.filters[w], np.stack([x[live + j].T @ g for j in range(w)])))
            for j in range(w):
                d_x[live + j] += g @ net.filters[w][j].T  # places are different ones
        self.adam.step(steps)
        changed = []
        for j, t in enumerate(net.tables):
            own, inverse = np.unique(ids[:, j], return_inverse=True)
            total = np.stack([np.bincount(inverse, d_x[:, c], len(own)) for c in range(dim)], axis=1).astype(np.float32)
            total[own == vocabulary] = 0
            self.squares[j][own] += (total**2).mean(axis=1)
            t[own] -= self.row_rate * total / np.sqrt(self.squares[j][own])[:, None]
            changed.append(own)
        return changed

    def dense(self) -> list[np.ndarray]:
        """All parameters but the tables, and their averages, in the order of the steps."""
        values = [self.net.out, self.net.shift, self.net.bias, *self.net.filters.values()]
        return [*values, *(x for i in range(len(values)) for x in self.adam.of(i, values[i]))]


def train(sequences: list[np.ndarray], labels: np.ndarray, classes: int, vocabulary: int, *, dim: int, widths: tuple[int, ...], filters: int, betas: list[float | None], batch: int = 64, rate: float = 0.01, row_rate: float = 0.1, scale: float = 0.3, seed: int = 7) -> ConvNet:
    """Fit to sequences of ids, (length, tables) each; id ``vocabulary`` is padding. The same input gives the same net.

    ``betas``: the softness of the maximum in each pass over the sequences, None for the maximum
    itself. ``scale``: of the embeddings at the start; ids that are never seen keep theirs.
    """
    rng = np.random.default_rng(seed)
    learner = Learner.begin(classes, vocabulary, sequences[0].shape[1], dim=dim, widths=widths, filters=filters, rate=rate, row_rate=row_rate, scale=scale, rng=rng)
    for beta in betas:
        order = rng.permutation(len(sequences))
        for chosen in np.array_split(order, -(-len(order) // batch)):  # all of them, in steps of like size
            learner.step([sequences[i] for i in chosen], labels[chosen], beta)
    return learner.net
