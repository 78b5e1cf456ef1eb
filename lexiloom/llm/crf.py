"""A linear-chain conditional random field over sparse binary features, fitted in numpy and read in plain Python."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class CRF:
    """Tags of a sequence from the features of its positions and from neighbouring tags. ``weights`` has a list of one number for each tag."""

    def __init__(self, tags: list[str]):
        self.tags = tags
        self.weights: dict[str, list[float]] = {}
        self.step = [[0.0] * len(tags) for _ in tags]

    def emission(self, features: list[str], out: list[float] | None = None) -> list[float]:
        """The weights of the features, added to ``out``."""
        out = out or [0.0] * len(self.tags)
        get = self.weights.get
        for f in features:
            w = get(f)
            if w is not None:
                out = [a + b for a, b in zip(out, w)]
        return out

    def fit(self, sequences: list[list[list[str]]], tags: list[list[str]], free: Callable[[str, str], bool] = lambda f, t: True, rounds: int = 20, rate: float = 0.3, keep: float = 1e-3, at_once: int = 128) -> CRF:
        """Log-likelihood ascent by AdaGrad, ``at_once`` sequences at a time in a fixed order; ``keep`` is the pull towards 0. What isn't ``free`` stays 0."""
        number = {t: i for i, t in enumerate(self.tags)}
        k, names = len(self.tags), {}
        data = []
        for x, y in zip(sequences, tags):
            if x:
                lists = [[names.setdefault(f, len(names)) for f in fs] for fs in x]
                data.append((np.array([f for fs in lists for f in fs]), np.array([len(fs) for fs in lists]), np.array([number[t] for t in y])))
        w, step = np.zeros((len(names), k)), np.zeros((k, k))
        square, step_square = np.full_like(w, 1e-6), np.full_like(step, 1e-6)
        loose = np.array([[free(f, t) for t in self.tags] for f in names], float)
        order = np.random.default_rng(0)
        for _ in range(rounds):
            turn = order.permutation(len(data))
            for at in range(0, len(turn), at_once):
                group = [data[i] for i in turn[at : at + at_once]]
                sizes = np.array([len(y) for _, _, y in group])
                b, t = len(group), int(sizes.max())
                of, pos = np.nonzero(np.arange(t) < sizes[:, None])  # the places that are filled, sequence by sequence
                flat, counts, truth = (np.concatenate(c) for c in zip(*group))
                e = np.zeros((b, t, k))
                e[of, pos] = np.add.reduceat(w[flat], np.cumsum(counts) - counts)
                node, edge = _marginals(e, step, sizes)
                slope = -node[of, pos]
                slope[np.arange(len(truth)), truth] += 1
                places = (flat[:, None] * k + np.arange(k)).ravel()
                g = np.bincount(places, np.repeat(slope, counts, axis=0).ravel(), w.size).reshape(w.shape) * loose
                seen = np.unique(flat)
                gs = g[seen] - keep * w[seen]
                square[seen] += gs * gs
                w[seen] += rate * gs / np.sqrt(square[seen])
                pairs = np.flatnonzero(of[1:] == of[:-1])
                if len(pairs):
                    g = -edge - keep * step
                    np.add.at(g, (truth[pairs], truth[pairs + 1]), 1)
                    step_square += g * g
                    step += rate * g / np.sqrt(step_square)
        self.weights = {f: w[i].tolist() for f, i in names.items()}
        self.step = step.tolist()
        return self

    def tag(self, emissions: list[list[float]]) -> list[str]:
        """The likeliest tags."""
        if not emissions:
            return []
        into = list(zip(*self.step))  # the weights of the steps into each tag
        best, came = emissions[0], []
        for e in emissions[1:]:
            now, back = [], []
            for steps, own in zip(into, e):
                ways = [x + y for x, y in zip(best, steps)]
                most = max(ways)
                back.append(ways.index(most))
                now.append(most + own)
            best = now
            came.append(back)
        path = [best.index(max(best))]
        for back in reversed(came):
            path.append(back[path[-1]])
        return [self.tags[i] for i in reversed(path)]


def _marginals(e: np.ndarray, step: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each tag at each place, and the expected number of each step from tag to tag."""
    b, t, k = e.shape
    # sums of products, with every place scaled by its largest weight and its sum
    p, a = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(step)
    forward, back = np.zeros((b, t, k)), np.ones((b, t, k))
    forward[:, 0] = p[:, 0] / p[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        f = forward[:, i - 1] @ a * p[:, i]
        forward[:, i] = f / f.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        f = (p[:, i + 1] * back[:, i + 1]) @ a.T
        back[:, i] = np.where((i + 1 < sizes)[:, None], f / f.sum(axis=1, keepdims=True), 1.0)
    node = forward * back
    node /= node.sum(axis=2, keepdims=True)
    edge = np.zeros((k, k))
    for i in range(1, t):
        has = i < sizes
        both = forward[has, i - 1, :, None] * a * (p[has, i] * back[has, i])[:, None, :]
        edge += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return node, edge
