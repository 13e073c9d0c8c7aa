"""A linear-chain conditional random field in NumPy: training by Adam, decoding by Viterbi.

A place has a few dense features and any number of hashed ones. Places of all sequences lie end to
end; sequences of like lengths are handled together. Only the training sample, whose size is a
parameter of the caller, is ever on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def groups(lengths: np.ndarray, limit: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sequences, places, mask): sequences of like lengths and the flat place of each of their steps."""
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    for low in range(0, len(order), limit):
        some = order[low : low + limit]
        steps = np.arange(int(lengths[some].max()))
        mask = steps[None] < lengths[some][:, None]
        yield some, start[some][:, None] + np.where(mask, steps[None], 0), mask


class LinearChain:
    """Weights of ``labels`` states over dense and hashed features, with start, end and transition scores."""

    def __init__(self, labels: int, dense: int, buckets: int = 1):
        self.emit = np.zeros((labels, dense))
        self.hashed = np.zeros((labels, buckets))
        self.move = np.zeros((labels, labels))
        self.start = np.zeros(labels)
        self.end = np.zeros(labels)

    def parts(self) -> list[np.ndarray]:
        return [self.emit, self.hashed, self.move, self.start, self.end]

    def scores(self, x: np.ndarray, bucket: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Score of each label at each place; ``bucket[i]`` is a hashed feature of place ``place[i]``."""
        out = x @ self.emit.T
        for k, weights in enumerate(self.hashed):
            out[:, k] += np.bincount(place, weights[bucket], minlength=len(x))
        return out

    def forward(self, scores, mask):
        """Log sums over all paths up to each step; steps beyond a sequence keep the last value."""
        alpha = [self.start + scores[:, 0]]
        for t in range(1, scores.shape[1]):
            step = logsum(alpha[-1][:, :, None] + self.move[None], 1) + scores[:, t]
            alpha.append(np.where(mask[:, t, None], step, alpha[-1]))
        return np.stack(alpha, 1)

    def backward(self, scores, mask):
        n, length, labels = scores.shape
        beta = [np.broadcast_to(self.end, (n, labels))]
        for t in range(length - 1, 0, -1):
            step = logsum(self.move[None] + (scores[:, t] + beta[-1])[:, None, :], 2)
            beta.append(np.where(mask[:, t, None], step, np.broadcast_to(self.end, (n, labels))))
        return np.stack(beta[::-1], 1)

    def chain_gradient(self, scores, y, mask):
        """(by score, move, start, end): gradient of the log likelihood of padded sequences."""
        n, length, labels = scores.shape
        alpha, beta = self.forward(scores, mask), self.backward(scores, mask)
        total = logsum(alpha[:, -1] + self.end, 1)
        single = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        truth = np.eye(labels)[y] * mask[:, :, None]
        move = np.zeros_like(self.move)
        for t in range(1, length):
            both = alpha[:, t - 1, :, None] + self.move[None] + (scores[:, t] + beta[:, t])[:, None, :]
            pair = np.exp(both - total[:, None, None]) * mask[:, t, None, None]
            move += truth[:, t - 1].T @ (truth[:, t]) - pair.sum(0)
        last = mask.sum(1).astype(int) - 1
        rows = np.arange(n)
        return truth - single, move, (truth[:, 0] - single[:, 0]).sum(0), (truth[rows, last] - single[rows, last]).sum(0)

    def gradient(self, x, features, y, lengths, batches):
        """Gradient of the log likelihood by all weights."""
        scores = x @ self.emit.T + features.by_place(self.hashed)
        by_score = np.zeros_like(scores)
        sums = [np.zeros_like(p) for p in (self.move, self.start, self.end)]
        for _, at, mask in batches:
            part, *rest = self.chain_gradient(scores[at], y[at], mask)
            by_score[at[mask]] = part[mask]
            for s, r in zip(sums, rest):
                s += r
        return [by_score.T @ x, features.by_bucket(by_score), *sums]

    def fit(self, x, bucket, place, y, lengths, steps=100, rate=0.08, decay=(1e-5, 1e-3, 1e-4), loose=None):
        """Climb the penalized likelihood from the present weights; the same sample gives the same weights.

        ``decay``: of dense weights, of hashed ones, and of those from bucket ``loose`` on.
        """
        used, slot = np.unique(bucket, return_inverse=True)
        whole, self.hashed = self.hashed, self.hashed[:, used]
        features, batches = Sparse(slot, place, len(x), len(used)), list(groups(lengths))
        shrink = [decay[0], np.where(used < (used.max(initial=0) + 1 if loose is None else loose), decay[1], decay[2]), *decay[:1] * 3]
        first = [np.zeros_like(p) for p in self.parts()]
        second = [np.zeros_like(p) for p in self.parts()]
        for step in range(1, steps + 1):
            for p, g, d, m, v in zip(self.parts(), self.gradient(x, features, y, lengths, batches), shrink, first, second):
                g = g / len(lengths) - d * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        whole[:] = 0
        whole[:, used] = self.hashed
        self.hashed = whole
        return self

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label of every place (Viterbi)."""
        labels = len(self.start)
        out = np.zeros(len(scores), np.int8)
        for _, at, mask in groups(lengths):
            padded = scores[at]
            best, back = self.start + padded[:, 0], []
            for t in range(1, padded.shape[1]):
                step = best[:, :, None] + self.move[None]
                arg = step.argmax(1)
                new = np.take_along_axis(step, arg[:, None, :], 1)[:, 0] + padded[:, t]
                keep = mask[:, t, None]
                back.append(np.where(keep, arg, np.arange(labels)[None]))
                best = np.where(keep, new, best)
            state = (best + self.end).argmax(1)
            path = [state]
            for arg in back[::-1]:
                state = arg[np.arange(len(state)), state]
                path.append(state)
            out[at[mask]] = np.stack(path[::-1], 1)[mask]
        return out


class Sparse:
    """Hashed features of places, ordered both ways."""

    def __init__(self, bucket: np.ndarray, place: np.ndarray, places: int, buckets: int):
        self.sides = []
        for key, other, size in ((place, bucket, places), (bucket, place, buckets)):
            order = np.argsort(key, kind="stable")
            held, at = np.unique(key[order], return_index=True)
            self.sides.append((held, at, other[order], size))

    @staticmethod
    def summed(side, values: np.ndarray) -> np.ndarray:
        held, at, other, size = side
        out = np.zeros((size, values.shape[1]))
        if len(other):
            out[held] = np.add.reduceat(values[other], at, axis=0)
        return out

    def by_place(self, weights: np.ndarray) -> np.ndarray:
        return self.summed(self.sides[0], np.ascontiguousarray(weights.T))

    def by_bucket(self, by_score: np.ndarray) -> np.ndarray:
        return self.summed(self.sides[1], by_score).T


def logsum(a, axis):
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)
