"""Low-rank factors of kernel matrices, by pivots that all tasks choose together.

A kernel matrix of N subjects is L L' up to a stated error, L with one row for each subject and one column for each pivot: the pivoted
incomplete Cholesky factorisation.  A pivot is a subject whose features the others are compared with, and a row of L follows from its subject's features and the
pivots alone.  So the subjects stay where they are: each round every task reports what the pivots leave of its subjects' diagonal, and the pivots that it would add for
its own subjects; the driver takes those of them that the others leave something of.  What is sent to tasks is the pivots, MOST_RANK at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.runtime import cut

#: A factor has so many columns at most; a kernel that needs more is refused.
MOST_RANK = 1500
#: Each task names so many pivots in a round at most; it compares so many rows at a time.
BLOCK, ROWS = 256, 8192
#: Candidates for pivots in each round, where the mean error is asked for.
CANDIDATES = 128


def gaussian(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * ((x**2).sum(1)[:, None] + (z**2).sum(1)[None, :] - 2 * x @ z.T).clip(0))


@dataclass(frozen=True)
class Factor:
    """L as a function of features: themselves for the linear kernel (gamma None), else the kernel with the pivots times ``weights``.
    error: the mean of what is left of the diagonal."""

    gamma: float | None
    pivots: np.ndarray
    weights: np.ndarray
    error: float = 0.0

    @property
    def rank(self) -> int:
        return self.pivots.shape[1] if self.gamma is None else len(self.pivots)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return x if self.gamma is None else gaussian(x, self.pivots, self.gamma) @ self.weights


def linear(features: int) -> Factor:
    return Factor(None, np.zeros((0, features)), np.zeros((0, 0)))


def with_pivots(pivots: np.ndarray, gamma: float, ridge: float = 1e-12) -> Factor:
    k = gaussian(pivots, pivots, gamma)
    lower = np.linalg.cholesky(k + ridge * np.eye(len(k))) if len(k) else np.zeros((0, 0))
    return Factor(gamma, pivots, np.linalg.inv(lower).T if len(k) else lower)


def _chosen(factor: Factor, x: np.ndarray, error: float, worst: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``x`` that become pivots after those of ``factor``, greatest remainder first, until what is left of the diagonal of ``x`` is ``error``
    in the mean, or at the most (``worst``), or there are ``most``; and what is then left."""
    found = factor.rows(x) if factor.rank else np.zeros((len(x), 0))
    left, own = np.maximum(0.0, 1 - (found**2).sum(1)), np.zeros((len(x), min(most, len(x))))
    chosen: list[int] = []
    while len(chosen) < own.shape[1] and (left.max() if worst else left.mean()) > error:
        p, n = int(left.argmax()), len(chosen)
        column = gaussian(x, x[p : p + 1], factor.gamma)[:, 0] - found @ found[p] - own[:, :n] @ own[p, :n]
        if column[p] <= 0:
            break
        own[:, n] = column / np.sqrt(column[p])
        left = np.maximum(0.0, left - own[:, n] ** 2)
        left[p] = 0.0
        chosen.append(p)
    return x[chosen], left


def _more(factor: Factor, candidates: np.ndarray, floor: float, every: bool) -> np.ndarray:
    """The candidates that become pivots, by what those before them leave of each; ``every``: there are no other rows."""
    own = factor.rows(candidates) if factor.rank else np.zeros((len(candidates), 0))
    rest = gaussian(candidates, candidates, factor.gamma) - own @ own.T
    left, chosen = rest.diagonal().copy(), []
    least = floor if every else max(floor, 0.1 * float(left.max(initial=0.0)))  # later rounds know better about the rest
    while len(left) and left.max() > least:
        p = int(left.argmax())
        column = rest[:, p] / np.sqrt(rest[p, p])
        rest -= np.outer(column, column)
        left = np.minimum(left, rest.diagonal())
        left[p] = -1.0
        chosen.append(p)
    return candidates[chosen]


class TooManyPivots(ArithmeticError):
    """The kernel has no factor of the columns allowed."""


def _by_mean(table: DataFrame, features: Sequence[str], gamma: float, error: float = 1e-8, most: int = MOST_RANK) -> Factor:
    """The factor of the Gaussian kernel of the rows of ``table``, whose mean error on the diagonal is ``error`` at most; the driver chooses some pivots in each round.

    Rows of equal features are one row with a number, else copies of a few rows would be all that tasks report.
    """
    x = cut(table.groupBy(*features).agg(F.count(F.lit(1)).alias("times")))
    factor = Factor(gamma, np.zeros((0, len(features))), np.zeros((0, 0)))
    while True:
        now = factor

        def left(it, now=now):
            total, n, distinct = 0.0, 0.0, 0
            kept, size = np.zeros((0, len(features))), np.zeros(0)
            for batch in it:
                *columns, times = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
                own = np.column_stack(columns)
                d = np.maximum(0.0, 1 - (now.rows(own) ** 2).sum(1)) if now.rank else np.ones(len(own))
                total, n, distinct = total + times @ d, n + times.sum(), distinct + len(own)
                kept, size = np.vstack([kept, own]), np.concatenate([size, d])
                top = np.argsort(-size, kind="stable")[:CANDIDATES]
                kept, size = kept[top], size[top]
            yield pa.record_batch([pa.array([n]), pa.array([total]), pa.array([distinct]), pa.array([size.tolist()], pa.list_(pa.float64())), pa.array([kept.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "total", "distinct", "size", "x"])

        got = x.mapInArrow(left, "n double, total double, distinct long, size array<double>, x array<double>").collect()  # CANDIDATES subjects of each task at most
        n = sum(r.n for r in got)
        if not n:
            return factor
        mean = sum(r.total for r in got) / n
        size = np.concatenate([r.size for r in got])
        if mean <= error:
            return Factor(gamma, factor.pivots, factor.weights, mean)
        every = np.vstack([np.array(r.x).reshape(-1, len(features)) for r in got])
        order = np.lexsort((*every.T, -size))[: 2 * CANDIDATES]
        pivots = np.vstack([factor.pivots, _more(factor, every[order], error / 10, len(order) == sum(r.distinct for r in got))])
        if len(pivots) > most:
            raise TooManyPivots(f"the kernel needs more than {most} pivots for a mean error of {error}; {mean} is left")
        if len(pivots) == len(factor.pivots):
            return Factor(gamma, factor.pivots, factor.weights, mean)
        factor = with_pivots(pivots, gamma, min(1e-12, error / 100))


def pivoted(table: DataFrame, features: Sequence[str], gamma: float, error: float = 1e-8, most: int = MOST_RANK, worst: bool = False) -> Factor:
    """The factor of the Gaussian kernel of the rows of ``table``, whose mean error on the diagonal is ``error`` at most, or the greatest (``worst``)."""
    if not worst:
        return _by_mean(table, features, gamma, error, most)
    x = table.select(*features)
    factor = Factor(gamma, np.zeros((0, len(features))), np.zeros((0, 0)))
    # Pivots are chosen to leave less than is asked for, as the rows that are compared with them are others.
    goal = error / 10 if worst else error / 2
    while True:
        now = factor

        def left(it, now=now):
            total, n, greatest = 0.0, 0, 0.0
            kept, level = np.zeros((0, len(features))), 0.0
            for batch in it:
                every = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                for first in range(0, len(every), ROWS):
                    own = every[first : first + ROWS]
                    d = np.maximum(0.0, 1 - (now.rows(own) ** 2).sum(1)) if now.rank else np.ones(len(own))
                    total, n, greatest = total + d.sum(), n + len(own), max(greatest, d.max())
                    if len(kept) < BLOCK and (d.max() if worst else d.mean()) > goal:
                        more, rest = _chosen(with_pivots(np.vstack([now.pivots, kept]), gamma, ridge), own, goal, worst, BLOCK - len(kept))
                        kept, level = np.vstack([kept, more]), max(level, rest.max())
            yield pa.record_batch([pa.array([n]), pa.array([total]), pa.array([greatest]), pa.array([level]), pa.array([kept.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "total", "greatest", "level", "x"])

        ridge = min(1e-12, error / 100)
        got = x.mapInArrow(left, "n long, total double, greatest double, level double, x array<double>").collect()  # BLOCK subjects of each task at most
        n = sum(r.n for r in got)
        if not n:
            return factor
        mean = sum(r.total for r in got) / n
        if (max(r.greatest for r in got) if worst else mean) <= error:
            return Factor(gamma, factor.pivots, factor.weights, mean)
        # The tasks' choices are held against each other, some at a time; what all tasks leave is left of them, too.
        level = max(goal, min((r.level for r in got if len(r.x)), default=goal) / 2)
        candidates = np.unique(np.array([v for r in got for v in r.x]).reshape(-1, len(features)), axis=0)
        for first in range(0, len(candidates), ROWS):
            more, _ = _chosen(factor, candidates[first : first + ROWS], level, True, most + 1 - factor.rank)
            if factor.rank + len(more) > most:
                raise TooManyPivots(f"the kernel needs more than {most} pivots for a mean error of {error}; {mean} was left by those before")
            factor = with_pivots(np.vstack([factor.pivots, more]), gamma, ridge)
        if factor.rank == now.rank:
            return Factor(gamma, factor.pivots, factor.weights, mean)
