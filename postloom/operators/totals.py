"""Lower bounds on the summed distance to a group, from moments of the group.

With s = |x - y|² for a member y of a group drawn at random, the mean and the mean square of s follow for
any x from the group's moments up to the fourth: no pair is measured.  Hölder's inequality then bounds the
mean distance from below, E √s >= (E s)^(3/2) / (E s²)^(1/2), and it is close where distances differ little
from each other, as they do in many dimensions.  Several parts of a group are bounded one by one, and
their bounds add up.
"""

from dataclasses import dataclass

import numpy as np

MARGIN = 1e-7  # relative allowance for rounding in a bound


@dataclass
class Moments:
    """Weighted moments of vectors about a centre: count, centre, mean of u, u uᵀ, u |u|², |u|² and |u|⁴."""

    n: float
    centre: np.ndarray
    first: np.ndarray
    second: np.ndarray
    third: np.ndarray
    square: float
    fourth: float

    @staticmethod
    def of(matrix: np.ndarray, weight: np.ndarray, centre: np.ndarray) -> "Moments":
        return Moments.unpack(pack(matrix, weight, centre), centre)

    @staticmethod
    def unpack(sums: np.ndarray, centre: np.ndarray) -> "Moments":
        """From the sums that ``pack`` gives, which may be added up over parts of the rows."""
        d, n = len(centre), sums[0]
        mean = sums / n if n else sums
        return Moments(n, centre, mean[3:3 + d], mean[3 + 2 * d:].reshape(d, d), mean[3 + d:3 + 2 * d], mean[1], mean[2])


def pack(matrix: np.ndarray, weight: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Sums over rows: count, |u|², |u|⁴, u, u |u|², u uᵀ, in one array."""
    u = matrix - centre
    square = np.einsum("ij,ij->i", u, u)
    weighted = u * weight[:, None]
    return np.concatenate([
        [weight.sum(), weight @ square, weight @ square**2], weighted.sum(axis=0), weighted.T @ square, (weighted.T @ u).ravel()])


def lower_totals(x: np.ndarray, parts: list[Moments]) -> np.ndarray:
    """For every row of ``x`` no more than its summed distance to all members of all parts."""
    total = np.zeros(len(x))
    for p in parts:
        if not p.n:
            continue
        z = x - p.centre
        q, zu = np.einsum("ij,ij->i", z, z), z @ p.first
        mean = np.maximum(q - 2.0 * zu + p.square, 0.0)
        square = q**2 + 4.0 * np.einsum("ij,ij->i", z @ p.second, z) + p.fourth - 4.0 * q * zu + 2.0 * q * p.square - 4.0 * (z @ p.third)
        # Rounding: terms of this size may have cancelled.
        size = (q + p.square) ** 2 + p.fourth
        bound = np.maximum(mean - MARGIN * (q + p.square), 0.0) ** 1.5 / np.sqrt(np.maximum(square, 0.0) + MARGIN * size + 1e-300)
        total += p.n * bound
    return total


def parted(matrix: np.ndarray, weight: np.ndarray, parts: int) -> list[Moments]:
    """Moments of up to ``parts`` parts of the rows: each is cut where its longest axis has its mean."""
    labels = np.zeros(len(matrix), np.int64)
    made = 1
    while made < parts:
        spread = []
        for p in range(made):
            rows = matrix[labels == p]
            spread.append(rows.var(axis=0).max() * len(rows) if len(rows) > 2 * matrix.shape[1] else 0.0)
        widest = int(np.argmax(spread))
        if not spread[widest]:
            break
        inside = np.flatnonzero(labels == widest)
        axis = int(matrix[inside].var(axis=0).argmax())
        labels[inside[matrix[inside, axis] > matrix[inside, axis].mean()]] = made
        made += 1
    out = []
    for p in range(made):
        rows, w = matrix[labels == p], weight[labels == p]
        out.append(Moments.of(rows, w, np.average(rows, axis=0, weights=w)))
    return out
