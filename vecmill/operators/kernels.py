"""Order-dependent improvement of one partition's (or one small neighbourhood's) members, run inside grouped tasks.

Every point in turn may move to another place, and each move counts for the next point at once. ``start``, where given, holds
members and sums (n, a) of all places: the points are then one block of a larger group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Start = tuple[np.ndarray, np.ndarray]

#: What a move has to gain where float noise could move points for ever.
LEAST_GAIN = 1e-9


class Places:
    """Members n and vector sums a of each place."""

    def __init__(self, x: np.ndarray, at: np.ndarray, places: int, start: Start | None = None):
        self.x, self.at = x, at.copy()
        if start is not None:
            self.n, self.a = start[0].copy(), start[1].copy()
            return
        self.n = np.bincount(at, minlength=places).astype(float)
        self.a = np.zeros((places, x.shape[1]))
        np.add.at(self.a, at, x)

    def move(self, i: int, to: int) -> None:
        old = self.at[i]
        self.n[old] -= 1
        self.a[old] -= self.x[i]
        self.n[to] += 1
        self.a[to] += self.x[i]
        self.at[i] = to

    def objective(self) -> float:
        return worth(self.n, self.a)


def worth(n: np.ndarray, a: np.ndarray) -> float:
    """The sum of s/n over places: what moves are to raise."""
    some = n > 0
    return float(((a[some] ** 2).sum(1) / n[some]).sum())


def dealt(ghosts: np.ndarray, n: np.ndarray, a: np.ndarray) -> Places:
    """Ghosts on the side, of two, whose mean is nearer."""
    means = a / np.maximum(n, 1)[:, None]
    d = ((ghosts[:, None] - means) ** 2).sum(2)
    return Places(ghosts, (d[:, 1] < d[:, 0]).astype(int), 2)


def two_sided_gains(p: Places, i: int, ghosts: Places | None = None) -> np.ndarray:
    """What the point adds to either of places 0 and 1; staying adds nothing to a singleton, an empty place is never refilled unless ghosts hold it."""
    n, a = p.n[:2], p.a[:2]
    if ghosts is not None:
        n, a = n + ghosts.n[:2], a + ghosts.a[:2]
    x, rho = p.x[i], float(p.x[i] @ p.x[i])
    s, xa = (a * a).sum(1), a @ x
    empty = -np.inf if ghosts is None else rho
    out = np.array([(s[c] + 2 * xa[c] + rho) / (n[c] + 1) - s[c] / n[c] if n[c] else empty for c in (0, 1)])
    own = p.at[i]
    if own < 2:
        out[own] = 0.0 if p.n[own] <= 1 or n[own] <= 1 else s[own] / n[own] - (s[own] - 2 * xa[own] + rho) / (n[own] - 1)
    return out


def improve(p: Places, passes: int, choose: Callable[[int], int], before: Callable[[], None] | None = None) -> int:
    """Move points until a pass moves none; the number of moves."""
    moves = 0
    for _ in range(passes):
        if before:
            before()
        done = 0
        for i in range(len(p.x)):
            to = choose(i)
            if to != p.at[i]:
                p.move(i, to)
                done += 1
        moves += done
        if not done:
            break
    return moves


def two_way(x: np.ndarray, side: np.ndarray, passes: int = 5, start: Start | None = None, ghosts: np.ndarray | None = None) -> np.ndarray:
    """Sides after coordinate descent; ``ghosts`` weigh on the side whose mean is nearer, and don't move themselves."""
    p = Places(x, side, 2, start)
    if ghosts is None or not len(ghosts):
        improve(p, passes, lambda i: int(np.argmax(two_sided_gains(p, i))))
        return p.at
    held = [Places(ghosts, np.zeros(len(ghosts), int), 2)]

    def deal() -> None:
        held[0] = dealt(ghosts, p.n, p.a)

    improve(p, passes, lambda i: int(np.argmax(two_sided_gains(p, i, held[0]))), deal)
    return p.at


def adopting(x: np.ndarray, at: np.ndarray, passes: int = 5, start: Start | None = None) -> np.ndarray:
    """Places 0 and 1 improve as in ``two_way``; a point elsewhere (place 2) joins the better one where that gains."""
    p = Places(x, at, 3, start)

    def choose(i: int) -> int:
        gains = two_sided_gains(p, i)
        if p.at[i] == 2:
            gains = np.where(p.n[:2] > 0, gains, float(x[i] @ x[i]))
            return int(np.argmax(gains)) if gains.max() > 0 else 2
        return int(np.argmax(gains))

    improve(p, passes, choose)
    return p.at


def local(x: np.ndarray, at: np.ndarray, places: int, passes: int = 5, start: Start | None = None) -> np.ndarray:
    """Each point goes where the sum of s/n rises most, if by more than LEAST_GAIN; a singleton stays."""
    p = Places(x, at, places, start)

    def choose(i: int) -> int:
        own, rho = p.at[i], float(x[i] @ x[i])
        if p.n[own] <= 1:
            return own
        s, xa, n = (p.a * p.a).sum(1), p.a @ x[i], p.n
        lost = s[own] / n[own] - (s[own] - 2 * xa[own] + rho) / (n[own] - 1)
        delta = (s + 2 * xa + rho) / (n + 1) - np.where(n > 0, s / np.maximum(n, 1), 0) - lost
        delta[own] = 0
        return int(np.argmax(delta)) if delta.max() > LEAST_GAIN else own

    improve(p, passes, choose)
    return p.at


def nearest_live(x: np.ndarray, at: np.ndarray, places: int, start: Start | None = None) -> np.ndarray:
    """One pass in which each point goes to the nearest mean, means following every move."""
    p = Places(x, at, places, start)
    improve(p, 1, lambda i: int(np.argmin(np.where(p.n > 0, ((p.a / np.maximum(p.n, 1)[:, None] - x[i]) ** 2).sum(1), np.inf))))
    return p.at


def two_means(x: np.ndarray, side: np.ndarray, rounds: int, start: Start | None = None) -> np.ndarray:
    """Lloyd's algorithm on two sides; ties go to side 0, a side left empty takes the point farthest from the mean."""
    if start is not None:  # a block's part of one round
        d = ((x[:, None] - start[1] / start[0][:, None]) ** 2).sum(2)
        return (d[:, 1] < d[:, 0]).astype(int)
    at = side.copy()
    for _ in range(rounds):
        means = np.stack([x[at == c].mean(0) if (at == c).any() else x[((x - x.mean(0)) ** 2).sum(1).argmax()] for c in (0, 1)])
        d = ((x[:, None] - means) ** 2).sum(2)
        at = (d[:, 1] < d[:, 0]).astype(int)
    return at if 0 < at.sum() < len(at) else side


def curves(x: np.ndarray, side: np.ndarray, checkpoints: list[int]) -> dict[str, list[float]]:
    """Sum of squared errors at each number of passes, by Lloyd and by coordinate descent from the same sides."""
    squares = float((x * x).sum())
    sse = lambda at: squares - Places(x, at, 2).objective()
    return {"lloyd": [sse(two_means(x, side, t)) for t in checkpoints], "cdkm": [sse(local(x, side, 2, t)) for t in checkpoints]}
