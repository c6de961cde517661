"""How much of two texts lies in matching blocks, for many pairs at once.

The longest common block of two texts, the first of several, splits both; what is left and right
of it is treated in the same way. All pairs of a batch go through that together: in each round
every open pair of stretches has its longest block found by one dynamic programme, whose rows are
numpy operations over the whole batch.
"""

from __future__ import annotations

import numpy as np

#: Cells of the dynamic programme that are filled at once.
AT_ONCE = 1 << 20
#: From so many characters on, those that make up more than a hundredth of a text begin no block; they may extend one.
LONG = 200


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets)."""
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), ends


def _frequent(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which characters of long texts are too frequent to begin a block."""
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size)), size)
    _, which, count = np.unique(owner << 32 | code, return_inverse=True, return_counts=True)
    return (size[owner] >= LONG) & (count[which] > size[owner] // 100 + 1)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, end in a, end in b) of the longest common block of each row of ``a`` and ``b``, the first in a, then in b."""
    best, at, to = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    run = np.zeros((len(b), b.shape[1] + 1), np.int32)
    for i in range(a.shape[1]):
        run[:, 1:] = (run[:, :-1] + 1) * (b == a[:, i : i + 1])
        most = run.max(axis=1)
        more = np.flatnonzero(most > best)
        if len(more):
            best[more], at[more], to[more] = most[more], i + 1, run[more].argmax(axis=1)
    return best, at, to


def matching_ratios(first: list[str], second: list[str]) -> np.ndarray:
    """Twice the characters in matching blocks over all characters of each pair; 1 for two empty texts."""
    (x, xs), (y, ys) = _codes(first), _codes(second)
    begins = np.where(_frequent(y, ys), -3, y)
    x, y, begins = (np.append(v, -4) for v in (x, y, begins))
    matched = np.zeros(len(first), np.int64)
    pair = np.arange(len(first))
    open_ = np.stack((pair, xs[:-1], xs[1:], ys[:-1], ys[1:]), axis=1)
    while len(open_ := open_[(open_[:, 1] < open_[:, 2]) & (open_[:, 3] < open_[:, 4])]):
        open_ = open_[np.argsort(open_[:, 4] - open_[:, 3], kind="stable")]
        found, i = [], 0
        while i < len(open_):
            most = open_[min(i + AT_ONCE // max(1, int(open_[i, 4] - open_[i, 3])), len(open_)) - 1]
            part = open_[i : i + max(1, AT_ONCE // max(1, int(most[4] - most[3])))]
            i += len(part)
            n, m = part[:, 2] - part[:, 1], part[:, 4] - part[:, 3]
            left, right = np.arange(n.max())[None], np.arange(m.max())[None]
            a = np.where(left < n[:, None], x[np.minimum(part[:, 1:2] + left, len(x) - 1)], -1)
            b = np.where(right < m[:, None], begins[np.minimum(part[:, 3:4] + right, len(y) - 1)], -2)
            size, at, to = _longest(a, b)
            lo_x, lo_y = part[:, 1] + at - size, part[:, 3] + to - size
            hi_x, hi_y = lo_x + size, lo_y + size
            lo_x, lo_y, hi_x, hi_y = (np.where(size > 0, v, w) for v, w in ((lo_x, part[:, 1]), (lo_y, part[:, 3]), (hi_x, part[:, 1]), (hi_y, part[:, 3])))
            while (grow := (lo_x > part[:, 1]) & (lo_y > part[:, 3]) & (x[lo_x - 1] == y[lo_y - 1])).any():
                lo_x, lo_y = lo_x - grow, lo_y - grow
            while (grow := (hi_x < part[:, 2]) & (hi_y < part[:, 4]) & (x[hi_x] == y[hi_y])).any():
                hi_x, hi_y = hi_x + grow, hi_y + grow
            hit = hi_x > lo_x
            np.add.at(matched, part[hit, 0], (hi_x - lo_x)[hit])
            found.append(np.stack((part[:, 0], part[:, 1], lo_x, part[:, 3], lo_y), axis=1)[hit])
            found.append(np.stack((part[:, 0], hi_x, part[:, 2], hi_y, part[:, 4]), axis=1)[hit])
        open_ = np.concatenate(found)
    total = np.diff(xs) + np.diff(ys)
    return np.where(total > 0, 2 * matched / np.maximum(1, total), 1.0)
