"""Boxes that claim boxes of their own screen, one each, many whole screens at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of boxes that a task looks at at once.
PAIRS = 1_000_000


class Boxes:
    """x, y, w, h of boxes that come in order of their group's number. NaN is null: least and greatest pass over it."""

    def __init__(self, group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> None:
        self.group, self.x, self.y, self.x1, self.y1, self.area = group, x, y, x + w, y + h, w * h


def of_one_group(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of the pairs of one group; a and b are sorted group numbers. A bounded number of pairs at a time, but all of a row of a."""
    first = np.searchsorted(b, a, "left")
    n = np.searchsorted(b, a, "right") - first
    ends = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(n):
        to = max(int(np.searchsorted(ends, ends[at] + PAIRS, "right")) - 1, at + 1)
        i = np.repeat(np.arange(at, to), n[at:to])
        yield i, np.arange(len(i)) + np.repeat(first[at:to] - (ends[at:to] - ends[at]), n[at:to])
        at = to


def meeting(a: Boxes, b: Boxes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a, place in b, area in common, area of both) of the pairs of a group that have anything in common, a bounded number of pairs at a time.

    Boxes without an area, which odd tables have, meet all others, as a rule on sums of areas may hold for them.
    """
    sound = bool((a.area > 0).all() and (b.area > 0).all())
    for i, j in of_one_group(a.group, b.group):
        dx = np.fmin(a.x1[i], b.x1[j]) - np.fmax(a.x[i], b.x[j])
        if sound:
            near = np.flatnonzero(dx > 0)
            i, j, dx = i[near], j[near], dx[near]
        dy = np.fmin(a.y1[i], b.y1[j]) - np.fmax(a.y[i], b.y[j])
        if sound:
            near = np.flatnonzero(dy > 0)
            i, j, dx, dy = i[near], j[near], dx[near], dy[near]
        common = np.fmax(dx, 0) * np.fmax(dy, 0)
        yield i, j, common, a.area[i] + b.area[j] - common


def ratio(common: np.ndarray, either: np.ndarray) -> np.ndarray:
    return np.divide(common, either, out=np.zeros(len(common)), where=(common > 0) & (either > 0))


def together(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The columns of parts, each whole."""
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def claimed(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs that are claims: in the order given, by group and left, each left takes the first right that nobody in its group has."""
    taken, own, who, has, out = set(), None, None, False, []
    for k, (g, a, b) in enumerate(zip(group.tolist(), left.tolist(), right.tolist(), strict=True)):
        if g != own:
            taken, own, who = set(), g, None
        if a != who:
            who, has = a, False
        if not has and b not in taken:
            taken.add(b)
            has = True
            out.append(k)
    return np.array(out, dtype=np.int64)


def known_pairs(group: np.ndarray, own: np.ndarray, groups: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each (group, own) is among (groups, ids)."""
    known = set(zip(groups.tolist(), ids.tolist(), strict=True))
    return np.fromiter((k in known for k in zip(group.tolist(), own.tolist(), strict=True)), bool, len(own))
