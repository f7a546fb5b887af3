"""Planning with overflow: what does not fit is put off and dealt to further samples, in order, until all is placed or the samples run out."""

from __future__ import annotations

import pandas as pd

#: Targets of a sample, what they may take of it together, and further samples at most.
PER_SAMPLE, CAPACITY, MOST_OVERFLOW = 6, 100, 40


def laid_out(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(places of what fits in turn, places of what does not). The first one on an empty sample always fits."""
    placed, left, room = [], [], capacity
    for k, n in enumerate(sizes):
        if not placed or n <= room:
            placed.append(k)
            room -= n
        else:
            left.append(k)
    return placed, left


def planned(sizes: list[int], per_sample: int = PER_SAMPLE, capacity: int = CAPACITY, most_overflow: int = MOST_OVERFLOW) -> tuple[list[int | None], int]:
    """(the sample of each target, None if it could not be placed; samples made). Targets are dealt in order, per_sample to a sample."""
    sample: list[int | None] = [None] * len(sizes)
    pending: list[int] = []
    made = 0

    def place(targets: list[int]) -> list[int]:
        nonlocal made
        fits, left = laid_out([sizes[t] for t in targets], capacity)
        for k in fits:
            sample[targets[k]] = made
        made += 1
        return [targets[k] for k in left]

    for at in range(0, len(sizes), per_sample):
        pending += place(list(range(at, min(at + per_sample, len(sizes)))))
    first = made
    while pending and made - first < most_overflow:
        take, pending = pending[:per_sample], pending[per_sample:]
        pending += place(take)
    return sample, made


def overflow_plan(group: pd.DataFrame) -> pd.DataFrame:
    """Of one split's targets (split, id, size): where each is, whether it was put off, and whether the split is planned or refused."""
    g = group.sort_values("id")
    sample, made = planned(g["size"].tolist())
    first = -(-len(g) // PER_SAMPLE)
    refused = any(s is None for s in sample)
    return pd.DataFrame({
        "split": g["split"].to_numpy(), "id": g["id"].to_numpy(), "sample": [-1 if s is None else s for s in sample], "rescheduled": [s is None or s >= first for s in sample],
        "samples": made, "verdict": "REFUSED" if refused else "PLANNED",
    })
