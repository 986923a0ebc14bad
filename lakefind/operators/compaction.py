"""The merge planner: which segments are merged into one.  Pure and deterministic."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MergePolicy:
    """Levels of segments of like size; a full level is merged."""

    merge_factor: int = 10
    max_merge: int = 12
    smallest_tier: int = 100_000
    mature: int = 10_000_000

    @classmethod
    def of(cls, max_segments: int) -> MergePolicy:
        return cls(max_segments, max_segments + 2)


def levels(sizes: list[int], policy: MergePolicy = MergePolicy()) -> list[list[int]]:
    """Numbers of the segments of each level; sizes ascend, and a level spans a factor of three."""
    out: list[list[int]] = []
    boundary = 0
    for i, size in enumerate(sizes):
        if not out or size >= boundary:
            boundary = 3 * size if out else max(3 * size, policy.smallest_tier)
            out.append([])
        out[-1].append(i)
    return out


def plan(segments: dict[str, int], policy: MergePolicy = MergePolicy()) -> list[list[str]]:
    """Merges to do, at most one a level, largest level first; mature segments are left alone."""
    open_ = sorted((size, name) for name, size in segments.items() if size < policy.mature)
    out = []
    for level in reversed(levels([size for size, _ in open_], policy)):
        taken, total = 0, 0
        for i in reversed(level):
            if taken >= 2 and (taken >= policy.max_merge or total >= policy.mature):
                break
            taken, total = taken + 1, total + open_[i][0]
        if taken >= 2 and (taken >= policy.merge_factor or total >= policy.mature):
            out.append([open_[i][1] for i in level[-taken:]])
    return out
