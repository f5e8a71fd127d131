"""Bin packing of whole-number sizes by bin completion: branch and bound over fillings around the largest size.

An instance is a histogram, how many items have each size, so its cost depends on the capacity, not on the number of
items. A solution is a list of (how many bins, ((size, how often in a bin), ...)).
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

#: Nodes that the search visits, fillings that a node branches over, fillings that it looks at to find these, and nodes
#: between two best-fit packings. They bound the search, not the instance: every item is packed whatever they are.
NODES, WIDTH, TRIES, STRIDE = 4096, 8, 300, 64

Packing = list[tuple[int, tuple[tuple[int, int], ...]]]


def best_fit(counts: np.ndarray, capacity: int) -> Packing:
    """Best fit, sizes descending. Alike bins are handled together: as a size goes to the fullest bin that takes it, and
    then to that bin again, every bin in turn takes as many of the size as it holds."""
    groups: dict[int, list[tuple[int, tuple]]] = {}  # by room left: (bins, contents)
    rooms: list[int] = []

    def put(room: int, bins: int, contents: tuple) -> None:
        if bins:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((bins, contents))

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        at = bisect_left(rooms, size)
        filled = []
        while left and at < len(rooms):
            room = rooms[at]
            holds, kept = room // size, []
            for bins, contents in groups[room]:
                full = min(bins, left // holds)
                left -= full * holds
                filled.append((room - holds * size, full, (*contents, (size, holds))))
                part = 1 if left and full < bins else 0
                if part:
                    filled.append((room - left * size, 1, (*contents, (size, left))))
                    left = 0
                if bins - full - part:
                    kept.append((bins - full - part, contents))
            if kept:
                groups[room] = kept
                at += 1
            else:
                del groups[room], rooms[at]
        holds = capacity // size
        filled.append((capacity - holds * size, left // holds, ((size, holds),)))
        if left % holds:
            filled.append((capacity - left % holds * size, 1, ((size, left % holds),)))
        for room, bins, contents in filled:
            put(room, bins, contents)
    return [g for room in rooms for g in groups[room]]


def least_waste(counts: np.ndarray, capacity: int) -> int:
    """Room that no packing of these items can fill: beside a size of over half a bin only sizes up to the room left
    there fit, so where these don't suffice, room stays."""
    waste = spare = 0
    for room in range(0, (capacity - 1) // 2 + 1):  # room beside a size above half, ascending
        spare += room * int(counts[room])
        need = room * int(counts[capacity - room])
        waste += max(0, need - spare)
        spare = max(0, spare - need)
    return waste


def fewest_bins(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below."""
    total = int(counts @ np.arange(len(counts), dtype=np.int64))
    return -(-(total + least_waste(counts, capacity)) // capacity)


def _inside(small: tuple[int, ...], rooms: list[int]) -> bool:
    """Whether all of ``small`` (descending) fit together into ``rooms``."""
    if not small:
        return True
    for k in sorted({r: i for i, r in enumerate(rooms) if r >= small[0]}.values()):
        if _inside(small[1:], [*rooms[:k], rooms[k] - small[0], *rooms[k + 1 :]]):
            return True
    return False


def fillings(counts: np.ndarray, room: int, width: int = WIDTH, tries: int = TRIES) -> list[tuple[int, ...]]:
    """At most ``width`` undominated fillings of ``room``, each a descending tuple of sizes, least waste first.

    A filling that takes another item isn't one, and one whose items fit into the items of another is dominated:
    exchanging the two never costs a bin.
    """
    sizes = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    if not sizes:
        return [()]
    smallest = sizes[-1]
    found: list[tuple[int, tuple[int, ...]]] = []
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    looked = 0
    while stack and looked < tries:
        k, left, taken = stack.pop()
        while k < len(sizes) and sizes[k] > left:
            k += 1
        if k == len(sizes):
            looked += 1
            free = left < smallest or all(taken.count(s) >= counts[s] for s in sizes if s <= left)
            if free:
                found.append((left, taken))
            continue
        size = sizes[k]
        most = min(left // size, int(counts[size]))
        for n in range(most + 1):  # the most is looked at first
            stack.append((k + 1, left - n * size, taken + (size,) * n))
    found.sort(key=lambda x: (x[0], len(x[1]), [-s for s in x[1]]))
    kept: list[tuple[int, ...]] = []
    for _, taken in found:
        if len(kept) == width:
            break
        if not any(_inside(taken, list(other)) for other in kept if len(other) <= len(taken) <= 12):
            kept.append(taken)
    return kept


def pack(counts: np.ndarray, capacity: int, nodes: int = NODES, width: int = WIDTH, tries: int = TRIES) -> Packing:
    """A packing of ``counts[size]`` items of each size (from 1 to ``capacity``) into few bins.

    Depth-first search: a node takes the largest size left and branches over the fillings around it, each used as often
    as the items allow, then once. Best-fit packings, of all items and at some nodes of what is left, and packings that a
    path completes are incumbents; a node goes where its waste, with the least waste of what is left, would need as many
    bins as the incumbent. The search ends when the incumbent meets the lower bound, or after ``nodes`` nodes. No size,
    no bins.
    """
    counts = counts.astype(np.int64).copy()
    total = int(counts @ np.arange(len(counts), dtype=np.int64))
    best = best_fit(counts, capacity)
    bins = sum(n for n, _ in best)
    least = fewest_bins(counts, capacity)

    def branches(left: np.ndarray):
        top = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[top] -= 1
        for inner in fillings(rest, capacity - top, width, tries):
            sizes, times = np.unique([top, *inner], return_counts=True)
            filling = tuple(zip(sizes[::-1].tolist(), times[::-1].tolist(), strict=True))
            often = min(int(left[s]) // t for s, t in filling)
            for n in {often: 0, 1: 0}:
                yield n, filling

    seen = 1
    path: list[tuple[int, tuple]] = []
    open_ = [(counts, 0, 0, branches(counts))] if total else []
    while open_ and bins > least and seen < nodes:
        left, used, waste, todo = open_[-1]
        step = next(todo, None)
        if step is None:
            open_.pop()
            if path:
                path.pop()
            continue
        n, filling = step
        rest, lost = left.copy(), waste
        for size, times in filling:
            rest[size] -= n * times
        lost += n * (capacity - sum(s * t for s, t in filling))
        seen += 1
        if lost + least_waste(rest, capacity) > (bins - 1) * capacity - total:
            continue
        path.append(step)
        tail = best_fit(rest, capacity) if seen % STRIDE == 0 or int(rest.sum()) <= STRIDE else None
        if tail is not None and (now := used + n + sum(m for m, _ in tail)) < bins:
            best, bins = [*path, *tail], now
        if rest.any():
            open_.append((rest, used + n, lost, branches(rest)))
        else:
            path.pop()
    return best
