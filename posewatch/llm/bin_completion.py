"""Bin completion over a histogram of lengths: few bins by branch and bound.

Pieces of equal length are interchangeable, so an instance is a count for each length up
to the capacity, and a solution is a list of patterns with the number of bins that each
one fills. Both stay as small as the capacity allows, whatever the number of pieces.

A node takes the largest piece left and goes through the fillings of the room beside it,
fullest first. A filling is dominated if some of its pieces could be exchanged for one
left piece that is as long together or longer and still fits; dominated ones are
passed over. The same choice is applied to as many bins as there are pieces for it, and
to fewer on the way back. A branch ends where the waste so far leaves no way to beat the
incumbent. The first incumbent is best fit with the largest pieces first; the search ends
at the lower bound, or after `nodes` nodes with the best solution so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NODES = 4_000
Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any solution needs: for each border k, pieces above capacity - k stand
    alone, and what is at least k beside the upper halves has to fit beside them."""
    n = np.zeros(capacity + 1, dtype=object)
    for length, c in counts.items():
        n[length] = c
    size = n * np.arange(capacity + 1, dtype=object)
    most = -(-int(size.sum()) // capacity)
    half = capacity // 2
    upper_n = int(n[half + 1 :].sum())
    pieces_n, pieces_size = np.cumsum(n), np.cumsum(size)
    for k in range(1, half + 1):
        alone = int(pieces_n[-1] - pieces_n[capacity - k])
        room = (upper_n - alone) * capacity - int(pieces_size[capacity - k] - pieces_size[half])
        middle = int(pieces_size[half] - pieces_size[k - 1])
        most = max(most, upper_n + max(0, -(-(middle - room) // capacity)))
    return most


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Longest pieces first, each into the fullest bin that takes it."""
    open_bins: dict[int, list[tuple[int, Pattern]]] = {}  # room left -> (bins, pattern)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        rooms = sorted(r for r in open_bins if r >= length)
        for room in [*rooms, capacity]:
            times = room // length
            groups = open_bins.pop(room, []) if room in rooms else []
            if room == capacity:
                groups = [(-(-left // times), ())]
            for bins, pattern in groups:
                whole = min(bins, left // times)
                rest = min(1, bins - whole) * (left - whole * times)
                for n, t in ((whole, times), (int(rest > 0), rest)):
                    if n:
                        open_bins.setdefault(room - t * length, []).append((n, (*pattern, (length, t))))
                        bins -= n
                        left -= n * t
                if bins and pattern:
                    open_bins.setdefault(room, []).append((bins, pattern))
            if not left:
                break
    return [x for groups in open_bins.values() for x in groups]


def reachable(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """For each number of lengths, shortest first, the sums up to `room` as bits."""
    every, sums = (1 << (room + 1)) - 1, [1]
    for length in lengths:
        bits, left, step = sums[-1], min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            bits |= bits << (length * step)
            left -= step
            step *= 2
        sums.append(bits & every)
    return sums


def with_sum(target: int, lengths: list[int], counts: list[int], sums: list[int]) -> Iterator[Pattern]:
    """Every choice of pieces with this sum, long pieces first; no branch is tried in vain."""
    stack = [(target, len(lengths), ())]
    while stack:
        left, i, chosen = stack.pop()
        if not left:
            yield chosen
            continue
        # The shortest lengths that are enough; longer ones are left out on another branch.
        length = lengths[i - 1]
        for times in range(min(counts[length], left // length) + 1):
            if sums[i - 1] >> (left - times * length) & 1:
                stack.append((left - times * length, i - 1, (*chosen, (length, times)) if times else chosen))


def dominated(filling: Pattern, slack: int, left: int) -> bool:
    """Whether pieces of the filling can make room for one longer piece of those `left` (bits)."""
    if left & ((2 << slack) - 2):
        return True  # one more piece fits
    sums, many = 1, 0  # sums of any pieces; sums of two pieces or more
    for length, times in filling:
        for _ in range(times):
            many |= (many << length) | ((sums & ~1) << length)
            sums |= sums << length
    longer = 0
    for length, _ in filling:
        longer |= ((1 << slack) - 1) << (length + 1)
    step, width = 1, slack + 1
    while step < width:  # every sum, and up to `slack` more
        more = min(step, width - step)
        many |= many << more
        step += more
    return bool(left & (longer | many))


def solve(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[int, Pattern]]:
    """Patterns with their numbers of bins; no bin holds more than the capacity.

    Exact while no choice fits more than four bins at once and `nodes` suffice; else the
    best of the incumbents found. No counts give no bins. Lengths run from 1 to the capacity.
    """
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("a length lies outside 1 to the capacity")
    total = sum(k * v for k, v in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    n_best = sum(n for n, _ in best)
    left = [counts.get(i, 0) for i in range(capacity + 1)]
    have = sum(1 << i for i in counts)

    def choices(waste: int) -> Iterator[tuple[int, Pattern]]:
        longest = have.bit_length() - 1
        left[longest] -= 1
        room = capacity - longest
        lengths = [i for i in range(1, room + 1) if left[i]]
        sums = reachable(lengths, left, room)
        # The counts change while other nodes run, so this node looks at its own copy.
        own = left[: room + 1]
        left[longest] += 1
        n_long = left[longest]
        for slack in range(room + 1):
            if slack > (n_best - 1) * capacity - total - waste:
                return
            if not sums[-1] >> (room - slack) & 1:
                continue
            for filling in with_sum(room - slack, lengths, own, sums):
                used = dict(filling)
                spare = sum(1 << i for i in lengths if own[i] > used.get(i, 0))
                if dominated(filling, slack, spare):
                    continue
                whole = {**used, longest: used.get(longest, 0) + 1}
                most = min((n_long if i == longest else own[i]) // t for i, t in whole.items())
                pattern = tuple(sorted(whole.items(), reverse=True))
                for k in range(most, 0, -1) if most <= 4 else (most, most // 2, 1):
                    yield k, pattern

    def take(k: int, pattern: Pattern) -> None:
        nonlocal have
        for length, times in pattern:
            left[length] -= k * times
            have = have | 1 << length if left[length] else have & ~(1 << length)

    path: list[tuple[int, Pattern]] = []
    waste = bins = 0
    open_nodes = [choices(0)] if n_best > bound else []
    while open_nodes and nodes and n_best > bound:
        k, pattern = next(open_nodes[-1], (0, ()))
        if not k:
            open_nodes.pop()
            if path:
                k, pattern = path.pop()
                take(-k, pattern)
                bins -= k
                waste -= k * (capacity - sum(a * b for a, b in pattern))
            continue
        nodes -= 1
        take(k, pattern)
        path.append((k, pattern))
        bins += k
        waste += k * (capacity - sum(a * b for a, b in pattern))
        if not have and bins < n_best:
            best, n_best = list(path), bins
        if not have or waste > (n_best - 1) * capacity - total:
            open_nodes.append(iter(()))  # nothing below: the next step takes this one back
        else:
            open_nodes.append(choices(waste))
    return best
