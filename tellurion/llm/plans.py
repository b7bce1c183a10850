"""Packing plans over a histogram of lengths. A plan's size depends on the capacity alone, never on how many pieces there are.

A plan is a list of (multiplicity, ((length, copies), ...)): so many sequences, each filled alike.
"""

from __future__ import annotations

import numpy as np

Fill = tuple[tuple[int, int], ...]
Plan = list[tuple[int, Fill]]

#: A round counts no length as covered more than so many times over.
MOST_AHEAD = 4.0


class Capacities:
    """Segment tree over free capacities: where is the smallest one of at least n that some open sequence has?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)

    def set(self, at: int, there: bool) -> None:
        i = at + self.size
        self.some[i] = there
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def first_from(self, least: int) -> int:
        i = least + self.size
        if self.some[i]:
            return least
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit-decreasing, piece by piece in effect; sequences in the same state are moved together."""
    tree = Capacities(capacity)
    state: dict[int, list[tuple[int, Fill]]] = {}

    def put(free: int, many: int, fill: Fill) -> None:
        if many:
            if not state.setdefault(free, []):
                tree.set(free, True)
            state[free].append((many, fill))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            free = tree.first_from(length)
            fresh = free < 0
            if fresh:
                many, fill, free = n, (), capacity
            else:
                many, fill = state[free].pop()
                if not state[free]:
                    tree.set(free, False)
            most = free // length
            used = min(many, n // most)
            each = most if used else n
            used = used or 1
            put(free - each * length, used, (*fill, (length, each)))
            if not fresh:
                put(free, many - used, fill)
            n -= used * each
    return [x for kept in state.values() for x in kept]


def knapsack(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every capacity: the most weight that fits, and the index of the last length taken (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = fits[c]
        best[c] = best[c - 1]
        if k:
            value = best[c - lengths[:k]] + weights[:k]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], last[c] = value[i], i
    return best, last


def fillings(lengths: np.ndarray, counts: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, list[tuple[float, int, dict[int, int]]]]:
    """The most weight that fits, and for every length the best filling that holds it: weight, the length's index, and copies by index. No length more often than it occurs."""
    best, last = knapsack(lengths, weights, capacity)
    down = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0)).tolist()
    last, size, left, worth, found = last.tolist(), lengths.tolist(), counts.tolist(), weights.tolist(), []
    for first in range(len(size)):
        taken, c = {first: 1}, down[capacity - size[first]]
        while c > 0:
            i = last[c]
            if taken.get(i, 0) < left[i]:
                taken[i] = taken.get(i, 0) + 1
            c = down[c - size[i]]
        found.append((sum(worth[i] * k for i, k in taken.items()), first, taken))
    return float(best[capacity]), found


def covering_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 80, rate: float = 0.05, near: float = 4e-3) -> tuple[list[tuple[float, dict[int, int]]], float]:
    """Fractional fillings that cover the counts, nearly, and a lower bound of how many sequences it takes.

    Least sum of x with A x >= counts, a column for each filling, by multiplicative weights: a length's weight is its share of the dual. A round prices the fillings by
    the knapsack, takes a part of the sequences in fillings that are worth nearly as much as any, and multiplies each weight by the exponential of how far its length's cover lags behind. The
    weights begin as the pieces' shares of all tokens, the dual of a program without waste. What the rounds took is averaged.
    """
    n = counts.astype(float)
    share, size = n * lengths / (n @ lengths), counts.tolist()
    bound, taken, covered = float(n @ lengths) / capacity, {}, np.zeros(len(n))
    for step in range(rounds):
        value, found = fillings(lengths, counts, share / n, capacity)
        bound = max(bound, 1 / value)
        top = max(v for v, _, _ in found)
        good = [(min(size[i] / k for i, k in column.items()), column) for v, first, column in found if v >= top * (1 - near)]
        whole = sum(w for w, _ in good)
        got = np.zeros(len(n))
        for w, column in good:
            w /= whole
            key = tuple(column.items())
            taken[key] = taken.get(key, 0.0) + w / rounds
            for i, k in column.items():
                got[i] += w * k
        got *= bound / n
        covered += got / rounds
        share = share * np.exp(-rate / np.sqrt(1 + step / 8) * (np.minimum(got, MOST_AHEAD) - 1))
        share /= share.sum()
    return [(x * bound, dict(c)) for c, x in taken.items()], bound


def rounded(fractions: list[tuple[float, dict[int, int]]], lengths: np.ndarray, counts: np.ndarray) -> tuple[Plan, dict[int, int]]:
    """Whole numbers of the fillings, and the pieces left over.

    The fractions are taken in the order of their size and carried from one filling to the next, so that no more sequences are begun than the program asks for; a filling goes in as
    often as its pieces are left.
    """
    left, plan, carried = counts.copy(), [], 0.0
    for n, column in sorted(fractions, key=lambda f: -f[0]):
        carried += n
        many = min(int(carried + 1e-9), *(int(left[i]) // k for i, k in column.items()))
        if many:
            carried -= many
            for i, k in column.items():
                left[i] -= many * k
            plan.append((many, tuple((int(lengths[i]), k) for i, k in sorted(column.items(), reverse=True))))
        carried = min(carried, 1.0)
    return plan, {int(n): int(k) for n, k in zip(lengths, left) if k}


def sequences(plan: Plan) -> int:
    return sum(many for many, _ in plan)


def configuration_lp(histogram: dict[int, int], capacity: int, most_solved: int = 8) -> Plan:
    """The covering program over fillings, solved by multiplicative weights with the knapsack as its pricing, then rounded. What rounding leaves is a smaller
    histogram, whose program is solved in turn; the last rest goes to best-fit-decreasing. Where that alone takes fewer sequences for the whole, its plan is returned."""
    plan, rest, whole = [], dict(histogram), None
    for solved in range(most_solved):
        if len(rest) > 1:
            lengths = np.array(sorted(rest), np.int64)
            counts = np.array([rest[n] for n in lengths.tolist()], np.int64)
            placed, rest = rounded(covering_lp(lengths, counts, capacity, 20 if solved else 80)[0], lengths, counts)
            plan = plan + placed
        found = plan + best_fit_decreasing(rest, capacity)
        whole = found if whole is None or sequences(found) <= sequences(whole) else whole
        if len(rest) < 2 or not placed:
            break
    plain = best_fit_decreasing(histogram, capacity)
    return plain if sequences(plain) < sequences(whole) else whole


class Slots:
    """Where the n-th piece of a length goes: sequence and offset."""

    def __init__(self, plan: Plan):
        rows, base, seen = [], 0, {}
        for many, fill in plan:
            offset = 0
            for length, copies in fill:
                rank = seen.get(length, 0)
                rows.append((length, rank, copies, base, offset))
                seen[length] = rank + many * copies
                offset += length * copies
            base += many
        rows.sort()
        self.count = base
        self.length, self.rank, self.copies, self.base, self.offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
        self.key = self.length * (1 << 50) + self.rank

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length.astype(np.int64) * (1 << 50) + rank, "right") - 1
        n = rank - self.rank[i]
        return self.base[i] + n // self.copies[i], self.offset[i] + n % self.copies[i] * length
