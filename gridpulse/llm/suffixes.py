"""Suffix arrays of many short strings at once, by linear grouping construction.

Every suffix starts with its Lyndon prefix: the stretch up to the next smaller suffix. First the suffixes are sorted into
groups of equal Lyndon prefixes. They start in groups of equal first symbols, and groups are processed in
descending order: for each suffix of the group the previous position in a lower group is found by following earlier
such pointers, and every position found moves to a new group just above its old one, the higher the more pointers it
got, as that many copies of the processed prefix follow its own. Then each group's order is emitted: suffixes with equal Lyndon
prefixes are ordered by their next smaller suffixes, so going through the suffixes in ascending order and placing all whose
next smaller suffix that is, each at the front of what is left of its group, finishes the array without renaming and sorting again.

Both phases advance all strings together: a step takes the highest unprocessed group, or the next place of the array, of every
string, and works on all their suffixes with array operations. Steps follow the longest string, so strings of like
length belong together.
"""

from __future__ import annotations

import numpy as np


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ..., size[i] of them, for each i in turn."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class Grouping:
    """Suffixes of all strings in groups. A group is named by its first place in ``order``, whose ranges it fills."""

    def __init__(self, symbols: np.ndarray, start: np.ndarray):
        n = len(symbols)
        self.symbols, self.start, self.end = symbols, start, np.append(start[1:], n)
        string = np.repeat(np.arange(len(start)), self.end - start)
        key = string * (int(symbols.max()) + 1) + symbols
        self.order = np.argsort(key, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        head = np.flatnonzero(np.diff(key[self.order], prepend=-1) != 0)
        self.size, self.length = np.zeros(n, np.int64), np.ones(n, np.int64)  # by group
        self.size[head] = np.diff(head, append=n)
        self.group = np.empty(n, np.int64)
        self.group[self.order] = np.repeat(head, self.size[head])
        self.previous = np.full(n, -1)
        self._moves = np.zeros(n, bool)

    def process(self) -> None:
        """All groups of all strings, the highest first."""
        top, bottom = self.end.copy(), self.start + 1  # the lowest group is the closing symbol alone
        while True:
            active = top > bottom
            if not active.all():
                top, bottom = top[active], bottom[active]
            if not len(top):
                return
            first = self.group[self.order[top - 1]]
            size = top - first
            self._regroup(self.order[ragged(first, size)], np.repeat(first, size))
            top = first

    def _previous_lower(self, member: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For each member the nearest position before it whose group is lower; a string's first has the symbol before the string."""
        at, unsure = member - 1, np.arange(len(member))
        self.previous[member] = at
        while True:
            unsure = unsure[self.group[at[unsure]] >= group[unsure]]
            if not len(unsure):
                return at
            at[unsure] = self.previous[at[unsure]]
            self.previous[member[unsure]] = at[unsure]

    def _regroup(self, member: np.ndarray, group: np.ndarray) -> None:
        found = self._previous_lower(member, group)
        inside = self.symbols[found] != 0
        found, group = found[inside], group[inside]
        if not len(found):
            return
        order = np.argsort(found)
        found, group = found[order], group[order]
        head = np.flatnonzero(np.diff(found, prepend=-1) != 0)
        position, times, group = found[head], np.diff(head, append=len(found)), group[head]
        old = self.group[position]
        order = np.lexsort((times, old))
        position, times, group, old = position[order], times[order], group[order], old[order]
        new_old = np.diff(old, prepend=-1) != 0
        head = np.flatnonzero(new_old)
        moved = np.diff(head, append=len(old))
        left = self.size[old[head]] - moved
        tail = np.repeat(old[head] + left, moved)
        target = np.arange(len(old)) - np.repeat(head, moved) + tail
        # The last places of the old group are for those that move; whoever stays swaps with them.
        self._moves[position] = True
        there = self.order[target]
        there = there[~self._moves[there]]
        self._moves[position] = False
        freed = self.place[position]
        freed = freed[freed < tail]
        self.order[freed], self.place[there] = there, freed
        self.order[target], self.place[position] = position, target
        cut = np.flatnonzero(new_old | (np.diff(times, prepend=-1) != 0))
        name, count = target[cut], np.diff(cut, append=len(old))
        length = self.length[old[cut]] + times[cut] * self.length[group[cut]]
        self.size[old[head]] = left
        self.size[name], self.length[name] = count, length
        self.group[position] = np.repeat(name, count)

    def emit(self) -> np.ndarray:
        """The suffix arrays, one string after the other."""
        n = len(self.symbols)
        child = np.flatnonzero(self.symbols != 0)
        parent = child + self.length[self.group[child]]  # the next smaller suffix
        child = child[np.argsort(parent, kind="stable")]
        count = np.bincount(parent, minlength=n)
        first = np.cumsum(count) - count
        out, front = np.empty(n, np.int64), np.arange(n)
        out[self.start] = self.end - 1
        at, end = self.start.copy(), self.end
        while len(at):
            placed = out[at]
            ready = child[ragged(first[placed], count[placed])]
            group = self.group[ready]
            to = front[group]
            out[to], front[group] = ready, to + 1
            at = at + 1
            active = at < end
            if not active.all():
                at, end = at[active], end[active]
        return out


def suffix_arrays(symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The suffix arrays of strings laid end to end. Each string ends in a symbol 0, which occurs nowhere else in it."""
    # One more string at the front gives the first position something lower before it.
    grouping = Grouping(np.concatenate(([0], symbols)).astype(np.int64), np.concatenate(([0], start + 1)))
    grouping.process()
    return grouping.emit()[1:] - 1
