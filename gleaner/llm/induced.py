"""Suffix sorting of a shard by external induced sorting.

Suffixes are of type S (less than the next suffix) or L. The leftmost S of each
run are sorted first: their substrings by induction, then, where these repeat, by
the same procedure over the string of their names. From them all L suffixes are
induced in ascending order of characters, then all S suffixes in descending order.

Both passes work through a queue of tuples (character, position) that is ordered
by character, then by arrival. It takes and gives whole batches, keeps sorted runs,
and moves runs to disk (a nameless file of the task) beyond `memory` tuples. A
batch takes a range of characters; where it would induce into its own range it is
cut there, so that no tuple is taken before those that come before it.
"""

from __future__ import annotations

import tempfile

import numpy as np

from gleaner.llm.blocks import span_hashes

MEMORY = 4 << 20


_TOP = 1 << 60


class BatchQueue:
    """Tuples by key (ascending), then by arrival."""

    FEW = 16

    def __init__(self, memory: int = MEMORY):
        self.memory, self.runs, self.held = memory, [], 0  # run: keys, values, head, whether in memory

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        self.runs.append([keys[order], values[order], 0, True])
        self.held += len(keys)
        if len(self.runs) > self.FEW:
            self._merge()

    def _merge(self) -> None:
        """The latest runs become one, as long as they aren't much smaller than the run before."""
        k, size = len(self.runs) - 1, 0
        while k >= 0 and self.runs[k][3] and len(self.runs[k][0]) - self.runs[k][2] <= 2 * size + 1024:
            size += len(self.runs[k][0]) - self.runs[k][2]
            k -= 1
        k += 1
        if len(self.runs) - k < 2:
            k = max(0, len(self.runs) - self.FEW // 2)
        last = self.runs[k:]
        keys = np.concatenate([r[0][r[2] :] for r in last])
        values = np.concatenate([r[1][r[2] :] for r in last])
        order = np.argsort(keys, kind="stable")
        self.runs[k:] = [[keys[order], values[order], 0, True]]
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for r in self.runs:
            if r[3] and len(r[0]) - r[2] >= 1024:
                n = len(r[0]) - r[2]
                self.held -= n
                for i in (0, 1):
                    file = tempfile.TemporaryFile()  # noqa: SIM115  goes with the mapping
                    kept = np.memmap(file, r[i].dtype, "w+", shape=(n,))
                    kept[:] = r[i][r[2] :]
                    r[i] = kept
                r[2], r[3] = 0, False

    def first(self, few: int) -> tuple[int, int] | None:
        """The least key, and a key below which no run has more than `few` tuples, or their first key."""
        heads = [r for r in self.runs if r[2] < len(r[0])]
        if not heads:
            return None
        least = min(int(r[0][r[2]]) for r in heads)
        ahead = [int(r[0][r[2] + few]) if r[2] + few < len(r[0]) else _TOP for r in heads]
        return least, max(least + 1, min(ahead))

    def pop(self, below: int) -> tuple[np.ndarray, np.ndarray]:
        keys, values, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for r in self.runs:
            end = r[2] + int(np.searchsorted(r[0][r[2] :], below))
            keys.append(np.asarray(r[0][r[2] : end]))
            values.append(np.asarray(r[1][r[2] : end]))
            self.held -= (end - r[2]) if r[3] else 0
            r[2] = end
            if end < len(r[0]):
                rest.append(r)
        self.runs = rest
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def restore(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put back what was popped last; it comes before all that arrives from now on."""
        if len(keys):
            self.runs.insert(0, [keys, values, 0, True])
            self.held += len(keys)


def _types(t: np.ndarray) -> np.ndarray:
    """True: type S. The last character is less than all others."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64))).astype(np.int8)
    change = np.where(step != 0, np.arange(n - 1), n)
    ahead = np.minimum.accumulate(change[::-1])[::-1]  # the next place where characters differ
    return np.append(step[np.minimum(ahead, n - 2)] > 0, True)


def _pass(t: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, sign: int, memory: int) -> np.ndarray:
    """Positions in the order in which the pass meets them: the seeds, given in
    order, and all suffixes of the `wanted` type that they induce. sign: 1 for
    ascending characters, -1 for descending ones. In a character's bucket induced
    suffixes come before the seeds."""
    induced, given = BatchQueue(memory), BatchQueue(memory)
    given.push(sign * t[seeds], seeds)
    out, few = [], 1024
    while True:
        heads = [h for h in (induced.first(few), given.first(few)) if h]
        if not heads:
            return np.concatenate(out)
        least, below = min(h[0] for h in heads), min(h[1] for h in heads)
        below = max(below, least + 1)
        k1, p1 = induced.pop(below)
        k2, p2 = given.pop(below)
        if below > least + 1:
            before = np.concatenate([p1, p2]) - 1
            before = before[before >= 0]
            into = sign * t[before[wanted[before]]]
            into = into[into < below]
            if len(into):  # cut where the batch would reach into itself
                cut = max(int(into.min()), least + 1)
                few = max(16, few // 2)
                a, b = np.searchsorted(k1, cut), np.searchsorted(k2, cut)
                induced.restore(k1[a:], p1[a:])
                given.restore(k2[b:], p2[b:])
                k1, p1, k2, p2, below = k1[:a], p1[:a], k2[:b], p2[:b], cut
            else:
                few = min(1 << 20, few + few // 2)
        if below == least + 1:  # one character: those it induces itself follow in turns
            turns, turn = [p1], p1
            while len(turn):
                before = turn - 1
                before = before[before >= 0]
                turn = before[wanted[before] & (sign * t[before] == least)]
                turns.append(turn)
            batch = np.concatenate([*turns, p2])
        else:
            keys = np.concatenate([k1, k2])
            batch = np.concatenate([p1, p2])[np.argsort(keys, kind="stable")]
        out.append(batch)
        before = batch - 1
        before = before[before >= 0]
        before = before[wanted[before]]
        keys = sign * t[before]
        induced.push(keys[keys >= below], before[keys >= below])


def _induce(t: np.ndarray, s: np.ndarray, stars: np.ndarray, memory: int) -> np.ndarray:
    met = _pass(t, ~s, stars, 1, memory)
    larger = met[~s[met]]
    down = _pass(t, s, larger[::-1], -1, memory)
    return np.append(len(t) - 1, down[::-1])  # nothing induces the last character


def suffix_order(t: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """Positions of all suffixes of `t` in order. `t`: integers, the last one less than all others."""
    n = len(t)
    if n < 64:
        words = t.tolist()
        return np.array(sorted(range(n), key=lambda i: words[i:]), np.int64)
    s = _types(t)
    stars = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    order = _induce(t, s, stars, memory)
    is_star = np.zeros(n, bool)
    is_star[stars] = True
    order = order[is_star[order]]
    # names: equal substrings, from a leftmost S to the next one, have equal names
    ends = np.append(stars[1:], n - 1) + 1
    end_of = np.zeros(n, np.int64)
    end_of[stars] = ends
    raw = np.ascontiguousarray(t.astype("<i4")).view(np.uint8)
    hashes = span_hashes(raw, order * 4, end_of[order] * 4)
    names = np.cumsum(np.append(0, hashes[1:] != hashes[:-1]))
    if names[-1] + 1 < len(stars):
        place = np.zeros(n, np.int64)
        place[order] = names
        order = stars[suffix_order(place[stars], memory)]
    return _induce(t, s, order, memory)
