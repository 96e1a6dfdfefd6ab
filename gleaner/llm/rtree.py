"""R-tree over count vectors: points are documents, coordinates the numbers of
their shingles in each of `FINE` hash groups, in the tree those of `GROUPS` groups,
which are sums of them. The overlap of two documents is at most the sum of the
smaller coordinates, and that of a document with any point of a box at most the
sum with the box's upper corner, so whole boxes are left out. Points that the tree
finds are held against the fine groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUPS, FINE = 64, 512


def count_vector(hashes: np.ndarray) -> bytes:
    """Counts of the fine groups, in the smallest of three widths that holds them."""
    counts = np.bincount((hashes >> np.uint64(40)) % np.uint64(FINE), minlength=FINE)
    top = counts.max()
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def vector_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // FINE}").astype(np.int32)


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of vectors of any of the three widths."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :]) if column.type == pa.binary() else np.array([len(x) for x in column])
    if (sizes == FINE).all():
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FINE)
    return np.stack([vector_of(x) for x in column.to_pylist()])


def least_overlap(a, b):
    """Smallest intersection with 100 * intersection >= 80 * union, for sets of sizes a and b."""
    return -(-4 * (a + b) // 9)


class Points:
    """Fine counts and sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.whole, self.sizes = vectors, sizes.astype(np.int64)

    def fine(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that the fine counts can't rule out."""
        if not len(i):
            return i, j
        kept = np.concatenate([
            np.minimum(self.whole[i[k : k + 1024]], self.whole[j[k : k + 1024]]).sum(axis=1, dtype=np.int64) >= least_overlap(self.sizes[i[k : k + 1024]], self.sizes[j[k : k + 1024]])
            for k in range(0, len(i), 1024)
        ])
        return i[kept], j[kept]


class CountTree(Points):
    PAGE = 64

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        """`vectors`: fine counts. Pages are packed by size, inside wider slabs by
        the two coordinates that vary most; each has a box."""
        super().__init__(vectors, sizes)
        coarse = vectors.reshape(len(vectors), FINE // GROUPS, GROUPS).sum(axis=1, dtype=np.int32)
        order = np.argsort(self.sizes, kind="stable")
        wide = np.argsort(-coarse.var(axis=0))[:2]
        slab = self.PAGE * 8
        for lo in range(0, len(order), slab):
            part = order[lo : lo + slab]
            order[lo : lo + slab] = part[np.lexsort((coarse[part, wide[1]], coarse[part, wide[0]]))]
        self.order, self.coarse = order, coarse[order]
        cuts = np.arange(0, len(order), self.PAGE)
        s = self.sizes[order]
        # two levels of boxes: upper corners, least and largest sizes
        self.leaves = (np.maximum.reduceat(self.coarse, cuts), np.minimum.reduceat(s, cuts), np.maximum.reduceat(s, cuts))
        above = np.arange(0, len(cuts), 8)
        top, low, high = self.leaves
        self.nodes = (np.maximum.reduceat(top, above), np.minimum.reduceat(low, above), np.maximum.reduceat(high, above))

    @staticmethod
    def _meet(boxes: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which boxes i and j may hold a pair that links."""
        top, low, high = boxes
        fits = (4 * low[i] <= 5 * high[j]) & (4 * low[j] <= 5 * high[i])
        bound = np.minimum(top[i], top[j]).sum(axis=1)
        return fits & (bound >= least_overlap(low[i], low[j]))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points that the boxes and their coarse counts can't rule out,
        some at a time: the tree is joined with itself, level by level."""
        i, j = np.triu_indices(len(self.nodes[0]))
        met = self._meet(self.nodes, i, j)
        for x, y in zip(i[met].tolist(), j[met].tolist(), strict=True):
            a, b = (np.arange(8 * k, min(8 * k + 8, len(self.leaves[0]))) for k in (x, y))
            a, b = (m.ravel() for m in np.meshgrid(a, b, indexing="ij"))
            a, b = a[a <= b], b[a <= b]
            met = self._meet(self.leaves, a, b)
            for p, q in zip(a[met].tolist(), b[met].tolist(), strict=True):
                yield self._points(p, q)

    def _points(self, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        own, other = (slice(k * self.PAGE, (k + 1) * self.PAGE) for k in (p, q))
        s, t = self.sizes[self.order[own]][:, None], self.sizes[self.order[other]]
        bound = np.minimum(self.coarse[own][:, None], self.coarse[other]).sum(axis=2)
        fits = (4 * s <= 5 * t) & (4 * t <= 5 * s) & (bound >= least_overlap(s, t))
        i, j = np.nonzero(np.triu(fits, 1) if p == q else fits)
        return self.order[own][i], self.order[other][j]


def forest_pairs(vectors: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> Iterator[tuple[Points, np.ndarray, np.ndarray]]:
    """Pairs of many trees, which begin at `heads`. Trees of one page at most have
    no boxes to tell apart; those of a size are taken together."""
    everything = Points(vectors, sizes)
    counts = np.diff(np.append(heads, len(sizes)))
    coarse = vectors.reshape(len(vectors), FINE // GROUPS, GROUPS).sum(axis=1, dtype=np.int32)
    for n in np.unique(counts).tolist():
        own = heads[counts == n]
        if n > CountTree.PAGE:
            for head in own.tolist():
                for i, j in CountTree(vectors[head : head + n], sizes[head : head + n]).pairs():
                    yield everything, head + i, head + j
        elif n > 1:
            i, j = np.triu_indices(n, 1)
            step = max(1, 20000 // len(i))
            for k in range(0, len(own), step):
                x, y = ((own[k : k + step, None] + m).ravel() for m in (i, j))
                s, t = everything.sizes[x], everything.sizes[y]
                fits = np.flatnonzero((4 * s <= 5 * t) & (4 * t <= 5 * s))
                x, y = x[fits], y[fits]
                bound = np.minimum(coarse[x], coarse[y]).sum(axis=1)
                met = bound >= least_overlap(s[fits], t[fits])
                yield everything, x[met], y[met]
