"""Cutting feature space into cells, so that a query is sent only to the cells that can hold its neighbours.

Every large stratum has a tree of its own, cut along its own samples; the trees of all strata are one table of nodes, and
a cell is a leaf, so its number tells its stratum too. A leaf that turns out to hold too many rows is cut again from a
sample of its own rows. The cuts decide how the work is spread, never what the result is: a query visits every leaf of its
tree whose region is no farther away than its k-th nearest sample row, which is itself a training row.
"""

from __future__ import annotations

import numpy as np

from nearspark.operators.kernel import squared_sum


class Forest:
    """Binary trees as one table of nodes: a row with ``x[axis] > cut`` goes to ``left + 1``, else to ``left``.

    Node i is the root of tree i, for as many trees as there are; a leaf has axis -1.
    """

    def __init__(self, trees: int):
        self.trees = trees
        self.axis, self.cut, self.left = np.full(trees, -1), np.full(trees, np.inf), np.full(trees, -1)

    def grow(self, leaves: dict[int, np.ndarray], leaf_rows: int) -> int:
        """Halve each leaf's sample rows along their widest axis until at most ``leaf_rows`` are left; return the cuts made.

        Rows that are all equal can't be cut.
        """
        axis, cut, left = self.axis.tolist(), self.cut.tolist(), self.left.tolist()
        pending = list(leaves.items())
        before = len(axis)
        while pending:
            node, rows = pending.pop()
            if len(rows) <= leaf_rows:
                continue
            widest = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            values = rows[:, widest]
            at = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
            if at == values.max():
                lower = values[values < at]
                if not len(lower):
                    continue
                at = lower.max()
            axis[node], cut[node], left[node] = widest, float(at), len(axis)
            pending += [(len(axis), rows[values <= at]), (len(axis) + 1, rows[values > at])]
            axis += [-1, -1]
            cut += [np.inf, np.inf]
            left += [-1, -1]
        self.axis, self.cut, self.left = np.array(axis), np.array(cut), np.array(left)
        return (len(axis) - before) // 2

    def leaf_of(self, roots: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in the tree of its root; rows without a tree (a negative root) keep that number."""
        node = roots.astype(np.int64)
        going = np.flatnonzero(node >= 0)
        while len(going := going[self.axis[node[going]] >= 0]):
            at = node[going]
            node[going] = self.left[at] + (x[going, self.axis[at]] > self.cut[at])
        return node

    def regions(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corner of the region of every node."""
        lo, hi = np.full((len(self.axis), dims), -np.inf), np.full((len(self.axis), dims), np.inf)
        node = np.arange(self.trees)
        while len(node := node[self.axis[node] >= 0]):
            left, axis, cut = self.left[node], self.axis[node], self.cut[node]
            for child in (left, left + 1):
                lo[child], hi[child] = lo[node], hi[node]
            hi[left, axis] = np.minimum(hi[left, axis], cut)
            lo[left + 1, axis] = np.maximum(lo[left + 1, axis], cut)
            node = np.concatenate([left, left + 1])
        return lo, hi

    def leaves_within(self, roots, x, within, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf) of the row's tree whose region is at squared distance <= ``within`` of the row."""
        rows, node = np.arange(len(x)), roots.astype(np.int64)
        found = [(rows[node < 0], node[node < 0])]
        rows, node = rows[node >= 0], node[node >= 0]
        while len(rows):
            inner = self.axis[node] >= 0
            found.append((rows[~inner], node[~inner]))
            rows, node = np.repeat(rows[inner], 2), np.repeat(self.left[node[inner]], 2)
            node[1::2] += 1
            gap = np.maximum(np.maximum(lo[node] - x[rows], x[rows] - hi[node]), 0.0)
            near = squared_sum(gap) <= within[rows]
            rows, node = rows[near], node[near]
        return tuple(np.concatenate(part) for part in zip(*found))

    def leaves_of(self, tree: int) -> int:
        """Number of leaves of one tree."""
        node, count = np.array([tree]), 0
        while len(node):
            inner = node[self.axis[node] >= 0]
            count += len(node) - len(inner)
            node = np.concatenate([self.left[inner], self.left[inner] + 1])
        return count


def lowest_copies(x: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the rows that are among the ``keep`` lowest ids of their vector (or of a part of its copies)."""
    mark = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        # a negative zero equals zero, so it must not differ in its bits: equal vectors would stand in two orders of ids
        mark = mark * np.uint64(0x9E3779B97F4A7C15) + (x[:, j] + 0.0).view(np.uint64)
    order = np.lexsort((ids, mark))
    new = np.append(True, (x[order[1:]] != x[order[:-1]]).any(axis=1))[: len(x)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return order[np.arange(len(x)) - first < keep]
