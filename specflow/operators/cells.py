"""A tree that cuts points into cells of about equal size, learned from a sample, and boxes around cells."""

from __future__ import annotations

import numpy as np


class Cells:
    """Each inner node asks whether one coordinate, that of most variance, is above a limit near its median."""

    def __init__(self, points: np.ndarray, cells: int):
        self.column, self.limit, self.child = [], [], []
        leaves, queue = 1, [(self._node(), np.arange(len(points)))]
        while queue and leaves < cells:
            node, rows = queue.pop(0)
            if len(rows) < 2:
                continue
            column = int(points[rows].var(0).argmax())
            values = points[rows, column]
            if values.min() == values.max():
                continue
            limit = np.median(values)
            if limit == values.max():
                limit = values[values < limit].max()
            below = values <= limit
            self.column[node], self.limit[node], self.child[node] = column, limit, (self._node(), self._node())
            leaves += 1
            queue += [(self.child[node][0], rows[below]), (self.child[node][1], rows[~below])]

    def _node(self) -> int:
        self.column.append(-1)
        self.limit.append(0)
        self.child.append((0, 0))
        return len(self.column) - 1

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        column, limit, child = np.array(self.column), np.array(self.limit), np.array(self.child)
        node = np.zeros(len(points), np.int64)
        while (inner := np.nonzero(column[node] >= 0)[0]).size:
            at = node[inner]
            node[inner] = child[at, (points[inner, column[at]] > limit[at]).astype(np.int64)]
        return node
