"""BK-trees over 64-bit fingerprints: children hang on integer Hamming distances to their parent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of an asking fingerprint and a held one that are looked at together at most, about.
AT_ONCE = 1 << 19
_EDGES = 65


class Forest:
    """One BK-tree for each group of different fingerprints, all of them built level by level.

    Every fingerprint is a node. The first of those that wait at an edge becomes its node, the others wait at the
    edge of their distance to it. Nodes are numbered by parent and distance, so that the children of a node at a
    range of distances are a range of numbers.
    """

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        self.prints, self.visited, self.depth = prints, 0, 0
        self.group = np.unique(group, return_inverse=True)[1].astype(np.int64)
        waiting = np.argsort(self.group, kind="stable")
        key = self.group[waiting]
        at, edges, base = [], [], 0
        while len(waiting):
            first = np.r_[True, key[1:] != key[:-1]]
            if base:
                edges.append(key[first])
            node = base + np.cumsum(first) - 1
            pivots = waiting[first]
            at.append(pivots)
            rest, node = waiting[~first], node[~first]
            key = node * _EDGES + np.bitwise_count(prints[rest] ^ prints[pivots[node - base]])
            order = np.argsort(key, kind="stable")
            waiting, key, base = rest[order], key[order], base + len(pivots)
            self.depth += 1
        self.at = np.concatenate(at) if at else np.empty(0, np.int64)
        roots = len(at[0]) if at else 0
        held = np.bincount(np.concatenate(edges), minlength=base * _EDGES) if edges else np.zeros(base * _EDGES, np.int64)
        self._child = (roots + np.r_[0, np.cumsum(held)]).astype(np.int32)

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asked, held) positions of the pairs within the radius, each fingerprint asking its group's tree.

        Only edges whose distance differs from the asking one's by no more than the radius are followed: by the
        triangle inequality the others hold nothing within it. Every pair comes once, the lower position first.
        """
        size = np.bincount(self.group)[self.group] if len(self.group) else self.group
        cuts = np.searchsorted(np.cumsum(size), np.arange(AT_ONCE, int(size.sum()) + AT_ONCE, AT_ONCE), side="left") + 1
        held = self.prints[self.at]
        start = 0
        for stop in np.unique(np.minimum(cuts, len(size))).tolist():
            asks = np.arange(start, stop)
            node, start = self.group[asks], stop
            while len(asks):
                self.visited += len(asks)
                away = np.bitwise_count(self.prints[asks] ^ held[node]).astype(np.int64)
                found = self.at[node]
                hit = (away <= radius) & (asks < found)
                if hit.any():
                    yield asks[hit], found[hit]
                first = self._child[node * _EDGES + np.maximum(away - radius, 0)].astype(np.int64)
                n = self._child[node * _EDGES + np.minimum(away + radius, _EDGES - 1) + 1] - first
                total = np.cumsum(n)
                node = np.repeat(first - (total - n), n) + np.arange(total[-1])
                asks = np.repeat(asks, n)


class Union:
    """Labels of positions that pairs join; the label of a class is its least position."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            other = x != y
            if not other.any():
                return
            a, b, x, y = a[other], b[other], x[other], y[other]
            up = np.arange(len(self.label))
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while (up[up] != up).any():
                up = up[up]
            self.label = up[self.label]

    def chain(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges that hold each class together, as a path: no position has more than two."""
        order = np.argsort(self.label, kind="stable")
        same = self.label[order][1:] == self.label[order][:-1]
        return order[:-1][same], order[1:][same]
