"""BK-trees: integers under Hamming distance, children keyed by their distance to the parent."""

from __future__ import annotations

import numpy as np


class BKTree:
    """Nodes are numbered as added. A search with radius r follows only the edges d - r .. d + r."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            d = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(d, new)

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            low, high = d - radius, d + radius
            for edge, child in children[at].items():
                if low <= edge <= high:
                    todo.append(child)
        return found


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for k in range(a.shape[1]):  # few columns: faster than a sum along them
        out += np.bitwise_count(a[:, k] ^ b[:, k])
    return out


class BKForest:
    """The BK-trees that adding each group's values in order gives, as arrays: all trees are built, and searched, a level at a time.

    group: sorted; values: rows of 64-bit words, distinct in their group. A node is a value's number. As in any BK-tree, values that
    are all at one distance from each other are a chain.
    """

    def __init__(self, group: np.ndarray, values: np.ndarray) -> None:
        self.values, self.edges = values, 64 * values.shape[1] + 1
        head = np.append(True, group[1:] != group[:-1])[: len(group)]
        self.roots = np.flatnonzero(head)
        at = np.repeat(self.roots, np.diff(np.append(self.roots, len(group))))
        waiting, keys, children = np.flatnonzero(~head), [], []
        while len(waiting):
            key = at[waiting] * self.edges + bits_between(values[waiting], values[at[waiting]])
            by = np.argsort(key, kind="stable")
            waiting, key = waiting[by], key[by]
            new = np.append(True, key[1:] != key[:-1])
            keys.append(key[new])
            children.append(waiting[new])
            at[waiting] = waiting[new][np.cumsum(new) - 1]
            waiting = np.sort(waiting[~new])
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        by = np.argsort(key)
        #: Parent and edge of each child, sorted.
        self.keys, self.children = key[by], np.concatenate([np.zeros(0, np.int64), *children])[by]
        self.inner = np.zeros(len(group), bool)
        self.inner[self.keys // self.edges] = True

    def within(self, values: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For values, each in the tree of its root: number of the value, node, distance, of all nodes in the radius. Follows the edges d - radius .. d + radius."""
        asks, nodes = np.arange(len(roots)), roots
        found = [np.zeros((3, 0), np.int64)]
        while len(asks):
            d = bits_between(values[asks], self.values[nodes])
            near = d <= radius
            found.append(np.stack([asks[near], nodes[near], d[near]]))
            on = self.inner[nodes]
            asks, nodes, d = asks[on], nodes[on], d[on]
            low = np.searchsorted(self.keys, nodes * self.edges + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, nodes * self.edges + np.minimum(d + radius, self.edges - 1), side="right")
            sizes = high - low
            nodes = self.children[np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            asks = np.repeat(asks, sizes)
        return tuple(np.concatenate(found, axis=1))
