"""Suffix trees over numbered words, and longest common extensions from them in constant time.

The tree is built from left to right by Ukkonen's algorithm, in time linear in the text. A walk around it meets
the leaves in the order of their suffixes and, between two neighbouring leaves, the node where their paths part.
The longest common extension of two suffixes is the depth of their lowest common ancestor: the least of the
depths met between their leaves on that walk, which a table of minima over powers of two gives at once.
"""

from __future__ import annotations

import numpy as np

END = 0  # closes the text; smaller than any word, which are numbered from 1


class SuffixTree:
    """Suffix tree of a text of positive numbers. Inner nodes are 0 (the root) and up, the leaf of suffix k is ~k."""

    def __init__(self, text: np.ndarray):
        self.text = [*text.tolist(), END]
        self.symbols = max(self.text) + 1
        self.begin = [0]  # by inner node: the place in the text where the edge into it begins, and where it ends
        self.end = [0]
        self.leaf_begin = [0] * len(self.text)
        self.child: dict[int, int] = {}  # node * symbols + first symbol of the edge -> node below
        self._grow()

    def _grow(self) -> None:
        text, symbols, child = self.text, self.symbols, self.child
        begin, end, leaf_begin = self.begin, self.end, self.leaf_begin
        link = [0]
        node = along = length = suffix = 0  # the active point: ``length`` symbols from ``along`` on, below ``node``
        for place, symbol in enumerate(text):
            unlinked = 0
            while suffix <= place:
                if not length:
                    along = place
                key = node * symbols + text[along]
                below = child.get(key)
                if below is None:
                    child[key] = ~suffix
                    leaf_begin[suffix] = place
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    if below >= 0:
                        first = begin[below]
                        size = end[below] - first
                        if length >= size:
                            node = below
                            along += size
                            length -= size
                            continue
                    else:
                        first = leaf_begin[~below]
                    at = first + length
                    if text[at] == symbol:
                        if unlinked:
                            link[unlinked] = node
                        length += 1
                        break
                    fresh = len(begin)
                    begin.append(first)
                    end.append(at)
                    link.append(0)
                    child[key] = fresh
                    child[fresh * symbols + symbol] = ~suffix
                    leaf_begin[suffix] = place
                    child[fresh * symbols + text[at]] = below
                    if below >= 0:
                        begin[below] = at
                    else:
                        leaf_begin[~below] = at
                    if unlinked:
                        link[unlinked] = fresh
                    unlinked = fresh
                suffix += 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    along = suffix

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in their order, and the depth at which each parts from the one before it (0 for the first)."""
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        nodes = np.fromiter(self.child.values(), np.int64, len(self.child))
        order = np.argsort(-keys)  # the stack gives a node's children back in rising order
        nodes = nodes[order].tolist()
        bound = np.searchsorted(-(keys[order] // self.symbols), -np.arange(len(self.begin) + 1), "right").tolist()
        begin, end = self.begin, self.end
        leaves, parted = [], []
        stack, depths = [0], [0]
        fresh, parting = True, 0
        while stack:
            node, depth = stack.pop(), depths.pop()
            if fresh:  # the first step after a leaf: its parent is where the two paths part
                parting, fresh = depth, False
            if node < 0:
                leaves.append(~node)
                parted.append(parting)
                fresh = True
            else:
                depth += end[node] - begin[node]
                below = nodes[bound[node + 1] : bound[node]]
                stack += below
                depths += [depth] * len(below)
        return np.array(leaves, np.int64), np.array(parted, np.int64)


class CommonExtensions:
    """How many symbols two suffixes of a text have in common, for arrays of pairs."""

    def __init__(self, text: np.ndarray):
        leaves, parted = SuffixTree(text).walk()
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.least = [parted.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(leaves):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes from ``a[k]`` and ``b[k]``; the two differ."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(power).tolist():
            at = np.flatnonzero(power == k)
            row = self.least[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out
