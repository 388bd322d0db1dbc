"""Deep-shallow sorting of byte strings held as rows of a matrix.

Shallow: a breadth-first multikey quicksort on 8-byte keys; each round splits every open
group in less, equal and greater than its pivot key, and the equal part moves one key
deeper. Groups still together at the shallow depth share a long prefix; blind tries order
them: a trie that stores only skip depths and branch bytes is searched without comparing
text, then one comparison with the leaf found gives the place of the new string.
"""

from __future__ import annotations

import numpy as np


def _keys(rows: np.ndarray, words: int) -> np.ndarray:
    pad = words * 8 - rows.shape[1]
    wide = np.pad(rows, ((0, 0), (0, max(0, pad))))[:, : words * 8]
    return np.ascontiguousarray(wide).view(">u8").astype(np.uint64)


def _shallow(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their keys, and the group number of each place in that order."""
    n, words = keys.shape
    order, group, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while n:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, n])
        size = np.repeat(sizes, sizes)
        open_ = (size > 1) & (depth < words)
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        pivot = np.repeat(order[starts + sizes // 2], sizes)[at]
        mine, theirs = keys[order[at], depth[at]], keys[pivot, depth[at]]
        side = np.where(mine < theirs, 0, np.where(mine == theirs, 1, 2))
        g = group[at]
        inner = np.argsort(g * 3 + side, kind="stable")  # open groups stay in their places
        order[at] = order[at][inner]
        side, g, d = side[inner], g[inner], depth[at][inner]
        depth[at] = d + (side == 1)
        split = np.zeros(n, np.int64)
        split[at] = side
        fresh = group * 3 + split
        group = np.cumsum(np.r_[0, fresh[1:] != fresh[:-1]])
    return order, group


class BlindTrie:
    """Orders strings that may share long prefixes; equal strings keep their order of arrival."""

    __slots__ = ("root", "text")

    def __init__(self, text: list[bytes]):
        self.text, self.root = text, None

    def insert(self, i: int) -> None:
        # node: [skip depth, {branch byte or -1: node}]; leaf: list of string numbers as a tuple
        if self.root is None:
            self.root = [i]
            return
        s, node = self.text[i], self.root
        while isinstance(node, tuple):
            skip, kids = node
            node = kids.get(s[skip] if skip < len(s) else -1) or next(iter(kids.values()))
        other = self.text[node[0]]
        m = min(len(s), len(other))
        if s == other:
            node.append(i)
            return
        if s[:m] == other[:m]:
            lcp = m
        else:
            x = int.from_bytes(s[:m], "big") ^ int.from_bytes(other[:m], "big")
            lcp = m - (x.bit_length() + 7) // 8
        mine = s[lcp] if lcp < len(s) else -1
        parent, branch, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < lcp:
            parent, branch = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][branch]
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][mine] = [i]
            return
        theirs = other[lcp] if lcp < len(other) else -1
        fresh = (lcp, {mine: [i], theirs: node})
        if parent is None:
            self.root = fresh
        else:
            parent[1][branch] = fresh

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow_sort(rows: np.ndarray, lengths: np.ndarray, shallow_words: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings rows[i, :lengths[i]] (bytes past the end must be 0), and the common
    prefix length of each with the one before it in that order (0 for the first)."""
    n = len(rows)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, group = _shallow(_keys(rows, shallow_words))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    for a, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        members = order[a : a + size]
        trie = BlindTrie([rows[i, : lengths[i]].tobytes() for i in members])
        for k in range(size):
            trie.insert(k)
        order[a : a + size] = members[trie.ordered()]
    lcp = np.zeros(n, np.int64)
    for at in range(1, n, 65536):  # bounded scratch
        up, lo = order[at - 1 : min(n, at + 65536) - 1], order[at : at + 65536]
        diff = rows[up] != rows[lo]
        first = np.where(diff.any(axis=1), diff.argmax(axis=1), rows.shape[1])
        lcp[at : at + len(lo)] = np.minimum(first, np.minimum(lengths[up], lengths[lo]))
    return order, lcp
