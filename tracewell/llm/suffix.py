"""Order and common prefixes of suffixes by deep-shallow sorting.

Suffixes are first sorted by multikey quicksort, eight bytes at a time, to a shallow
depth.  Groups that still agree there share long prefixes, where comparing from the start
again and again is dear; a blind trie orders each: it branches on single bytes, so a
suffix walks down without comparing and is compared once, with the leaf it reaches.
"""

from __future__ import annotations

import numpy as np

WORD = 8
SHALLOW = 16 * WORD


def padded(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of ``width`` bytes, shorter strings filled up with zero bytes."""
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of ``words`` within groups of equal ``group`` (which must be together).

    All open segments are split in three about their middle row's word in each round; the
    equal part goes on with the next word.  Returns the order, and the numbers of the
    segments, which hold more than one row only where rows agree in all words.
    """
    n, depth_of_all = words.shape
    order = np.arange(n)
    segment = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
    depth = np.zeros(n, np.int64)  # of the segment at each place
    while True:
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sizes = np.diff(np.append(starts, n))
        open_at = np.repeat(sizes > 1, sizes) & (depth < depth_of_all)
        at = np.flatnonzero(open_at)
        if not len(at):
            return order, segment
        middle = np.repeat(starts + sizes // 2, sizes)[at]
        word = words[order[at], depth[at]]
        pivot = words[order[middle], depth[at]]
        side = (word > pivot).astype(np.int64) + (word >= pivot)
        key = segment[at] * 3 + side
        moved = np.argsort(key, kind="stable")
        order[at] = order[at][moved]
        depth[at] += (side == 1)[moved]
        split = segment * 3
        split[at] = key[moved]
        segment = np.cumsum(np.concatenate([[True], split[1:] != split[:-1]])) - 1


def common_prefix(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class BlindTrie:
    """Inner nodes hold a depth and children by the byte there; leaves hold equal strings."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, string: bytes, name: int) -> None:
        if self.root is None:
            self.root = [len(string), string, [name]]
            return
        node = self.root
        while isinstance(node[1], dict):  # blindly: any leaf below tells the common prefix
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        shared = common_prefix(string, node[1])
        if shared == len(string):
            node[2].append(name)
            return
        parent, node, other = None, self.root, node[1]
        while isinstance(node[1], dict) and node[0] < shared:
            parent, node = node, node[1][string[node[0]]]
        leaf = [len(string), string, [name]]
        if isinstance(node[1], dict) and node[0] == shared:
            node[1][string[shared]] = leaf
            return
        new = [shared, {string[shared]: leaf, other[shared]: node}, None]
        if parent is None:
            self.root = new
        else:
            parent[1][string[parent[0]]] = new

    def in_order(self) -> tuple[list[int], list[int]]:
        """Names in order, and each one's common prefix with the one before (first: 0)."""
        names, shared, stack = [], [], [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if isinstance(node[1], dict):
                first, *rest = sorted(node[1])
                stack.extend((node[1][c], node[0]) for c in reversed(rest))
                stack.append((node[1][first], before))
            else:
                names += node[2]
                shared += [before] + [node[0]] * (len(node[2]) - 1)
        return names, shared


def deep_shallow_sort(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings`` within groups, and the bytes each shares with the one before.

    Strings count as filled up with zero bytes to ``width``.  The first of a group shares 0.
    """
    n = len(strings)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = -(-width // WORD) * WORD
    rows = padded(strings, wide)
    shallow = min(SHALLOW, wide)
    words = rows[:, :shallow].copy().view(">u8").astype(np.uint64)
    order, segment = multikey_quicksort(words, group)
    a, b = rows[order[:-1], :shallow], rows[order[1:], :shallow]
    differ = a != b
    shared = np.zeros(n, np.int64)
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), shallow)
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sizes = np.diff(np.append(starts, n))
    if wide > shallow:
        for k in np.flatnonzero(sizes > 1):
            at = slice(starts[k], starts[k] + sizes[k])
            trie = BlindTrie()
            for name in order[at]:
                trie.insert(rows[name, shallow:].tobytes(), int(name))
            names, below = trie.in_order()
            order[at] = names
            shared[starts[k] + 1 : starts[k] + sizes[k]] = shallow + np.array(below[1:])
    shared[0] = 0
    shared[1:][group[order[1:]] != group[order[:-1]]] = 0
    return order, np.minimum(shared, width)
