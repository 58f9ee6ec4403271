"""Deep-shallow sorting of byte strings of one length (suffixes cut at the depth that matters).

Shallow: multikey quicksort by super-characters of 8 bytes. A partition is split in three by a pivot; its
equal part goes on to the next super-character, to a shallow depth. All partitions that are open are split
in one sweep. Deep: what is still tied has a long common prefix and is ordered by a blind trie, which
compares a string in full with one other only.
"""

from __future__ import annotations

import numpy as np


class _Leaf:
    __slots__ = ("rows",)

    def __init__(self, row: int):
        self.rows = [row]


class _Branch:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def common_prefix(a: bytes, b: bytes) -> int:
    """Of two strings of one length."""
    return len(a) - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def blind_trie_order(rows: list[bytes]) -> list[int]:
    """Row numbers in the order of their strings, equal strings by number."""
    root: _Leaf | _Branch | None = None
    for i, s in enumerate(rows):
        if root is None:
            root = _Leaf(i)
            continue
        node = root
        while type(node) is _Branch:  # blindly: bytes between the branches are not looked at
            child = node.children.get(s[node.depth])
            node = next(iter(node.children.values())) if child is None else child
        t = rows[node.rows[0]]
        if s == t:
            node.rows.append(i)
            continue
        depth = common_prefix(s, t)
        parent, node = None, root
        while type(node) is _Branch and node.depth < depth:
            parent, node = node, node.children[s[node.depth]]
        if type(node) is _Branch and node.depth == depth:
            node.children[s[depth]] = _Leaf(i)
            continue
        branch = _Branch(depth, {s[depth]: _Leaf(i), t[depth]: node})
        if parent is None:
            root = branch
        else:
            parent.children[s[parent.depth]] = branch
    out: list[int] = []
    stack = [root] if root is not None else []
    while stack:
        node = stack.pop()
        if type(node) is _Leaf:
            out += node.rows
        else:
            stack += [node.children[c] for c in sorted(node.children, reverse=True)]
    return out


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range, one after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - before, size)


def multikey_quicksort(words: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by their first ``levels`` super-characters, and (begin, size) of what these leave tied."""
    order = np.arange(len(words))
    begin, size, level = np.array([0]), np.array([len(words)]), np.array([0])
    tied_begin, tied_size = [begin[:0]], [begin[:0]]
    while len(begin):
        at = ranges(begin, size)
        rows, part = order[at], np.repeat(np.arange(len(begin)), size)
        key = words[rows, level[part]]
        first = np.cumsum(size) - size
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]  # the median of three
        sides = (key < pivot, key == pivot, key > pivot)
        sizes = np.stack([np.add.reduceat(own, first, dtype=np.int64) for own in sides], 1)
        starts = begin[:, None] + np.cumsum(sizes, 1) - sizes
        for k, own in enumerate(sides):
            seen = np.cumsum(own)
            rank = seen - 1 - (seen - own)[first][part]
            order[starts[part[own], k] + rank[own]] = rows[own]
        deeper = level + 1
        done = (deeper == levels) & (sizes[:, 1] > 1)
        tied_begin.append(starts[done, 1])
        tied_size.append(sizes[done, 1])
        again = sizes > 1
        again[:, 1] &= deeper < levels
        level = np.stack([level, deeper, level], 1)[again]
        begin, size = starts[again], sizes[again]
    begin, size = np.concatenate(tied_begin), np.concatenate(tied_size)
    turn = np.argsort(begin)
    return order, begin[turn], size[turn]


def deep_shallow_order(strings: np.ndarray, shallow: int = 24) -> np.ndarray:
    """Order of the rows of a uint8 matrix; ``shallow`` bytes are sorted by super-characters."""
    n, length = strings.shape
    if n < 2 or not length:
        return np.arange(n)
    levels = max(1, min(-(-length // 8), shallow // 8))
    depth = min(length, levels * 8)
    padded = np.zeros((n, levels * 8), np.uint8)
    padded[:, :depth] = strings[:, :depth]
    order, begin, size = multikey_quicksort(padded.view(">u8").astype(np.uint64), levels)
    if len(begin) and depth < length:
        # Groups of equal strings are in order as they are.
        at, part = ranges(begin, size), np.repeat(np.arange(len(begin)), size)
        differs = np.zeros(len(at), bool)
        for a in range(0, len(at), 65536):
            b = slice(a, a + 65536)
            differs[b] = (strings[order[at[b]], depth:] != strings[order[begin[part[b]]], depth:]).any(1)
        for k in np.unique(part[differs]):
            rows = order[begin[k] : begin[k] + size[k]]
            tails = np.ascontiguousarray(strings[rows, depth:])
            whole, step = tails.tobytes(), tails.shape[1]
            order[begin[k] : begin[k] + size[k]] = rows[blind_trie_order([whole[i : i + step] for i in range(0, len(whole), step)])]
    return order


def neighbour_prefixes(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row in the order and the one before it (the first: -1)."""
    out = np.full(len(order), -1, np.int64)
    for begin in range(1, len(order), 65536):
        rows = strings[order[begin - 1 : begin + 65536]]
        same = rows[1:] == rows[:-1]
        out[begin : begin + 65536] = np.where(same.all(1), strings.shape[1], same.argmin(1))
    return out


def prefix_names(strings: np.ndarray, depths: list[int], shallow: int = 24) -> dict[int, np.ndarray]:
    """For each depth, a number of every row that rows with the same prefix of that length share."""
    order = deep_shallow_order(strings, shallow)
    prefixes = neighbour_prefixes(strings, order)
    out = {}
    for depth in depths:
        names = np.zeros(len(order), np.int64)
        names[order] = np.cumsum(prefixes < depth)
        out[depth] = names
    return out
