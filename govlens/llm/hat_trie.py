"""A HAT-trie that counts word-id sequences of up to four words.

Keys are rows of four ids, those of shorter sequences filled up with ``NONE``. Inner nodes part
a level's ids into ranges; leaves are hash containers (suffix -> count). A container covers a
range of ids on its level (hybrid) or one id (pure). One that outgrows ``burst`` entries bursts:
a hybrid container is split in two by its ids, a pure one becomes a node on the next level.
When the trie holds more than ``room`` entries, its largest subtrees leave as sorted runs until
half the room is free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LEVELS = 4
NONE = -1  # before all ids, so that a sequence sorts before its extensions
BURST, ROOM = 1 << 16, 3 << 20


def id_type(n_ids: int) -> type:
    return np.int32 if n_ids < 1 << 31 else np.int64


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different key (row) once, with the sum of its counts, by a hash table."""
    if not len(keys):
        return keys, counts
    if keys.dtype == np.int64:  # too many words for two ids in 64 bits
        found = pa.table({**{f"w{i}": keys[:, i] for i in range(LEVELS)}, "n": counts}).group_by(
            [f"w{i}" for i in range(LEVELS)], use_threads=False).aggregate([("n", "sum")])
        return np.stack([found[f"w{i}"].to_numpy() for i in range(LEVELS)], 1), found["n_sum"].to_numpy()
    wide = keys.astype(np.int64)
    table = pa.table({"hi": (wide[:, 0] << 32) | (wide[:, 1] & 0xFFFFFFFF),
                      "lo": (wide[:, 2] << 32) | (wide[:, 3] & 0xFFFFFFFF), "n": counts})
    found = table.group_by(["hi", "lo"], use_threads=False).aggregate([("n", "sum")])
    hi, lo = (found[c].to_numpy() for c in ("hi", "lo"))
    out = np.empty((len(hi), LEVELS), np.int32)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = hi >> 32, hi, lo >> 32, lo
    return out, found["n_sum"].to_numpy()


def in_order(keys: np.ndarray) -> np.ndarray:
    """Places of the keys in ascending order."""
    return np.lexsort(tuple(keys[:, i] for i in reversed(range(LEVELS))))


class Container:
    """A leaf: the sequences whose id on ``level`` is in [lo, hi)."""

    def __init__(self, level: int, lo: int, hi: int):
        self.level, self.lo, self.hi = level, lo, hi
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.merged = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [counted(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
        self.size = self.merged = len(self.parts[0][0]) if self.parts else 0

    def ids(self) -> np.ndarray:
        return self.parts[0][0][:, self.level]


class Node:
    """An inner node: ``children[i]`` has the ids in [starts[i], starts[i + 1]) of ``level``."""

    def __init__(self, level: int, child: Container):
        self.level, self.starts, self.children = level, [child.lo], [child]

    def split(self, i: int, at: int) -> None:
        old = self.children[i]
        halves = Container(self.level, old.lo, at), Container(self.level, at, old.hi)
        keys, counts = old.parts[0]
        for half, mask in zip(halves, (keys[:, self.level] < at, keys[:, self.level] >= at), strict=True):
            half.add(keys[mask], counts[mask])
            half.merged = half.size
        self.children[i:i + 1], self.starts[i:i + 1] = halves, [old.lo, at]


class HatTrie:
    def __init__(self, n_ids: int, burst: int = BURST, room: int = ROOM):
        self.n_ids, self.burst, self.room, self.size = n_ids, burst, room, 0
        self.root = self._node(0)

    def _node(self, level: int) -> Node:
        return Node(level, Container(level, NONE, max(self.n_ids, 1)))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Count the keys; gives the sorted runs that leave the trie for want of room."""
        self._insert(self.root, *counted(keys, counts))
        if self.size > self.room:
            yield from self._spill(self.root, self.room // 2)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All that is left, as sorted runs."""
        yield from self._spill(self.root, 0)

    def _insert(self, node: Node, keys: np.ndarray, counts: np.ndarray) -> None:
        where = np.searchsorted(np.array(node.starts), keys[:, node.level], "right") - 1
        order = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[order], np.arange(len(node.children) + 1))
        for i in range(len(node.children) - 1, -1, -1):  # from the end: a burst adds children behind i
            some = order[ends[i]:ends[i + 1]]
            if len(some):
                self._into(node, i, keys[some], counts[some])

    def _into(self, node: Node, i: int, keys: np.ndarray, counts: np.ndarray) -> None:
        child = node.children[i]
        if isinstance(child, Node):
            return self._insert(child, keys, counts)
        before = child.size
        child.add(keys, counts)
        if child.size > max(self.burst, 2 * child.merged):
            child.merge()
        self.size += child.size - before
        if child.merged > self.burst:
            self._burst(node, i)

    def _burst(self, node: Node, i: int) -> None:
        child = node.children[i]
        if child.merged <= self.burst:
            return
        ids = child.ids()
        low, high = int(ids.min()), int(ids.max())
        if low < high:
            at = int(np.partition(ids, len(ids) // 2)[len(ids) // 2])
            node.split(i, at if at > low else low + 1)
            self._burst(node, i + 1)
            self._burst(node, i)
        elif node.level + 1 < LEVELS and low != NONE:
            if child.lo < low or child.hi > low + 1:  # one id only, though the range is wider
                if child.lo < low:
                    node.split(i, low)
                    i += 1
                if child.hi > low + 1:
                    node.split(i, low + 1)
                child = node.children[i]
            inner = self._node(node.level + 1)
            node.children[i] = inner
            inner.children[0].add(*child.parts[0])
            inner.children[0].merged = child.size
            self._burst(inner, 0)

    def _spill(self, node: Node, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of the largest subtrees below ``node`` until ``left`` entries are left."""
        sizes = np.array([_size(c) for c in node.children])
        for i in np.argsort(-sizes, kind="stable"):
            if self.size <= left:
                return
            leaves = [leaf for leaf in _leaves(node.children[i]) if leaf.size]
            for leaf in leaves:
                leaf.merge()
                keys, counts = leaf.parts[0]
                order = in_order(keys)
                yield keys[order], counts[order]
            self.size -= int(sizes[i])
            first = node.starts[i]
            last = node.starts[i + 1] if i + 1 < len(node.starts) else max(self.n_ids, 1)
            node.children[i] = Container(node.level, first, last)


def _leaves(child: Node | Container) -> Iterator[Container]:
    if isinstance(child, Node):
        for c in child.children:
            yield from _leaves(c)
    else:
        yield child


def _size(child: Node | Container) -> int:
    return sum(leaf.size for leaf in _leaves(child))
