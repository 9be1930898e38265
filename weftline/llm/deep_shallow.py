"""Deep-shallow sorting of byte strings (Manzini and Ferragina, 2004).

Strings are parts of one buffer, given by where they start.  Multikey quicksort orders them to a
shallow depth: buckets are split three ways around a pivot, the equal ones go on with the next
characters.  A character here is eight bytes, and all open buckets are split at once.  What is still
together at the shallow depth has a long common prefix; a blind trie (branching places and bytes
only) orders the rest of such a group with one comparison of whole strings for each insertion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes ordered by multikey quicksort; a multiple of the eight that it takes at once.
SHALLOW = 64
STEP = 8


class BlindTrie:
    """Strings of one length by the places where they branch.  A leaf is [string, members], an
    inner node (place, {byte: node})."""

    def __init__(self) -> None:
        self.root: list | tuple | None = None

    def insert(self, text: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = [text, [member]]
            return
        while type(node) is tuple:
            place, children = node
            node = children.get(text[place]) or next(iter(children.values()))
        if node[0] == text:
            node[1].append(member)
            return
        gap = int.from_bytes(text, "big") ^ int.from_bytes(node[0], "big")
        differ, other = len(text) - (gap.bit_length() + 7) // 8, node[0]
        above, node = None, self.root
        while type(node) is tuple and node[0] < differ:
            above, node = node, node[1][text[node[0]]]
        leaf = [text, [member]]
        if type(node) is tuple and node[0] == differ:
            node[1][text[differ]] = leaf
            return
        branch = (differ, {other[differ]: node, text[differ]: leaf})
        if above is None:
            self.root = branch
        else:
            above[1][text[above[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """The members of each distinct string, in the strings' order."""
        open_ = [self.root] if self.root is not None else []
        while open_:
            node = open_.pop()
            if type(node) is tuple:
                open_.extend(child for _, child in sorted(node[1].items(), reverse=True))
            else:
                yield node[1]


def words_of(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, first byte highest; zeros follow the end."""
    padded = np.concatenate([buffer, np.zeros(STEP, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(buffer), np.uint64)
    for i in range(STEP):
        words = (words << np.uint64(8)) | padded[i : i + len(buffer)]
    return words


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders every bucket (``sizes`` of successive strings) by its strings' first ``depth`` bytes.

    The order, and the first and last place of each group that is equal to that depth.
    """
    order = np.arange(len(starts))
    end = np.cumsum(sizes)
    begin = end - sizes
    at_depth = np.zeros(len(sizes), np.int64)
    deep: list[np.ndarray] = []
    while True:
        alone, done = end - begin < 2, at_depth >= depth
        deep.append(np.stack([begin[done & ~alone], end[done & ~alone]], axis=1))
        open_ = ~alone & ~done
        begin, end, at_depth = begin[open_], end[open_], at_depth[open_]
        if not len(begin):
            return order, np.concatenate(deep)
        size = end - begin
        first = np.cumsum(size) - size
        bucket = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(bucket)) + (begin - first)[bucket]
        item = order[place]
        key = words[starts[item] + at_depth[bucket]]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[bucket]
        less, more = key < pivot, key > pivot
        n_less, n_more = np.add.reduceat(less.astype(np.int64), first), np.add.reduceat(more.astype(np.int64), first)
        n_same = size - n_less - n_more
        # A stable split: the rank among the bucket's strings on the same side of the pivot.
        kind = np.where(less, 0, np.where(more, 2, 1))
        target = np.empty(len(item), np.int64)
        for side, offset in ((0, begin), (1, begin + n_less), (2, begin + n_less + n_same)):
            here = np.flatnonzero(kind == side)
            own = bucket[here]
            rank = np.arange(len(here)) - np.searchsorted(own, np.arange(len(size)))[own]
            target[here] = offset[own] + rank
        order[target] = item
        begin, end, at_depth = (
            np.concatenate([begin, begin + n_less, end - n_more]),
            np.concatenate([begin + n_less, end - n_more, end]),
            np.concatenate([at_depth, at_depth + STEP, at_depth]),
        )


def deep_shallow_sort(
    buffer: bytes, words: np.ndarray, starts: np.ndarray, length: int, sizes: np.ndarray, shallow: int = SHALLOW
) -> tuple[np.ndarray, np.ndarray]:
    """Orders strings of ``length`` bytes that start at ``starts`` of ``buffer``, whose ``words_of`` are given.

    ``sizes`` gives buckets of successive strings that are ordered each by itself.  Returns the
    order and, for each place in it, the number of its class: equal strings of a bucket share one.
    """
    shallow = min(shallow, length // STEP * STEP)
    order, deep = multikey_quicksort(words, starts, sizes, shallow)
    is_first = np.ones(len(order), dtype=bool)
    for begin, end in deep.tolist():
        trie = BlindTrie()
        for member in order[begin:end].tolist():
            start = int(starts[member])
            trie.insert(buffer[start + shallow : start + length], member)
        at = begin
        for members in trie.leaves():
            order[at : at + len(members)] = members
            is_first[at + 1 : at + len(members)] = False
            at += len(members)
    return order, np.cumsum(is_first) - 1
