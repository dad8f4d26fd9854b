"""Deep-shallow sorting of fixed-width strings.

A multikey quicksort orders the strings by eight-byte characters down to a shallow depth, all
open groups at a time.  Groups that are still equal there have long common prefixes; a blind
trie, which keeps branching bytes only, orders each of them.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 48


class BlindTrie:
    """Strings of equal length, by branching byte; equal strings share a leaf."""

    def __init__(self, width: int):
        self.width = width
        # A node is [depth, {byte: child}], a leaf is [width, string, members].
        self.root: list | None = None
        self.leaves: dict[bytes, list] = {}

    def insert(self, string: bytes, member: int) -> None:
        leaf = self.leaves.get(string)
        if leaf is not None:
            leaf[2].append(member)
            return
        leaf = self.leaves[string] = [self.width, string, [member]]
        if self.root is None:
            self.root = leaf
            return
        # Go down blindly, then compare with the one leaf found there.
        node = self.root
        while len(node) == 2:
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        differ = int.from_bytes(string, "big") ^ int.from_bytes(other, "big")
        depth = self.width - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] < depth:
            above, node = node, node[1][string[node[0]]]
        if len(node) == 2 and node[0] == depth:
            node[1][string[depth]] = leaf
            return
        branch = [depth, {other[depth]: node, string[depth]: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][string[above[0]]] = branch

    def ordered(self) -> list[tuple[int, int]]:
        """(member, common prefix with the one before) in string order; 0 for the first."""
        found: list[tuple[int, int]] = []
        stack = [(self.root, 0)]
        while stack:
            node, common = stack.pop()
            if len(node) == 2:
                depth, children = node
                keys = sorted(children)
                stack.extend((children[k], depth if i else common) for i, k in reversed(list(enumerate(keys))))
            else:
                found.append((node[2][0], common))
                found.extend((member, self.width) for member in node[2][1:])
        return found


def deep_shallow(group: np.ndarray, strings: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``strings`` (bytes) inside each group, and common prefixes.

    ``group`` is ascending.  The second result is, for each place of the order, the length of the
    common prefix with the row before it, and -1 where a group starts.
    """
    count, width = strings.shape
    depth = min(shallow, width) // 8 * 8
    words = np.ascontiguousarray(strings[:, :depth]).view(">u8").astype(np.uint64)
    order = np.arange(count)
    common = np.full(count, depth, np.int32)
    starts = np.r_[True, group[1:] != group[:-1]][:count]
    common[starts] = -1
    for level in range(depth // 8):
        number = np.cumsum(starts)
        size = np.bincount(number)
        places = np.flatnonzero(size[number] > 1)
        if not len(places):
            break
        chars = words[order[places], level]
        turn = np.lexsort((chars, number[places]))
        order[places], chars = order[places][turn], chars[turn]
        apart = np.flatnonzero((chars[1:] != chars[:-1]) & ~starts[places[1:]]) + 1
        differ = chars[apart] ^ chars[apart - 1]
        # Equal leading bytes of the character: those above the highest byte that differs.
        equal = np.full(len(differ), 7)
        for byte in range(1, 8):
            equal -= differ >= np.uint64(1 << 8 * byte)
        common[places[apart]] = level * 8 + equal
        starts[places[apart]] = True
    number = np.cumsum(starts)
    size = np.bincount(number)
    first = np.flatnonzero(starts)
    for at in first[size[number[first]] > 1].tolist():
        end = at + int(size[number[at]])
        trie = BlindTrie(width)
        for row in order[at:end].tolist():
            trie.insert(strings[row].tobytes(), row)
        for place, (row, shared) in enumerate(trie.ordered(), at):
            order[place] = row
            if place > at:
                common[place] = shared
    return order, common
