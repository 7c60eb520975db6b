"""Deep-shallow sorting of suffixes.

Suffixes are put in order by multikey quicksort on words of eight bytes down to a shallow depth: large groups
are split about a pivot word, the many small ones of a level are sorted together. What still agrees there
goes to blind tries, which find the place of each suffix with one comparison of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a word, bytes to which quicksort goes, and suffixes above which a group is split about a pivot.
WORD, SHALLOW, SMALL = 8, 32, 1 << 14


class BlindTrie:
    """Inner nodes hold a depth and a child per byte there; leaves hold the suffixes that agree to the end."""

    def __init__(self, text: bytes, limit: int):
        self.text, self.limit = text, limit
        self.root: list | None = None

    def insert(self, at: int) -> None:
        text, limit = self.text, self.limit
        if self.root is None:
            self.root = [limit, [at]]
            return
        node = self.root
        while node[0] < limit:  # blind: bytes between branches are not looked at
            node = node[1].get(text[at + node[0]]) or next(iter(node[1].values()))
        other = node[1][0]
        differ = int.from_bytes(text[at : at + limit], "big") ^ int.from_bytes(text[other : other + limit], "big")
        if not differ:
            node[1].append(at)
            return
        depth = limit - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] < depth:
            above, node = node, node[1][text[at + node[0]]]
        leaf = [limit, [at]]
        if node[0] == depth and depth < limit:
            node[1][text[at + depth]] = leaf
            return
        branch = [depth, {text[other + depth]: node, text[at + depth]: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][text[at + above[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Suffixes that agree to the end, in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == self.limit:
                yield node[1]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... for each range, one behind the other."""
    return np.arange(int(size.sum())) + np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size)


class SuffixSort:
    """``order``: the positions by their ``limit`` bytes; ``same``: whether each agrees with the one before it."""

    def __init__(self, text: bytes, positions: np.ndarray, limit: int):
        self.text, self.limit = text, limit
        self.order = np.array(positions, np.int64)
        self.same = np.zeros(len(self.order), bool)
        padded = np.frombuffer(text + bytes(WORD), np.uint8)
        self.windows = np.lib.stride_tricks.sliding_window_view(padded, WORD)
        lo, size = np.zeros(1, np.int64), np.full(1, len(self.order), np.int64)
        for depth in range(0, min(SHALLOW, limit // WORD * WORD), WORD):
            lo, size = self._level(lo[size > 1], size[size > 1], depth)
        self._deep(lo[size > 1], size[size > 1])

    def _words(self, at: np.ndarray, depth: int) -> np.ndarray:
        return self.windows[at + depth].view(">u8").ravel().astype(np.uint64)

    def _level(self, lo: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Sort groups that agree so far by their next word; the groups that agree in it too."""
        big = list(zip(lo[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True))
        small = [(lo[size <= SMALL], size[size <= SMALL])]
        equal = []
        while big:
            start, n = big.pop()
            part = self.order[start : start + n]
            words = self._words(part, depth)
            pivot = np.sort(words[:: n // 31])[16]
            below, above = words < pivot, words > pivot
            less, more = part[below], part[above]
            self.order[start : start + n] = np.concatenate((less, part[~(below | above)], more))
            equal.append((start + len(less), n - len(less) - len(more)))
            for at, count in ((start, len(less)), (start + n - len(more), len(more))):
                if count > SMALL:
                    big.append((at, count))
                elif count > 1:
                    small.append((np.array([at]), np.array([count])))
        lo, size = (np.concatenate(x) for x in zip(*small, strict=True))
        if len(lo):
            at = _ranges(lo, size)
            group = np.repeat(np.arange(len(lo)), size)
            words = self._words(self.order[at], depth)
            rank = np.lexsort((words, group))
            self.order[at] = self.order[at][rank]
            words = words[rank]
            new = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (group[1:] != group[:-1]))))
            lo, size = at[new], np.diff(np.append(new, len(at)))
        if equal:
            more, counts = np.array(equal, np.int64).T
            lo, size = np.concatenate((lo, more)), np.concatenate((size, counts))
        return lo, size

    def _deep(self, lo: np.ndarray, size: np.ndarray) -> None:
        """Groups that agree to the shallow depth: tries of two leaves side by side, larger ones one by one."""
        two = lo[size == 2]
        a, b, alive = self.order[two], self.order[two + 1], np.arange(len(two))
        depth = min(SHALLOW, self.limit // WORD * WORD)
        while depth < self.limit and len(alive):
            x, y = self._words(a[alive], depth), self._words(b[alive], depth)
            if depth + WORD > self.limit:  # the last word counts only to the limit
                cut = np.uint64(8 * (depth + WORD - self.limit))
                x, y = x >> cut, y >> cut
            turn = alive[x > y]
            self.order[two[turn]], self.order[two[turn] + 1] = b[turn], a[turn]
            alive = alive[x == y]
            depth += WORD
        self.same[two[alive] + 1] = True
        for start, n in zip(lo[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            trie = BlindTrie(self.text, self.limit)
            for at in self.order[start : start + n].tolist():
                trie.insert(at)
            for leaf in trie.leaves():
                self.order[start : start + len(leaf)] = leaf
                self.same[start + 1 : start + len(leaf)] = True
                start += len(leaf)

    def repeated(self) -> np.ndarray:
        """Positions that agree with another to the limit."""
        return self.order[self.same | np.append(self.same[1:], False)]
