"""A minimal acyclic transducer from words to token ids, in one memory-mapped file.

The words, in byte order, are compiled into an automaton whose equal suffixes
are shared. Each arc carries how many words sort before those it leads to, so
the sum along a path is the word's rank; the rank picks the word's ids. States,
arcs and ids are flat arrays in one image that readers map into memory.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from collections.abc import Iterable

import numpy as np

_HEAD = struct.Struct("<6Q")


def compile_image(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The image of a lexicon; the words may come in any order, without repeats."""
    entries = sorted(words)
    register: dict[tuple, int] = {}
    first, final, labels, goals, skips = [], [], [], [], []
    counts: list[int] = []

    def freeze(node: list) -> int:
        """node: [is final, [(label, frozen state)]]"""
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(first)
            first.append(len(labels))
            final.append(node[0])
            seen = int(node[0])
            for label, goal in node[1]:
                labels.append(label)
                goals.append(goal)
                skips.append(seen)
                seen += counts[goal]
            counts.append(seen)
        return state

    path: list[list] = [[False, []]]  # the states along the latest word, not yet frozen
    latest = b""
    for word, _ in entries:
        shared = len(os.path.commonprefix([latest, word]))
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][1].append((latest[len(path) - 1], freeze(node)))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        latest = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((latest[len(path) - 1], freeze(node)))
    root = freeze(path[0])
    first.append(len(labels))
    starts = np.concatenate([[0], np.cumsum([len(ids) for _, ids in entries])]).astype("<u4")
    ids = np.array([i for _, more in entries for i in more], "<u4")
    arrays = [np.array(first, "<u4"), np.array(final, "u1"), np.array(labels, "u1"), np.array(goals, "<u4"), np.array(skips, "<u4"), starts, ids]
    body = b"".join(a.tobytes() for a in arrays)
    return _HEAD.pack(len(first), len(final), len(labels), len(starts), len(ids), root) + body


class Lexicon:
    """Look-ups in a compiled image, mapped from a file of this process's own folder."""

    def __init__(self, image: bytes):
        handle, path = tempfile.mkstemp(prefix="lexicon-")
        with os.fdopen(handle, "wb") as out:
            out.write(image)
        with open(path, "rb") as back:
            self.map = mmap.mmap(back.fileno(), 0, access=mmap.ACCESS_READ)
        os.unlink(path)  # the mapping keeps the pages; nothing stays behind in the folder
        n_first, n_final, n_arcs, n_starts, n_ids, self.root = _HEAD.unpack_from(self.map)
        at = _HEAD.size
        views = []
        for n, kind in ((n_first, "<u4"), (n_final, "u1"), (n_arcs, "u1"), (n_arcs, "<u4"), (n_arcs, "<u4"), (n_starts, "<u4"), (n_ids, "<u4")):
            if kind == "u1":
                views.append(self.map[at : at + n])  # one byte a state or arc: copied, for its fast search
                at += n
            else:
                views.append(memoryview(self.map)[at : at + 4 * n].cast("I"))
                at += 4 * n
        self.first, self.final, self.labels, self.goals, self.skips, self.starts, self.ids = views

    def rank(self, word: bytes) -> int:
        """The word's place among the words; -1 for other words."""
        state, rank, first, find, skips, goals = self.root, 0, self.first, self.labels.find, self.skips, self.goals
        for letter in word:
            at = find(letter, first[state], first[state + 1])
            if at < 0:
                return -1
            rank += skips[at]
            state = goals[at]
        return rank if self.final[state] else -1

    def get(self, word: bytes) -> tuple[int, ...] | None:
        rank = self.rank(word)
        return None if rank < 0 else tuple(self.ids[self.starts[rank] : self.starts[rank + 1]])
