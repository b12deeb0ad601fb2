"""Generalised suffix automaton over integer tokens."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np


class SuffixAutomaton:
    """All substrings of several token sequences. `states` has the state of each prefix of each sequence,
    in turn; the prefix is the longest string of its state."""

    def __init__(self, sequences: Iterable[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.states: list[int] = []
        nexts, links, lengths, states = self.next, self.link, self.length, self.states
        for tokens in sequences:
            last = 0
            for token in tokens:
                q = nexts[last].get(token)
                if q is not None:
                    last = q if lengths[q] == lengths[last] + 1 else self._copy(last, token, q)
                    states.append(last)
                    continue
                new = len(links)
                nexts.append({})
                links.append(0)
                lengths.append(lengths[last] + 1)
                p = last
                while p >= 0:
                    held = nexts[p]
                    if token in held:
                        q = held[token]
                        links[new] = q if lengths[q] == lengths[p] + 1 else self._copy(p, token, q)
                        break
                    held[token] = new
                    p = links[p]
                last = new
                states.append(last)

    def _copy(self, p: int, token: int, q: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        new = len(self.link) - 1
        self.link[q] = new
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        return new

    def merged(self, labels: np.ndarray, start: int, merge: np.ufunc) -> np.ndarray:
        """For each state, the labels (one for each entry of `states`) of all prefixes that end with its
        strings, merged; `start` where there are none."""
        value = np.full(len(self.link), start, dtype=np.int64)
        merge.at(value, np.array(self.states, dtype=np.int64), labels)
        link, length = np.array(self.link), np.array(self.length)
        order = np.argsort(-length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for level in np.split(order, cuts):  # links lead to shorter strings only
            level = level[link[level] > 0]
            merge.at(value, link[level], value[level])
        return value

    def suffix_states(self, size: int) -> np.ndarray:
        """For each state with strings of at least `size` tokens: the state of their last `size`."""
        link, length = np.array(self.link), np.array(self.length)
        up = np.where((link > 0) & (length[link] >= size), link, np.arange(len(link)))
        while True:
            further = up[up]
            if np.array_equal(further, up):
                return up
            up = further

    def step(self, state: int, matched: int, token: int) -> tuple[int, int]:
        """The longest suffix of the text so far, with this token, that the sequences contain: its
        state and length."""
        while state and token not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(token)
        return (0, 0) if to is None else (to, matched + 1)

    def stream(self, sequences: Iterable[Sequence[int]]) -> tuple[list[int], list[int]]:
        """Matching statistics of sequences, each streamed by itself: for each token, in turn, the state and
        the length of the longest suffix up to it that the automaton's sequences contain."""
        nexts, links, lengths = self.next, self.link, self.length
        states: list[int] = []
        matched: list[int] = []
        for tokens in sequences:
            state = size = 0
            for token in tokens:
                to = nexts[state].get(token)
                while to is None and state:
                    state = links[state]
                    size = lengths[state]
                    to = nexts[state].get(token)
                if to is None:
                    size = 0
                else:
                    state = to
                    size += 1
                states.append(state)
                matched.append(size)
        return states, matched
