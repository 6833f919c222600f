"""A trie of reference strings, searched with a bit-parallel Levenshtein automaton."""

from __future__ import annotations

from collections.abc import Iterable


class Trie:
    """Strings with payloads; several payloads may end at one node."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list] = [[]]

    def add(self, text: str, payload) -> None:
        at = 0
        for c in text:
            to = self.next[at].get(c)
            if to is None:
                to = len(self.next)
                self.next[at][c] = to
                self.next.append({})
                self.ends.append([])
            at = to
        if payload not in self.ends[at]:
            self.ends[at].append(payload)

    def extend(self, items: Iterable[tuple[str, object]]) -> Trie:
        for text, payload in items:
            self.add(text, payload)
        return self

    def exact(self, text: str) -> list:
        at = 0
        for c in text:
            at = self.next[at].get(c, -1)
            if at < 0:
                return []
        return self.ends[at]

    def within(self, query: str, most: int) -> list[tuple[int, object]]:
        """All (distance, payload) with at most ``most`` edits.

        An edit inserts, drops or changes a character or swaps two neighbours. The automaton's
        states are bit sets, one for each number of edits; bit i says that i characters of the
        query are used up. A branch of the trie is left as soon as all sets are empty.
        """
        n = len(query)
        full, accept = (1 << (n + 1)) - 1, 1 << n
        masks: dict[str, int] = {}
        for i, c in enumerate(query):
            masks[c] = masks.get(c, 0) | 1 << i
        start = [(1 << (e + 1)) - 1 & full for e in range(most + 1)]
        found: dict[object, int] = {}
        stack = [(0, start, [0] * (most + 1))]
        while stack:
            at, sets, swaps = stack.pop()
            if self.ends[at]:
                for e in range(most + 1):
                    if sets[e] & accept:
                        for p in self.ends[at]:
                            if found.get(p, e + 1) > e:
                                found[p] = e
                        break
            for c, to in self.next[at].items():
                b = masks.get(c, 0)
                now = [((sets[0] & b) << 1) & full]
                for e in range(1, most + 1):
                    lower = sets[e - 1]
                    now.append((((sets[e] & b) << 1) | lower | (lower << 1) | (now[e - 1] << 1) | ((swaps[e - 1] & b) << 2)) & full)
                if any(now):
                    stack.append((to, now, [s & (b >> 1) for s in sets]))
        return sorted(((d, p) for p, d in found.items()), key=lambda x: (x[0], str(x[1])))

    def abbreviated(self, words: list[tuple[str, bool]], between: str = " ", skipped: str = "aeiouy") -> list:
        """All payloads of paths whose words are these ones, written out, clipped or without vowels.

        A word is written out, or lacks the letters ``skipped`` after its first one, or, if marked as clipped and of two
        letters at least, is the beginning of the path's word. Words of a path are parted by ``between``.
        """
        at = {0}
        for i, (word, clipped) in enumerate(words):
            after: set[int] = set()
            for node in at:
                after |= self._word(node, word, clipped and len(word) >= 2, between, skipped)
            if i + 1 < len(words):
                after = {self.next[n][between] for n in after if between in self.next[n]}
            at = after
            if not at:
                return []
        return sorted({p for n in at for p in self.ends[n]}, key=str)

    def _word(self, node: int, word: str, clipped: bool, between: str, skipped: str) -> set[int]:
        """The nodes at the end of a path's word that the word stands for."""
        out: set[int] = set()
        without = all(x not in skipped for x in word[1:])
        stack = [(node, 0, False)]  # node, letters used, whether letters were left out
        while stack:
            at, used, bare = stack.pop()
            if used == len(word):
                if self.ends[at] or between in self.next[at]:
                    out.add(at)
                for c, to in self.next[at].items():
                    if c != between and (clipped and not bare or without and c in skipped):
                        stack.append((to, used, bare or not clipped))
                continue
            for c, to in self.next[at].items():
                if c == word[used]:
                    stack.append((to, used + 1, bare))
                elif used and without and c in skipped:
                    stack.append((to, used, True))
        return out
