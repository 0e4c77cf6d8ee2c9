"""Token trie of many names with failure links (Aho-Corasick over words).

A small helper of ``locations``: tasks hold it for a gazetteer of bounded
size and run one pass per text over its words."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence


class TokenTrie:
    """Finds every run of words that is a name; names are word sequences."""

    def __init__(self, names: Iterable[Sequence[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.length = [0]  # words of the name that ends at the state, 0 for none
        depth = [0]
        for name in names:
            at = 0
            for word in name:
                to = self.next[at].get(word)
                if to is None:
                    to = self.next[at][word] = len(self.next)
                    self.next.append({})
                    self.length.append(0)
                    depth.append(depth[at] + 1)
                at = to
            self.length[at] = depth[at]
        # longest proper ending that is a state, and the nearest such one where a name ends
        self.fail, self.shorter = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            back = self.fail[at]
            self.shorter[at] = back if self.length[back] else self.shorter[back]
            for word, to in self.next[at].items():
                back = self.fail[at]
                while back and word not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(word, 0)
                queue.append(to)

    def hits(self, words: Sequence[str]) -> list[tuple[int, int]]:
        """(place of the first word, number of words) of all names that stand
        in ``words``, overlapping ones too; linear in words and hits."""
        out, at = [], 0
        step, fail, length, shorter = self.next, self.fail, self.length, self.shorter
        for k, word in enumerate(words):
            to = step[at].get(word)
            while to is None and at:
                at = fail[at]
                to = step[at].get(word)
            at = to or 0
            if at:
                end = at if length[at] else shorter[at]
                while end:
                    out.append((k + 1 - length[end], length[end]))
                    end = shorter[end]
        return out

    def leftmost_longest(self, words: Sequence[str]) -> list[tuple[int, int]]:
        """Hits that do not overlap: from left to right the first one free, the
        longest of those that begin together."""
        free, out = 0, []
        for k, n in sorted(self.hits(words), key=lambda h: (h[0], -h[1])):
            if k >= free:
                out.append((k, n))
                free = k + n
        return out
