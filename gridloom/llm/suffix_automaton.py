"""A suffix automaton of many words: which of them end at each place of a text."""

from __future__ import annotations

from collections.abc import Iterator, Mapping


class SuffixAutomaton:
    """The states are classes of parts of the words that end at the same places of them.

    A text is read one character at a time; the state is that of its longest end that is
    a part of some word. The words that end there are those of the state that are no
    longer than this, and all of the states that its suffix links lead to.
    """

    def __init__(self, words: Mapping[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        # Words that share a beginning share its states: one step for each different beginning.
        previous, path = "", [0]
        for word in sorted(words):
            k = 0
            while k < len(previous) and k < len(word) and previous[k] == word[k]:
                k += 1
            del path[k + 1 :]
            for c in word[k:]:
                path.append(self._extend(path[-1], c))
            previous = word
        # A word's state may have been split since.
        held: dict[int, list[tuple[int, int]]] = {}
        for word, value in words.items():
            state = 0
            for c in word:
                state = self.next[state][c]
            held.setdefault(state, []).append((len(word), value))
        # What ends at a state: its own words, longer ones first, then those that its link leads to.
        self.words: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.words[self.link[s]]
            self.words[s] = (*sorted(held[s], reverse=True), *above) if s in held else above

    def _extend(self, last: int, c: str) -> int:
        """The state of the last state's longest part and one more character."""
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(c)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, c, known)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: str, q: int) -> int:
        """A copy of ``q`` for the shorter parts that end like those of ``p`` and ``c``."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def endings(self, text: str) -> Iterator[tuple[int, int, tuple[tuple[int, int], ...]]]:
        """end, longest, words for each place of the text where words may end: (length, value) of those, of which any longer than ``longest`` don't count."""
        nxt, link, length, words = self.next, self.link, self.length, self.words
        state = run = 0
        for end, c in enumerate(text, 1):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt[state].get(c)
            if to is None:
                run = 0
                continue
            state, run = to, run + 1
            found = words[state]
            if found:
                yield end, run, found
