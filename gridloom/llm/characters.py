"""Character classes as an installed tokenizer library knows them.

The libraries, Python and the ``regex`` package ship different versions of the Unicode
tables. The library is asked for its classes once, on the driver; where it agrees with
``regex``, texts are scanned by ``regex``'s own classes, and texts that hold one of the
other code points by the library's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import regex

#: All code points that may stand in a text.
EVERY = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))


def ranges(chars: Iterable[str]) -> str:
    """The inside of a character class with these characters."""
    codes = sorted(map(ord, chars))
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[i]:08X}-\\U{codes[j]:08X}")
        i = j + 1
    return "".join(out)


@dataclass
class Classes:
    """Insides of the classes of letters, numbers and white space, and the characters that ``regex`` puts elsewhere."""

    letters: str
    numbers: str
    blanks: str
    odd: str
    _odd: frozenset[str] = field(default=frozenset(), repr=False)

    @classmethod
    def asked(cls, members: Callable[[str], Iterable[str]]) -> Classes:
        """``members`` returns the characters of EVERY that the library finds by a class such as ``\\p{L}``."""
        found, odd = {}, set()
        for name, usual in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}")):
            found[name] = set(members(name))
            odd |= found[name] ^ set(regex.findall(usual, EVERY))
        return cls(*(ranges(found[n]) for n in (r"\p{L}", r"\p{N}", r"\s")), "".join(sorted(odd)))

    def usual(self, pattern: str) -> regex.Pattern:
        """The pattern for texts without odd characters."""
        return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def exact(self, pattern: str) -> regex.Pattern:
        """The pattern for all texts, by the library's classes."""
        inside = {r"\p{L}": self.letters, r"\p{N}": self.numbers, r"\s": self.blanks}

        def spelled(m: regex.Match) -> str:
            if m[0].startswith("["):
                body = m[0]
                for name, chars in inside.items():
                    body = body.replace(name, chars)
                return body
            return f"[^{self.blanks}]" if m[0] == r"\S" else f"[{inside[m[0]]}]"

        return regex.compile(regex.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", spelled, pattern))

    def plain(self, text: str) -> bool:
        """Whether the usual pattern is right for a text."""
        if text.isascii():
            return True
        if not self._odd:
            self._odd = frozenset(self.odd)
        return self._odd.isdisjoint(text)
