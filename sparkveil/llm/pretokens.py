"""Cutting texts where no token of a GPT-2 style pattern can cross.

Every alternative of the pattern matches white space only at its start (`` ?\\p{L}+`` and the like)
or consists of white space, so no token goes on from a character that isn't white space to one that
is. A text may be cut before any such white space, and the pieces tokenise as the whole does.
"""

from __future__ import annotations

import re

#: Unicode White_Space, as the tokenizers' regular expressions have it.
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_BEFORE_SPACE = re.compile(f"[{_WS}] ")


def chunks(text: str) -> tuple[str, list[str]]:
    """The first chunk, and the others without the one space that each begins with.

    If any space follows white space, all chunks are returned by the general rule, with their own
    white space; the caller gets them as (None, chunks).
    """
    if _BEFORE_SPACE.search(text) is None:
        first, *rest = text.split(" ")
        return first, rest
    return None, _CHUNK.findall(text)


class Memo(dict):
    """Chunk to result, filled by ``make``. At ``most`` entries it starts anew and takes back from
    the entries before what is asked for again, so memory stays bounded and frequent chunks stay."""

    def __init__(self, make, most: int = 250_000, longest: int = 200):
        super().__init__()
        self.make, self.most, self.longest, self.before = make, most, longest, {}

    def __missing__(self, chunk):
        value = self.before.get(chunk)
        if value is None:
            value = self.make(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[chunk] = value
        return value
