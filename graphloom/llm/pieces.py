"""Cuts a text where byte-level BPE pre-tokenization always cuts, and encodes each distinct unit once a worker.

The public pre-tokenization pattern lets a token start with one space and never lets one token hold both other
characters and following white space. So a text can be cut before the last space of each run of white space and
around the rest of the run; encoding the units alone and joining the ids equals encoding the text. Units repeat
like words do, so a bounded cache of their ids carries most of the work.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Unicode's White_Space, as the tokenizers' regular expressions know it: fixed values.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUN = re.compile(f"[{SPACE}]{{2}}")
UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
CACHED_ENTRIES = 800_000
CACHED_LENGTH = 48


class UnitCache(dict):
    """unit -> its ids as little-endian unsigned 32-bit integers; holds at most `most` entries, then starts anew."""

    def __init__(self, encode: Callable[[str], bytes], prefix: str = "", most: int = CACHED_ENTRIES):
        super().__init__()
        self.encode, self.prefix, self.most = encode, prefix, most

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(self.prefix + unit)
        if len(unit) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[unit] = ids
        return ids


class TextEncoder:
    """Text to ids (bytes) by an encoder of units."""

    def __init__(self, encode: Callable[[str], bytes], most: int = CACHED_ENTRIES):
        self.bare, self.spaced = UnitCache(lambda u: encode(u) if u else b"", "", most), UnitCache(encode, " ", most)
        self.line = encode("\n")

    def __call__(self, text: str) -> bytes:
        if RUN.search(text):
            return b"".join(map(self.bare.__getitem__, UNITS.findall(text)))
        spaced, out = self.spaced.__getitem__, []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line)
            words = line.split(" ")
            out.append(self.bare[words[0]])
            out.extend(map(spaced, words[1:]))
        return b"".join(out)
