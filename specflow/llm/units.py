"""Cutting a text into units that a byte-level tokenizer treats separately, and remembering what it made of each.

A byte-level BPE splits a text by a pattern before it merges, and no match of that pattern has white space behind a
character that is none. So wherever white space follows such a character one match ends and the next begins, the
pattern's later matches do not depend on what lies before, and the text may be cut there without changing a token.
Words repeat, so most units are found in a dictionary; a tokenizer sees only the new ones.
"""

from __future__ import annotations

import re

#: White space other than the space and the line feed, as Python's str.isspace has it: a superset of every tokenizer's.
OTHER_SPACE = tuple(c for c in map(chr, range(0x3100)) if c.isspace() and c not in " \n")
#: White space on which all pattern engines agree, after a character that is white space for none of them.
CUT = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")
#: Characters of a text that are cut into units at once.
PART = 1 << 21


def parts_of(text: str):
    """A text in parts of about PART characters, cut where units are."""
    at = 0
    while len(text) - at > PART and (found := CUT.search(text, at + PART)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def plain(text: str) -> bool:
    """Whether single spaces and line feeds are the only white space, so that str.split finds the units."""
    return not ("  " in text or "\n\n" in text or "\n " in text or " \n" in text or any(c in text for c in OTHER_SPACE))


class UnitCoder:
    """Token ids of texts as little-endian unsigned 32-bit integers, from an encoder of units.

    encode_many: takes a list of units, returns the ids of each as bytes.
    most: units remembered at once, in two generations of half that many; the older one is dropped when the younger is
    full, so memory is bounded (some 200 bytes a unit) and frequent units stay. Long texts are encoded part by part.
    """

    def __init__(self, encode_many, most: int = 400_000):
        self.encode_many, self.half = encode_many, most // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out, held, size = [b""] * len(texts), [], 0
        for i, t in enumerate(texts):
            for k, part in enumerate(parts_of(t)):
                held.append((i, k, part))
                size += len(part)
                if size >= PART:
                    self._encode(held, out)
                    held, size = [], 0
        self._encode(held, out)
        return out

    def _encode(self, parts: list[tuple[int, int, str]], out: list[bytes]) -> None:
        """Appends the ids of parts to those of their texts. A unit is kept under its text without a leading space; the first
        unit of a text, which has none, under "\\0" and it."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        cut, needed = [], set()
        for _, k, t in parts:
            if plain(t):
                words = t.replace("\n", " \n").split(" ")
                if k:  # the space that begins a later part
                    words.pop(0)
                else:
                    words[0] = "\0" + words[0]
            else:
                words = ["\0" + u for u in CUT.split(t)]
            needed.update(words)
            cut.append(words)
        young, old = self.young, self.old
        new = []
        for w in needed.difference(young):
            if (known := old.get(w)) is None:
                new.append(w)
            else:
                young[w] = known
        if new:
            young.update(zip(new, self.encode_many([w[1:] if w[:1] == "\0" else w if w[:1] == "\n" else " " + w for w in new]), strict=True))
        found = young.__getitem__
        for (i, _, _), words in zip(parts, cut, strict=True):
            ids = b"".join(map(found, words))
            out[i] = out[i] + ids if out[i] else ids
