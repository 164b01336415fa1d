"""Opening tokenizer files of the tokenizers library, and its ids of units."""

from __future__ import annotations

import json
import os
import re
from array import array

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism


def open_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def splits_at_space(tokenizer) -> bool:
    """Whether it is a byte-level BPE that splits by the usual pattern and changes no character before: then white space
    behind another character always ends a pre-token."""
    said = json.loads(tokenizer.to_str())
    before = said.get("pre_tokenizer") or {}
    return said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and said["model"]["type"] == "BPE"


#: Fixed value: the split pattern of such tokenizers.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Units of characters whose classes have been the same in all versions of Unicode for long: every engine cuts them alike.
SURE = re.compile(" ?[!-~\u00a1-\u017f]+")
#: Fixed rule: a byte-level vocabulary writes a byte that is printed as itself, the others as the characters from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
WRITTEN = {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}


class UnitIds:
    """Ids of units as little-endian unsigned 32-bit integers. Units of usual characters are cut into pieces by the split pattern, and
    the tokenizer's model is asked for pieces that are not remembered (``most`` at a time, with no text around them there is
    nothing else that it needs); other units go through the whole tokenizer."""

    def __init__(self, tokenizer, most: int = 250_000):
        self.tokenizer, self.model, self.most = tokenizer, tokenizer.model, most
        self.known: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        if (ids := self.known.get(text)) is None:
            ids = self.known[text] = array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(WRITTEN))]).tobytes()
        return ids

    def __call__(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(units)
        rest = []
        for i, u in enumerate(units):
            if SURE.fullmatch(u):
                if len(self.known) > self.most:
                    self.known = {}
                out[i] = b"".join([self.piece(p) for p in PIECES.findall(u)])
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out
