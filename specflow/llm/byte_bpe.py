"""Byte-level BPE from a rank file: encoding by padded numpy matrices, and decoding.

Texts are cut into units (see ``units``), units into the matches of the split pattern, and each new match ("piece") is
merged. Pieces are grouped by length into padded matrices of token ids, one piece a row. Each round every row merges its
leftmost pair of least rank; pairs are looked up in an open-addressing hash table held in numpy arrays; rows move up to
close the gap, and rows without a pair left are taken out of the matrix, which is cut to the longest row that remains.
A piece longer than ``LONGEST_ROW`` bytes takes more rounds than a matrix pays for; it is merged by a heap, with the
same result.

Null texts count as empty; an empty text has no ids. Repeated rows are encoded like any other. Rows come back in no
particular order, one for each row of the input.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slices
from .units import UnitCoder

#: Bytes of a piece from which on a heap is used.
LONGEST_ROW = 2048
NONE = np.iinfo(np.int32).max


class Pairs:
    """Rank of the token that two tokens' bytes make together, for arrays of pairs; NONE where there is none."""

    def __init__(self, ranks: dict[bytes, int]):
        first, second, rank = [], [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    first.append(a)
                    second.append(b)
                    rank.append(r)
        keys = (np.array(first, np.uint64) << np.uint64(32)) | np.array(second, np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        slot, left, self.probes = self.slot(keys), np.arange(len(keys)), 0
        values = np.array(rank, np.int32)
        while len(left):  # each round the first comer of a free slot takes it, the others probe the next one
            self.probes += 1
            at = slot[left]
            free = self.keys[at] == np.iinfo(np.uint64).max
            _, first_at = np.unique(at, return_index=True)
            taken = np.zeros(len(left), bool)
            taken[first_at] = True
            taken &= free
            self.keys[at[taken]], self.rank[at[taken]] = keys[left[taken]], values[left[taken]]
            left = left[~taken]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a, b: int64 ids; a negative id is padding and pairs with nothing."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at, out = self.slot(keys), np.full(keys.shape, NONE, np.int32)
        open_ = (a >= 0) & (b >= 0)
        for _ in range(self.probes):
            held = self.keys[at]
            hit = open_ & (held == keys)
            out[hit] = self.rank[at[hit]]
            open_ &= ~hit & (held != np.iinfo(np.uint64).max)
            if not open_.any():
                break
            at = (at + 1) & ((1 << self.bits) - 1)
        return out


def merge_rows(pieces: list[bytes], byte_ids: np.ndarray, pairs: Pairs) -> list[bytes]:
    """Ids of pieces of similar length, each as little-endian unsigned 32-bit integers."""
    width = max(map(len, pieces))
    ids = np.full((len(pieces), width), -1, np.int64)
    length = np.array([len(p) for p in pieces])
    ids[np.arange(width) < length[:, None]] = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    rows, done = np.arange(len(pieces)), [None] * len(pieces)
    rank = pairs(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((len(pieces), 0), np.int32)
    while True:
        at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
        least = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE, np.int32)
        over = least == NONE
        if over.any():
            flat, wide = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, (row, n) in enumerate(zip(rows[over].tolist(), length[over].tolist(), strict=True)):
                done[row] = flat[k * wide : k * wide + 4 * n]
        if over.all():
            return done
        live = ~over
        width = int(length[live].max())
        ids, rank, rows, length, at, least = ids[live, :width], rank[live, : width - 1], rows[live], length[live], at[live], least[live]
        n, every = len(rows), np.arange(len(rows))
        ids[every, at] = least
        behind = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
        ids = np.take_along_axis(np.concatenate([ids, np.full((n, 1), -1, np.int64)], 1), behind, 1)
        rank = np.take_along_axis(np.concatenate([rank, np.full((n, 1), NONE, np.int32)], 1), behind[:, : width - 1], 1)
        length = length - 1
        padded = np.concatenate([ids, np.full((n, 1), -1, np.int64)], 1)
        has_next = at < width - 1
        rank[every[has_next], at[has_next]] = pairs(padded[every, at], padded[every, at + 1])[has_next]
        has_last = at > 0
        rank[every[has_last], at[has_last] - 1] = pairs(padded[every, np.maximum(at - 1, 0)], padded[every, at])[has_last]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> np.ndarray:
    """Ids of one very long piece: a heap of pairs over a linked list of its parts."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        if (j := end[i]) < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == stop):
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return np.array(out, "<u4")


def char_class(pattern: str, engine) -> str:
    """The code points that one class of the split pattern holds for ``engine``, as ranges for Python's re.

    engine: maps a pattern and a text to what the pattern matched of it.
    """
    found = np.array(sorted(set(map(ord, engine(pattern, "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000))))))
    starts = np.flatnonzero(np.diff(found, prepend=-2) != 1)
    ends = np.append(starts[1:], len(found)) - 1
    return "".join(f"\\U{found[a]:08x}-\\U{found[b]:08x}" for a, b in zip(starts, ends, strict=True))


def matched_by_library(pattern: str, text: str) -> str:
    """What a pattern matches in the library whose ids are the standard: it drops everything else before encoding."""
    import tiktoken

    single = tiktoken.Encoding("single", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return single.decode_bytes(single.encode_ordinary(text)).decode()


@lru_cache(maxsize=4)
def split_pattern(pattern: str) -> re.Pattern:
    """The split pattern for Python's re: its Unicode classes are spelled out as the standard library of ids has them."""
    letters, numbers, spaces = (char_class(c, matched_by_library) for c in (r"\p{L}", r"\p{N}", r"\s"))
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    out = out.replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
    if r"\p" in out:
        raise ValueError(f"a class of the pattern is not known here: {pattern}")
    return re.compile(out)


class ByteBpe:
    """Encoder and decoder of one rank file; ``of`` keeps one for each worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs, self.pattern = Pairs(self.ranks), split_pattern(pattern)
        self.token = {r: t for t, r in self.ranks.items()}
        self.coder = UnitCoder(self.units)

    @staticmethod
    @lru_cache(maxsize=4)
    def of(path: str, pattern: str) -> ByteBpe:
        return ByteBpe(path, pattern)

    def pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces."""
        out, buckets = {}, {}
        for p in pieces:
            if (r := self.ranks.get(p)) is not None:
                out[p] = r.to_bytes(4, "little")
            elif len(p) > LONGEST_ROW:
                out[p] = merge_long(p, self.ranks).tobytes()
            else:
                buckets.setdefault(len(p) if len(p) < 16 else 1 << (len(p) - 1).bit_length(), []).append(p)
        for size, bucket in buckets.items():
            step = max(1, (1 << 21) // size)  # cells of a matrix
            for i in range(0, len(bucket), step):
                part = bucket[i : i + step]
                out.update(zip(part, merge_rows(part, self.byte_ids, self.pairs), strict=True))
        return out

    def units(self, units: list[str]) -> list[bytes]:
        cut = [[p.encode() for p in self.pattern.findall(u)] for u in units]
        ids = self.pieces(list({p for c in cut for p in c}))
        return [b"".join([ids[p] for p in c]) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.coder.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each row of ``docs``: its key, ids, their number, and the decoded text's checksum.

    keep_ids: also return ``ids``, an array of the token ids. The key may be null or repeat.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def batches(stream):
        bpe = ByteBpe.of(path, pattern)
        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids = bpe.encode(texts[a:b])
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(key, text).mapInArrow(batches, schema)
