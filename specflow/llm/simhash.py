"""Near duplicates by SimHash, with bit-sliced comparison of fingerprints.

1. Every text gets a fingerprint: of the 64-bit hashes of its word shingles, repeats included, each bit takes the value
   that more than half have (a tie gives 0). Wider fingerprints take further words of 64 bits from mixtures of the hash.
2. Equal fingerprints form a class; only distinct fingerprints are compared.
3. Candidates: each of several tables keys a fingerprint. For a small radius r the bits are cut into r + 2 blocks and a table
   stands for each pair of blocks: two fingerprints that differ in at most r bits differ in at most r blocks, so they agree in
   two and meet in a table. That is exact. For documents alike in a share j of their shingles the radius is too large for
   that; there a table keys a document by the least of its shingles' hashes, mixed anew for each table, which two such documents
   have in common with probability j, so n tables miss a pair with probability (1 - j) ** n. Other documents rarely meet, and the
   number of candidates stays in proportion to the input.
4. Fingerprints with the same key in a table form a bucket. Buckets of one are dropped after a count that combines before
   it shuffles. A bucket of more than ``BLOCK`` fingerprints is dealt into blocks, and each pair of blocks is compared by
   a task of its own, so that no bucket has to fit one task.
5. Within a bucket fingerprints are kept as bit planes: word j of plane i holds bit i of fingerprints 64 j to 64 j + 63.
   A query's bits turn planes into differences, carry-save adders count them for 64 fingerprints at once in bitwise
   counters, and a block is left as soon as all its counters are beyond the radius.
6. From each comparison a spanning forest of its links is kept, not all pairs: the components are the same.
7. Components of the classes come from ``components``.

A null or wordless text has the fingerprint zero and is linked like any other. Rows with equal fingerprints, repeated rows
included, are in one component. Keys may repeat or be null; a component's id is its least key that is not null.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed
from .components import connected_components

#: Seed of the hash.
SEED = 42
#: Fingerprints of a bucket that one side of a comparison holds at most, about.
BLOCK = 4096
#: Buckets up to this size are compared together, pair by pair.
SMALL = 8
#: Bytes of text that are cut into words at once, shingles that are counted at once, texts of which counts are held at once.
RUN, HASHED, ROWS = 1 << 18, 1 << 16, 1024
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_by_run(text):
    """Words of a text, bytes or a buffer of them, in lower case (A-Z), in lists: one for each RUN bytes at most."""
    open_: list[bytes] = []  # parts of a word that goes on beyond its run
    for at in range(0, len(text), RUN):
        chunk = bytes(text[at : at + RUN]).translate(LOWER)
        words = chunk.split()
        if open_ and not chunk[:1].isspace():
            open_.append(words.pop(0))
        if open_ and (words or chunk[-1:].isspace()):
            words.insert(0, b"".join(open_))
            open_ = []
        if words and not chunk[-1:].isspace():
            open_ = [words.pop()]
        if words:
            yield words
    if open_:
        yield [b"".join(open_)]


def shingle_hashes(text, size: int):
    """Hashes of a text's shingles, an array for each run of its words; no shingle is held longer than its hash takes."""
    held, short = [], True
    for words in words_by_run(text):
        held += words
        if len(held) >= size:
            short = False
            made = map(b" ".join, zip(*(held[i:] for i in range(size)), strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, made, repeat(SEED)), np.uint64, len(held) - size + 1)
            held = held[len(held) - size + 1 :]
    if short and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def mixed(h: np.ndarray, w: int) -> np.ndarray:
    """Further hashes from one, by the finaliser of SplitMix64."""
    x = h + np.uint64(w * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(texts: list, size: int, words: int = 1, minima: int = 0) -> np.ndarray:
    """One row of ``words`` unsigned 64-bit words for each text (bytes, a buffer or None), then of as many least hashes as asked
    for. Hashes are counted and dropped ``HASHED`` at a time, so a text takes little more than itself, however long."""
    n = np.zeros(len(texts), np.int64)
    ones = np.zeros((words, len(texts), 64), np.uint32)
    least = np.full((minima, len(texts)), np.iinfo(np.uint64).max, np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def count() -> None:
        if not held:
            return
        sizes, first, at = np.array(list(map(len, held))), np.concatenate(held), np.array(rows)
        starts = np.cumsum(sizes) - sizes
        np.add.at(n, at, sizes)
        for w in range(words):
            hashes = (mixed(first, w) if w else first).astype(">u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
            np.add.at(ones[w], at, np.add.reduceat(bits, starts, axis=0, dtype=np.uint32))
        for m in range(minima):
            np.minimum.at(least[m], at, np.minimum.reduceat(mixed(first, 1000 + m), starts))
        held.clear()
        rows.clear()

    size_held = 0
    for i, t in enumerate(texts):
        for hashes in shingle_hashes(t or b"", size):
            held.append(hashes)
            rows.append(i)
            size_held += len(hashes)
            if size_held >= HASHED:
                count()
                size_held = 0
    count()
    out = np.zeros((len(texts), words + minima), np.uint64)
    for w in range(words):
        out[:, w] = np.packbits(2 * ones[w].astype(np.int64) > n[:, None], axis=1).view(">u8")[:, 0]
    out[:, words:] = np.where(n[:, None] > 0, least.T, np.uint64(0))
    return out


def fingerprint(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, words: int = 1, minima: int = 0) -> DataFrame:
    """key, and f0, f1, ..., m0, m1, ... of type bigint, for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    names = [f"f{w}" for w in range(words)] + [f"m{m}" for m in range(minima)]

    def batches(stream):
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                f = fingerprints_of([t.as_buffer() for t in part.column(1)], size, words, minima).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(f[:, w])) for w in range(len(names)))], names=[key, *names])

    return docs.select(key, text).mapInArrow(batches, f"`{key}` {dict(docs.dtypes)[key]}, " + ", ".join(f"{n} bigint" for n in names))


def pigeonhole_tables(radius: int, words: int = 1) -> list[list[int]]:
    """For each table its masks, one for each word: all pairs of radius + 2 blocks."""
    bits, blocks = 64 * words, radius + 2
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [[(a | b) >> (64 * w) & ((1 << 64) - 1) for w in range(words)] for a, b in combinations(masks, 2)]


def planes_of(f: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row i holds bit i of each, 64 fingerprints a word; missing ones are zeros."""
    n = len(f)
    padded = np.zeros((-(-n // 64) * 64, f.shape[1]), np.uint64)
    padded[:n] = f
    bits = np.unpackbits(np.ascontiguousarray(padded.astype("<u8")).view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


class Counters:
    """Bitwise counters of 64 distances a word, which add by carry-save; ``over`` has a bit for each beyond the radius."""

    def __init__(self, shape, radius: int):
        self.levels = max(1, radius.bit_length())
        start = (1 << self.levels) - 1 - radius  # so that a count beyond the radius carries out of the last level
        self.count = [np.full(shape, np.uint64(0xFFFFFFFFFFFFFFFF) if start >> k & 1 else np.uint64(0)) for k in range(self.levels)]
        self.held: list[np.ndarray | None] = [None] * self.levels
        self.over = np.zeros(shape, np.uint64)

    def add(self, x: np.ndarray, level: int = 0) -> None:
        if level == self.levels:
            self.over |= x
        elif self.held[level] is None:
            self.held[level] = x
        else:
            a, b = self.count[level], self.held[level]
            either = a ^ b
            self.count[level], self.held[level] = either ^ x, None
            self.add((a & b) | (either & x), level + 1)

    def close(self) -> np.ndarray:
        for level in range(self.levels):
            if (x := self.held[level]) is not None:
                self.held[level] = None
                carry = self.count[level] & x
                self.count[level] = self.count[level] ^ x
                self.add(carry, level + 1)
        return self.over


def near(planes: np.ndarray, queries: np.ndarray, radius: int, check: int = 8) -> np.ndarray:
    """For each query a row of words whose bits say which of the planes' fingerprints are within the radius."""
    counters = Counters((len(queries), planes.shape[1]), radius)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(len(planes)):
        bit = (queries[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        counters.add(planes[i][None, :] ^ (bit * full)[:, None])
        if i % check == check - 1 and i > radius and (counters.over == full).all():
            return np.zeros_like(counters.over)
    return ~counters.close()


def forest(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints: each that is no root, and its root."""
    n, planes = len(f), planes_of(f)
    step = max(1, (1 << 20) // planes.shape[1])
    links = np.concatenate([near(planes, f[i : i + step], radius) for i in range(0, n, step)])
    valid = np.packbits(np.arange(planes.shape[1] * 64) < n, bitorder="little").view("<u8")
    links &= valid
    alone = np.bitwise_count(links).sum(1) <= 1
    left, child, root = valid.copy(), [], []
    for i in np.flatnonzero(~alone):
        if not left[i // 64] >> np.uint64(i % 64) & np.uint64(1):
            continue
        front = np.array([i])
        left[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
        while len(front):
            found = np.bitwise_or.reduce(links[front], axis=0) & left
            left &= ~found
            front = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
            child.append(front)
            root.append(np.full(len(front), i))
    empty = np.empty(0, np.int64)
    return np.concatenate(child or [empty]), np.concatenate(root or [empty])


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (a[k], b[k]) are within the radius: planes of their differences, counted in the same way."""
    counters = None
    for plane in planes_of(a ^ b):
        counters = counters or Counters(plane.shape, radius)
        counters.add(plane)
    return np.unpackbits((~counters.close()).view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def compare(stream, words: int, radius: int):
    """Arrow batches (g, node, f0, ...) sorted by group g, in; links (a, b) of nodes of a group out. A group may span batches."""

    def links(group: np.ndarray, node: np.ndarray, f: np.ndarray):
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(starts, len(group)))
        own, at = np.repeat(sizes, sizes), np.arange(len(group))
        end = np.repeat(starts + sizes, sizes)
        for d in range(1, SMALL):
            i = at[(own <= SMALL) & (at + d < end)]
            if len(i):
                hit = i[near_pairs(f[i], f[i + d], radius)]
                yield node[hit], node[hit + d]
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            ids, first = np.unique(node[s : s + n], return_index=True)
            child, root = forest(f[s : s + n][first], radius)
            yield ids[child], ids[root]

    def batch(pairs):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs])) for k in (0, 1)], names=["a", "b"])

    rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, words), np.uint64)]
    for b in stream:
        new = [b.column(0).to_numpy(), b.column(1).to_numpy(), np.stack([b.column(2 + w).to_numpy() for w in range(words)], 1).view(np.uint64)]
        held = [np.concatenate(x) for x in zip(rest, new, strict=True)]
        g = held[0]
        if not len(g):
            continue
        cut = len(g) - int(np.argmax(g[::-1] != g[-1])) if g[0] != g[-1] else 0
        rest = [x[cut:] for x in held]
        if cut and (found := [p for p in links(*(x[:cut] for x in held)) if len(p[0])]):
            yield batch(found)
    if len(rest[0]) and (found := [p for p in links(*rest) if len(p[0])]):
        yield batch(found)


def links(keyed: DataFrame, prints: DataFrame, *, radius: int, words: int = 1, block: int = BLOCK) -> DataFrame:
    """keyed: distinct (node, k), a row for each table; prints: node and f0, f1, ..., a row for each node. Returns links (a, b)
    between nodes, enough to connect all that are within the radius of each other and share a k."""
    names = [f"f{w}" for w in range(words)]
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    held = keyed.join(sizes, "k").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    held = held.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("k", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "node")
    # the only word is the node itself; wide fingerprints come back once buckets of one are gone
    dealt = dealt.select("g", "node", F.col("node").alias("f0")) if words == 1 else dealt.join(prints, "node").select("g", "node", *names)
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(lambda stream: compare(stream, words, radius), "a bigint, b bigint")


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, words: int = 1, radius: int = 2, minima: int = 0, block: int = BLOCK) -> DataFrame:
    """key, f0, ..., component_id (least key of the component) for each row of ``docs``. minima: tables of least hashes, instead of
    the exact ones of the radius. A node is an id of a fingerprint: the only word, or a hash of several."""
    names = [f"f{w}" for w in range(words)]
    made = checkpointed(fingerprint(docs, key=key, text=text, size=size, words=words, minima=minima))
    made = made.withColumn("node", F.col("f0") if words == 1 else F.xxhash64(*names))
    classes = made.groupBy("node", *names).agg(F.min(key).alias("least"))
    if minima:
        keyed = made.select("node", F.explode(F.array(*(F.xxhash64(F.lit(m), f"m{m}") for m in range(minima)))).alias("k")).distinct()
    else:
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        # a table's number and its bits, hashed: a chance meeting of two keys only adds comparisons
        keys = [F.xxhash64(F.lit(t), *(F.col(n).bitwiseAND(F.lit(signed(m)).cast("bigint")) for n, m in zip(names, masks, strict=True) if m)) for t, masks in enumerate(pigeonhole_tables(radius, words))]
        keyed = classes.select("node", F.explode(F.array(*keys)).alias("k"))
    roots = connected_components(links(keyed, classes.select("node", *names), radius=radius, words=words, block=block))
    linked = classes.select("node", "least").join(roots, "node")
    joint = linked.join(linked.groupBy("root").agg(F.min("least").alias("joint")), "root").select("node", "joint")
    known = classes.join(joint, "node", "left").select(*names, F.coalesce("joint", "least").alias("component_id"))
    return made.join(known, names).select(key, *names, "component_id")


def simhash_links(docs: DataFrame, **options) -> DataFrame:
    """key, fingerprint (16 lowercase hex digits for each word) and component_id."""
    names = [f"f{w}" for w in range(options.get("words", 1))]
    key = options.get("key", "doc_id")
    return components(docs, **options).select(key, F.lower(F.concat(*(F.lpad(F.hex(n), 16, "0") for n in names))).alias("fingerprint"), "component_id")


#: For documents alike in at least 0.8 of their shingles of five words: fingerprints of 512 bits. A share j of common
#: shingles is a cosine of 2 j / (1 + j), so 0.8 lets 15 % of the bits differ, 78 of 512 with a deviation of 8. Five tables of
#: least hashes miss 0.03 % of such pairs.
ALIKE = {"size": 5, "words": 8, "radius": 84, "minima": 5}


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The columns of ``docs``, with one row of each group of near duplicates: the one of the least (key, hash of text), nulls
    first; of rows that repeat in both any one stays. Options are those of ``components``; without any, documents alike in 0.8 of
    their shingles of five words are near duplicates. Columns of any name pass: they are carried in one struct. The text is
    shuffled once, to meet the rows that stay."""
    options = options or ALIKE
    keyed = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("k"), F.col(text).alias("t"))
    found = components(keyed, key="k", text="t", **options)
    stay = checkpointed(found.where(F.col("k") == F.col("component_id")).groupBy("k").agg(F.count("*").alias("n")).select(F.col("k.k").alias("stay_k"), F.col("k.h").alias("stay_h"), "n"))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("h"))
    out = rows.join(stay.drop("n"), F.col("k").eqNullSafe(F.col("stay_k")) & (F.col("h") == F.col("stay_h")), "left_semi")
    if stay.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["k", "h"])
    return out.select("row.*")
