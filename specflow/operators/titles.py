"""Titles: cleaning, normalising, exact and fuzzy duplicates."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .cells import Cells
from .order import numbered


def clean(title: Column) -> Column:
    t = F.trim(title)
    bad = (t == "") | t.endswith(".pdf") | t.contains("/") | t.contains("\\") | (F.length(t) < 10)
    for word in ("Microsoft Word", "untitled", "Untitled", "Document"):
        bad = bad | t.contains(word)
    return F.when(t.isNotNull() & ~bad, t)


def normalise(title: Column) -> Column:
    t = F.regexp_replace(F.lower(title), r"&#x[0-9a-f]+;|&[a-z]+;", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+", " "))


def exact_groups(docs: DataFrame, key: str, title: str) -> DataFrame:
    """key, duplicate_of (the first key of its group), size: groups of equal normalised titles, two at least."""
    named = docs.select(F.col(key).alias("k"), normalise(clean(F.col(title))).alias("t")).where("t is not null and t <> ''")
    groups = named.groupBy("t").agg(F.min("k").alias("duplicate_of"), F.count("*").alias("size")).where("size > 1")
    return named.join(groups, "t").select(F.col("k").alias(key), "duplicate_of", "size")


#: Letters of a normalised title, and how many of each have a bit of their own.
LETTERS, OWN = "abcdefghijklmnopqrstuvwxyz0123456789 ", 6
CODES = np.zeros(128, np.int64)
CODES[list(LETTERS.encode())] = np.arange(len(LETTERS))
#: Titles that cells are learned from (about as many, by a hash), cells at most, and titles compared with as many at once.
SAMPLE, CELLS, BLOCK = 1 << 14, 1024, 1024


class Titles:
    """Different normalised titles as numbers: how often each has each letter, with its length last, and bits, a bit for each of the
    first ``OWN`` of a letter, so that two titles differ in as many bits as one has letters that the other lacks, or fewer."""

    def __init__(self, titles: list[str]):
        self.titles, self.size = titles, np.array(list(map(len, titles)), np.int64)
        self.codes = CODES[np.frombuffer("".join(titles).encode("ascii"), np.uint8)]
        self.row = np.repeat(np.arange(len(titles)), self.size)
        k = len(LETTERS)
        counts = np.bincount(self.row * k + self.codes, minlength=len(titles) * k).reshape(-1, k)
        self.bag = np.concatenate([counts, self.size[:, None]], 1)
        own = (counts[:, :, None] > np.arange(OWN)).reshape(len(titles), -1)
        packed = np.packbits(own, axis=1)
        self.bits = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)

    def places(self) -> np.ndarray:
        """For each title and letter, a bit for each place among the first 64 that holds it."""
        at = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        out, near = np.zeros((len(self.titles), len(LETTERS)), np.uint64), at < 64
        np.bitwise_or.at(out, (self.row[near], self.codes[near]), np.uint64(1) << at[near].astype(np.uint64))
        return out

    def spelled(self) -> np.ndarray:
        """The codes of the first 64 characters, -1 after the end."""
        at = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        out, near = np.full((len(self.titles), 64), -1), at < 64
        out[self.row[near], at[near]] = self.codes[near]
        return out


def room(least: float, sizes):
    """How many characters two titles of these lengths in all may have outside of matching blocks."""
    return np.floor((1 - least) * sizes + 1e-9)


def common_letters(places: np.ndarray, spelled: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs (i of places, j of spelled), 64 characters at most each: a bit for each
    place of the first title, all pairs at a time."""
    v = np.full(len(i), ~np.uint64(0))
    for c in spelled[j].T:
        there = c >= 0
        if not there.any():
            break
        u = np.where(there, v & places[i, np.maximum(c, 0)], np.uint64(0))
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def alike(left: list, right: list | None, least: float):
    """left, right: [(key, title)], right None for left against itself. Yields (key, key, ratio), the smaller key first, of pairs alike in ``least``."""
    a, b = Titles([t for _, t in left]), Titles([t for _, t in (left if right is None else right)])
    ka, kb = [k for k, _ in left], [k for k, _ in (left if right is None else right)]
    sizes = a.size[:, None] + b.size
    apart = sum(np.bitwise_count(a.bits[:, w, None] ^ b.bits[:, w]).astype(np.int16) for w in range(a.bits.shape[1]))
    near = (apart <= room(least, sizes)) & (abs(a.size[:, None] - b.size) <= room(least, sizes))
    if right is None:
        near &= np.arange(len(a.size))[:, None] < np.arange(len(b.size))
    i, j = np.nonzero(near)
    places, spelled = a.places(), b.spelled()
    short = np.maximum(a.size[i], b.size[j]) <= 64
    for k in range(0, len(i), 1 << 17):
        p, q, s = i[k : k + (1 << 17)], j[k : k + (1 << 17)], short[k : k + (1 << 17)]
        enough = np.ones(len(p), bool)
        enough[s] = 2 * common_letters(places, spelled, p[s], q[s]) >= least * sizes[p[s], q[s]] - 1e-9
        found = sorted((x, y) if x < y else (y, x) for x, y in (((ka[m], a.titles[m]), (kb[n], b.titles[n])) for m, n in zip(p[enough].tolist(), q[enough].tolist())))
        found.sort(key=lambda pair: pair[1][1])
        matcher, last = SequenceMatcher(), None  # it keeps what it knows of its second text
        for (k1, t1), (k2, t2) in found:
            if t2 != last:
                matcher.set_seq2(last := t2)
            matcher.set_seq1(t1)
            if (ratio := matcher.ratio()) >= least:
                yield k1, k2, ratio


def classes(docs: DataFrame, key: str, title: str) -> DataFrame:
    """t, rep (its least key) and size for each different normalised title; rows without a key, or of whose title nothing is left,
    take no part."""
    named = docs.select(F.col(key).alias("k"), normalise(clean(F.col(title))).alias("t")).where("k is not null and t is not null and t <> ''")
    return named.groupBy("t").agg(F.min("k").alias("rep"), F.count("*").alias("size"))


def alike_classes(named: DataFrame, least: float = 0.85, *, sample: int = SAMPLE, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """named: t, rep, both different in each row. a, b, similarity: all pairs of representatives whose titles are alike in ``least``,
    the smaller one first, as the ratio depends on that.

    Titles are cut into cells by their letters. Two titles alike have few letters that the other lacks, so pairs of cells whose boxes
    lie further apart are left out; that is a table of cells, not of titles. Cells in blocks of bounded size meet block by block, where
    letters as bits, then common subsequences, leave the pairs whose ratio is taken. No table of candidate pairs is made.
    """
    spark = named.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    named = checkpointed(named.select("t", "rep"))
    kind = dict(named.dtypes)["rep"]
    part = min(1.0, sample / max(1, named.count()))
    few = [r["t"] for r in named.where(F.pmod(F.xxhash64("t"), F.lit(1 << 31)) <= int(part * (1 << 31))).select("t").limit(2 * sample).collect()]
    pairs_schema = f"a {kind}, b {kind}, similarity double"
    if not few:
        return spark.createDataFrame([], pairs_schema)
    tree = Cells(Titles(few).bag, min(cells, max(1, 2 * len(few) // block * 8)))

    def boxes(stream):
        for batch in stream:
            bag = Titles(batch.column(0).to_pylist()).bag
            cell = tree.of(bag)
            order = np.argsort(cell, kind="stable")
            met, at = np.unique(cell[order], return_index=True)
            low, high = (f.reduceat(bag[order], at, 0) for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(np.diff([*at, len(order)]))] + [pa.array(list(x), pa.list_(pa.int64())) for x in (low, high)], names=["cell", "n", "low", "high"])

    width = len(LETTERS) + 1
    parts = named.select("t").mapInArrow(boxes, "cell bigint, n bigint, low array<bigint>, high array<bigint>")
    found = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*(F.min(F.get("low", F.lit(i))) for i in range(width))).alias("low"), F.array(*(F.max(F.get("high", F.lit(i))) for i in range(width))).alias("high")).orderBy("cell").collect()  # a row a cell
    low, high = np.array([r["low"] for r in found]), np.array([r["high"] for r in found])
    parts_of = np.array([-(-r["n"] // block) for r in found])
    first = np.cumsum(parts_of) - parts_of
    near = []
    for i in range(len(found)):
        gap = np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i]))
        most = room(least, high[i, -1] + high[i:, -1])
        near += [(i, i + int(j)) for j in np.nonzero((gap[:, :-1].sum(1) <= most) & (gap[:, -1] <= most))[0]]
    block_of = dict(zip([r["cell"] for r in found], range(len(found))))

    def dealt(stream):
        for batch in stream:
            titles = batch.column(0).to_pylist()
            cell = np.array([block_of[c] for c in tree.of(Titles(titles).bag).tolist()])
            spread = batch.column(2).to_numpy() % parts_of[cell]
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + spread), batch.column(0), batch.column(1)], names=["block", "t", "rep"])

    held = named.select("t", "rep", F.pmod(F.xxhash64("t"), F.lit(1 << 30)).alias("h")).mapInArrow(dealt, f"block bigint, t string, rep {kind}")
    packed = checkpointed(held.groupBy("block").agg(F.collect_list(F.struct("rep", "t")).alias("rows")))  # about ``block`` rows each
    cells_near = spark.createDataFrame(pa.table({n: pa.array([v[k] for v in near], pa.int64()) for k, n in enumerate(("i", "j"))}))
    spans = F.array(*(F.struct(F.lit(int(f)).alias("from"), F.lit(int(f + n - 1)).alias("to")) for f, n in zip(first, parts_of)))
    of = lambda c: F.explode(F.sequence(F.get(spans, F.col(c))["from"], F.get(spans, F.col(c))["to"]))
    meet = cells_near.select("i", "j", of("i").alias("a")).select("a", of("j").alias("b")).where("a <= b")
    left, right = packed.select(F.col("block").alias("a"), F.col("rows").alias("left")), packed.select(F.col("block").alias("b"), F.col("rows").alias("right"))
    both = meet.join(left, "a").join(right, "b").select("left", F.when(F.col("a") < F.col("b"), F.col("right")).alias("right")).repartition(F.rand(1))

    def compared(stream):
        kind_of = None
        for batch in stream:
            kind_of = kind_of or batch.schema.field("left").type.value_type.field("rep").type
            for x, y in zip(*(batch.column(c).to_pylist() for c in range(2))):
                rows = list(alike([(r["rep"], r["t"]) for r in x], None if y is None else [(r["rep"], r["t"]) for r in y], least))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind_of), pa.array([r[1] for r in rows], kind_of), pa.array([r[2] for r in rows], pa.float64())], names=["a", "b", "similarity"])

    return both.mapInArrow(compared, pairs_schema)


def fuzzy_pairs(docs: DataFrame, key: str, title: str, least: float = 0.85, **options) -> DataFrame:
    """kind, a, b, similarity. ``member``: b is the least key of a's title, for every row; ``pair``: representatives, the smaller
    first, of titles alike in at least ``least``, all of them, however common their words are."""
    named = checkpointed(classes(docs, key, title))
    rows = docs.select(F.col(key).alias("k"), normalise(clean(F.col(title))).alias("t")).where("k is not null")
    member = rows.join(named, "t").select(F.lit("member").alias("kind"), F.col("k").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    return member.unionByName(alike_classes(named, least, **options).select(F.lit("pair").alias("kind"), "a", "b", "similarity"))


def star_groups(pairs: DataFrame) -> DataFrame:
    """pairs: a, b with a before b. (key, duplicate_of): in order, a title joins the first one that it resembles and that joined no
    other itself.

    In rounds: a title without undecided ones before it joins none, and all that it resembles after it join; a title is decided with
    its neighbours before it, so the order of all never runs through one task. Which it joins is known when all are decided.
    """
    edges = checkpointed(pairs.select("a", "b").distinct())
    left, joined, rounds = edges, [], 0
    while left.limit(1).count():
        rounds += 1
        centres = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        new = checkpointed(left.join(centres, "a", "left_semi").select("b").distinct())
        left = checkpointed(left.join(new, "b", "left_anti").join(new.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"))
        joined.append(new)
        if rounds % 8 == 0:
            joined = [checkpointed(reduce(DataFrame.unionByName, joined))]
    if not joined:
        return edges.select(F.col("b").alias("key"), F.col("a").alias("duplicate_of"))
    taken = reduce(DataFrame.unionByName, joined).select(F.col("b").alias("a"))
    return edges.join(taken, "a", "left_anti").groupBy(F.col("b").alias("key")).agg(F.min("a").alias("duplicate_of"))


def duplicates(docs: DataFrame, key: str, title: str, least: float = 0.85, **options) -> DataFrame:
    """key, is_duplicate, duplicate_of, duplicate_group for each row with a key: equal titles first, groups numbered by title; then, of
    titles that occur once, those alike, in the order of keys, numbered by the first of a group. 0 is no group."""
    named = checkpointed(classes(docs, key, title))
    equal = numbered(named.where("size > 1"), "t", "duplicate_group")
    rows = docs.select(F.col(key).alias("k"), normalise(clean(F.col(title))).alias("t")).where("k is not null")
    stars = checkpointed(star_groups(alike_classes(named.where("size = 1"), least, **options)))
    base = equal.count()
    centres = numbered(stars.select(F.col("duplicate_of").alias("first")).distinct(), "first", "n").select("first", (F.col("n") + base).alias("fuzzy_group"))
    near = stars.join(centres, F.col("duplicate_of") == F.col("first")).select(F.col("key").alias("k"), F.col("duplicate_of").alias("fuzzy_of"), "fuzzy_group")
    near = near.unionByName(centres.select(F.col("first").alias("k"), F.lit(None).cast(dict(near.dtypes)["fuzzy_of"]).alias("fuzzy_of"), "fuzzy_group"))
    out = rows.join(equal.select("t", "rep", "duplicate_group"), "t", "left").join(near, "k", "left")
    of = F.coalesce(F.when(F.col("k") != F.col("rep"), F.col("rep")), F.col("fuzzy_of"))
    return out.select(F.col("k").alias(key), of.isNotNull().alias("is_duplicate"), of.alias("duplicate_of"), F.coalesce("duplicate_group", "fuzzy_group", F.lit(0)).alias("duplicate_group"))
