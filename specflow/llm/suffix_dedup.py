"""Exact substring de-duplication: bytes covered by a string of ``LENGTH`` bytes that also starts anywhere else go.

Suffixes of all texts are compared at sampled places only, in a way that loses no repeat:

1. Anchors. Each string of LENGTH bytes picks the place within it whose K bytes hash lowest (the leftmost of equals), so
   equal strings pick the same place, about one place in 85. An anchor's context is what a string that picks it can reach:
   LENGTH - K bytes before it and LENGTH bytes from it on, cut at the document's edges.
2. Counts, combined before they are shuffled, drop anchors whose K bytes are nowhere else; contexts that are the same are one
   kind with a number, so copies come once.
3. One context of each kind is fetched. Their suffixes, the bytes from the anchor on, are range-partitioned by sampled splitters
   into buckets of about ``BUCKET`` bytes, as many as the contexts need. Suffixes with the same K bytes fall into one bucket unless
   there are more than a bucket holds of them: such a group is spread by all of its suffixes' bytes, and of equal suffixes by the
   reversed text before the anchor, so that no run of equals has to fit one bucket.
4. A bucket sorts its suffixes, and the reversed texts before them, by multikey quicksort over characters of 8 bytes, and
   the lengths of common prefixes of neighbours tell, for every l, which contexts share both l bytes before the anchor and
   LENGTH - l from it on. The least and the greatest such l bound the repeated bytes around it.
5. Groups that a boundary cuts are compared across boundaries: a bucket hands on, once for all its contexts, each string that a
   suffix beyond its edges may have too, by hash, with its number; those that it has once only ask whether another bucket has them.

Hashes of contexts and strings have 64 bits. Matches never cross documents. Null and empty texts have no bytes; texts below
LENGTH bytes lose none. Rows that repeat are copies of each other like any other two; a row is known by its key and a hash of
64 bits of its text, so keys may repeat or be null. A long document is processed in pieces. Columns of any name pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import bounded_batches, column, scratch

LENGTH, K = 200, 32
BEFORE = LENGTH - K
#: Bytes of contexts that a bucket takes, about.
BUCKET = 16 << 20
#: Bytes of text in a piece that is searched for anchors at once.
PIECE = 1 << 20
TABLE = np.random.default_rng(11).integers(1, 1 << 32, 256, dtype=np.uint32)
ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def lowest(text: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Anchors in concatenated texts; valid[i]: the string of LENGTH bytes from i on is within one text."""
    h = TABLE[text]
    for level in range(5):  # to the hash of 32 bytes, by doubling
        step = 1 << level
        h = h[:-step] * np.uint32(ODD[level]) + h[step:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    best = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= BEFORE + 1:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = BEFORE + 1 - width
    best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)[valid[: len(best)]]
    return at[np.diff(at, prepend=-1) != 0]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, place) of each anchor."""
    pieces = [(i, s, t[s : s + PIECE + LENGTH - 1]) for i, t in enumerate(texts) if len(t) >= LENGTH for s in range(0, max(1, len(t) - LENGTH + 1), PIECE)]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    group: list = []
    size = 0
    for k, p in enumerate(pieces):
        group.append(p)
        size += len(p[2])
        if size >= PIECE or k == len(pieces) - 1:
            joined = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
            ends = np.cumsum([len(x[2]) for x in group])
            starts = ends - [len(x[2]) for x in group]
            valid = np.ones(len(joined), bool)
            for e in ends:
                valid[e - LENGTH + 1 : e] = False
            at = lowest(joined, valid)
            which = np.searchsorted(ends, at, "right")
            place = at - starts[which] + np.array([x[1] for x in group])[which]
            owner = np.array([x[0] for x in group])[which]
            out.append((owner, place))
            group, size = [], 0
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner, place = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    new = (np.diff(owner, prepend=-1) != 0) | (np.diff(place, prepend=-1) > 0)  # pieces overlap, those of two groups too
    return owner[new], place[new]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, h (a text's hash, for keys that repeat), bytes."""
    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.coalesce(F.encode(text, "utf-8"), F.lit(b"")).alias("t"))


def packed(docs: DataFrame) -> DataFrame:
    """The same columns with each t compressed, for a shuffle: that takes less disk than what Spark does to a block."""

    def batches(stream):
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for batch in stream:
            at = batch.schema.get_field_index("t")
            yield batch.set_column(at, "t", pa.array([pack(t) for t in batch.column(at).to_pylist()], pa.binary()))

    return docs.mapInArrow(batches, docs.schema)


def unpacked_one(t: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(t.as_buffer())


def anchor_rows(docs: DataFrame) -> DataFrame:
    """docs as ``keyed`` has them. Returns key, h, pos, kh, ch: hashes of an anchor's K bytes and of its context."""
    kind = dict(docs.dtypes)["key"]
    digest = xxhash.xxh3_64_intdigest

    def batches(stream):
        for batch in stream:
            texts = batch.column(2).to_pylist()
            owner, place = anchors(texts)
            kh, ch = [], []
            for i, a in zip(owner.tolist(), place.tolist(), strict=True):
                t = texts[i]
                kh.append(digest(t[a : a + K]))
                before = min(a, BEFORE)
                ch.append(digest(t[a - before : a + LENGTH], before))
            take = pa.array(owner)
            hashed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (kh, ch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(place.astype(np.int32)), *hashed], names=["key", "h", "pos", "kh", "ch"])

    return docs.mapInArrow(batches, f"key {kind}, h bigint, pos int, kh bigint, ch bigint")


def contexts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted: key, h, and at, an array of (pos, n, large). Returns n, large, suffix, before (reversed)."""
    joined = wanted.alias("w").join(packed(docs).alias("d"), F.col("w.key").eqNullSafe(F.col("d.key")) & (F.col("w.h") == F.col("d.h"))).select("w.key", "w.h", "w.at", "d.t")
    schema = {"n": pa.int64(), "large": pa.bool_(), "suffix": pa.binary(), "before": pa.binary()}

    def batches(stream):
        last = None
        for batch in stream:
            rows = []
            for key, h, at, t in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (key, h) == last:  # rows that repeat follow each other
                    continue
                last, whole = (key, h), unpacked_one(t)
                for x in at:
                    a = x["pos"]
                    rows.append((x["n"], x["large"], whole[a : a + LENGTH], whole[max(0, a - BEFORE) : a][::-1]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.values(), strict=True)], names=list(schema))

    return joined.mapInArrow(batches, "n bigint, large boolean, suffix binary, before binary")


def hashes(suffix: bytes, before: bytes) -> tuple[int, int]:
    """kh and ch of an anchor, from its context."""
    kh, ch = xxhash.xxh3_64_intdigest(suffix[:K]), xxhash.xxh3_64_intdigest(before[::-1] + suffix, len(before))
    return kh - (kh >> 63 << 64), ch - (ch >> 63 << 64)


def matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of big-endian words of 8 bytes, zeros behind, and their lengths."""
    length = np.array([len(s) for s in strings], np.int64)
    wide = -(-width // 8) * 8
    cells = np.zeros((len(strings), wide), np.uint8)
    cells[np.arange(wide) < length[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return cells.view(">u8").astype(np.uint64), length


def multikey_sort(words: np.ndarray, length: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Order of rows by group, then words, then length, by multikey quicksort: a segment of rows that agree in all words before
    its depth is split by one word into those below a pivot, equal to it and above it; the equal ones go on with the next word.
    All segments are split at once, a round each."""
    cells = np.concatenate([words, length.astype(np.uint64)[:, None]], 1)
    order = np.arange(len(cells)) if group is None else np.argsort(group, kind="stable")
    if len(order) < 2:
        return order
    start = np.zeros(1, np.int64) if group is None else np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
    size, depth = np.diff(np.append(start, len(order))), np.zeros(len(start), np.int64)
    while True:
        open_ = (size > 1) & (depth < cells.shape[1])
        start, size, depth = start[open_], size[open_], depth[open_]
        if not len(start):
            return order
        segment = np.repeat(np.arange(len(start)), size)
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) - first[segment] + start[segment]
        rows = order[at]
        value = cells[rows, depth[segment]]
        pivot = np.sort(np.stack([value[first], value[first + size // 2], value[first + size - 1]]), axis=0)[1][segment]
        side = 3 * segment + (value > pivot) + (value >= pivot)
        by = np.argsort(side, kind="stable")
        order[at] = rows[by]
        new = np.flatnonzero(np.diff(side[by], prepend=-1))
        kind = side[by][new]
        start, size, depth = at[new], np.diff(np.append(new, len(by))), depth[kind // 3] + (kind % 3 == 1)


def common(words: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the one before it in order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = words[order[:-1]], words[order[1:]]
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), words.shape[1])
    at = np.minimum(first, words.shape[1] - 1)
    x = np.take_along_axis(a, at[:, None], 1)[:, 0] ^ np.take_along_axis(b, at[:, None], 1)[:, 0]
    same = np.zeros(len(x), np.int64)
    for byte in range(7):  # equal leading bytes of the first word that differs
        same += (x >> np.uint64(8 * (7 - byte))) == 0
    out[1:] = np.minimum(np.where(first < words.shape[1], 8 * first + same, 8 * first), np.minimum(length[order[:-1]], length[order[1:]]))
    return out


def reach(lcp: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """For rows in order: how many bytes each has in common with the first or the last row of its group, whichever are more."""
    out = np.zeros(len(lcp), np.int64)
    starts = np.flatnonzero(np.diff(lead, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(lcp)), strict=True):
        inner = np.append(LENGTH, lcp[a + 1 : b])
        first = np.minimum.accumulate(inner)
        last = np.append(np.minimum.accumulate(inner[:0:-1])[::-1], LENGTH)
        out[a:b] = np.maximum(first, last)
    return out


def repeated(suffixes: list[bytes], befores: list[bytes], n: np.ndarray, large: np.ndarray):
    """For each context the least and the greatest l for which its string of LENGTH bytes from l before the anchor on is
    repeated, -1 if for none; then (row, l, number) of the different strings of large groups that may be elsewhere too. n: how often a
    context is there."""
    m = len(suffixes)
    s, s_len = matrix(suffixes, LENGTH)
    b, b_len = matrix(befores, BEFORE)
    order = multikey_sort(s, s_len)
    lcp = common(s, s_len, order)
    lead = np.empty(m, np.int64)
    lead[order] = np.cumsum(lcp < K)
    back = multikey_sort(b, b_len, lead)
    lcp_back = common(b, b_len, back)
    lcp_back[np.diff(lead[back], prepend=-1) != 0] = -1
    far = np.full(m, -1)
    if large.any():
        far[order] = reach(lcp, lead[order])
        far[~large] = -1
    least, most = np.full(m, -1), np.full(m, -1)
    right, left = np.empty(m, np.int64), np.empty(m, np.int64)
    strings = []
    for l in range(BEFORE + 1):  # noqa: E741
        rows = np.flatnonzero((b_len >= l) & (s_len >= LENGTH - l))
        if not len(rows):
            continue
        right[order] = np.cumsum(lcp < LENGTH - l)
        left[back] = np.cumsum(lcp_back < l)
        kind = right[rows] * (m + 1) + left[rows]
        by = np.argsort(kind, kind="stable")
        starts = np.flatnonzero(np.diff(kind[by], prepend=-1))
        total = np.add.reduceat(n[rows][by], starts)
        hit = rows[by[np.repeat(total > 1, np.diff(np.append(starts, len(by))))]]
        least[hit] = np.where(least[hit] < 0, l, least[hit])
        most[hit] = l
        one = rows[by[starts]]
        over = far[one] >= LENGTH - l
        strings.append((one[over], np.full(over.sum(), l), total[over]))
    joined = [np.concatenate(x) for x in zip(*strings, strict=True)] if strings else [np.empty(0, np.int64)] * 3
    return least, most, joined


def in_buckets(context: DataFrame, buckets: int) -> DataFrame:
    """kh, ch, least, most of the contexts with a string that is repeated in their range-partitioned bucket; and, with least null,
    the strings that may be in several buckets: kh, w (hash), n (their number in the bucket), and ch and l if that is one."""
    names = ["kh", "ch", "least", "most", "w", "n", "l"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def bucket(stream):
        batches = [b for b in stream if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        suffixes, befores, n = t.column("suffix").to_pylist(), t.column("before").to_pylist(), t.column("n").to_numpy()
        least, most, (row, at, total) = repeated(suffixes, befores, n, t.column("large").to_numpy())
        hit = np.flatnonzero(most >= 0)
        own = np.array([hashes(suffixes[i], befores[i]) for i in hit], np.int64).reshape(-1, 2)
        solved = [own[:, 0], own[:, 1], least[hit].astype(np.int32), most[hit].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, solved), *(pa.nulls(len(hit), k) for k in kinds[4:])], names=names)
        known = {i: hashes(suffixes[i], befores[i]) for i in np.unique(row).tolist()}
        for start in range(0, len(row), 50_000):
            rows = []
            for i, l, count in zip(row[start : start + 50_000].tolist(), at[start : start + 50_000].tolist(), total[start : start + 50_000].tolist(), strict=True):
                kh, ch = known[i]
                string = befores[i][:l][::-1] + suffixes[i][: LENGTH - l]
                rows.append((kh, ch if count == 1 else None, None, None, xxhash.xxh3_64_intdigest(string, l) - (1 << 63), count, l))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    prefix, rest = F.substring("suffix", 1, K), [F.when(F.col("large"), F.col(c)) for c in ("suffix", "before")]
    return context.repartitionByRange(buckets, prefix, *rest).mapInArrow(bucket, "kh bigint, ch bigint, least int, most int, w bigint, n bigint, l int")


def across_boundaries(strings: DataFrame) -> DataFrame:
    """kh, ch, least, most of the contexts that asked for a string which another bucket has. A string's hash has its l in it, so with
    the hash of the K bytes it stands for both."""
    total = F.sum("n").over(Window.partitionBy("kh", "w"))  # at most one row for each bucket
    asked = strings.withColumn("total", total).where("ch is not null and total > 1")
    return asked.groupBy("kh", "ch").agg(F.min("l").alias("least"), F.max("l").alias("most"))


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, read again from the shared folder: a join with them has an exchange of its own on both sides, which adaptive
    execution can split, and lineage ends."""
    at = scratch(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def repeated_spans(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs as ``keyed`` has them. Returns key, h and spans, an array of (start, stop) that cover the repeated bytes; they may
    overlap. Documents without any are not returned."""
    found = anchor_rows(docs)
    again = written(found.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1").select("kh"), "repeated-anchors")
    found = written(found.join(again, "kh"), "anchors")
    kinds = found.groupBy("kh", "ch").agg(F.count("*").alias("n"), F.min(F.struct("key", "h", "pos")).alias("first"))
    large = kinds.groupBy("kh").agg(F.count("*").alias("kinds")).where(F.col("kinds") > bucket // (LENGTH + BEFORE)).select("kh", F.lit(True).alias("large"))
    wanted = kinds.join(written(large, "large-groups"), "kh", "left").select("n", F.coalesce("large", F.lit(False)).alias("large"), "first.*")
    wanted = written(wanted.groupBy("key", "h").agg(F.collect_list(F.struct("pos", "n", "large")).alias("at")), "wanted")
    size = (wanted.agg(F.sum(F.size("at"))).first()[0] or 0) * (LENGTH + BEFORE)
    compared = written(in_buckets(contexts(wanted, docs), max(1, -(-size // bucket))), "compared")
    solved = compared.where("least is not null").select("kh", "ch", "least", "most").unionByName(across_boundaries(compared.where("least is null")))
    solved = solved.groupBy("kh", "ch").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    spans = found.join(written(solved, "solved"), ["kh", "ch"])
    span = F.struct(F.greatest(F.lit(0), F.col("pos") - F.col("most")).alias("a"), (F.col("pos") + LENGTH - F.col("least")).alias("b"))
    return written(spans.groupBy("key", "h").agg(F.collect_set(span).alias("spans")), "spans")


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], min(size, x["b"])) for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(t: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(t)]
    return b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(t: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs shrunk to the characters that lie wholly in them, for UTF-8."""
    out = []
    for a, b in runs:
        while a < b and t[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(t) and t[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, a struct of the columns of ``docs`` but the text, its bytes as t, whether there is a text, and the spans found in it."""
    rest = [c for c in docs.columns if c != text]
    row = F.struct(*(column(c) for c in rest)) if rest else F.lit(None).cast("struct<none:int>")
    wide = docs.select(row.alias("row"), F.col(text).isNotNull().alias("some"), F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.coalesce(F.encode(text, "utf-8"), F.lit(b"")).alias("t"))
    spans = repeated_spans(keyed(docs, key, text))
    return packed(wide).alias("d").join(spans.alias("s"), F.col("d.key").eqNullSafe(F.col("s.key")) & (F.col("d.h") == F.col("s.h")), "left").select("d.row", "d.some", "d.t", "s.spans")


def digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def batches(stream):
        for batch in stream:
            rows = []
            for packed_text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                t = unpacked_one(packed_text)
                runs = merged(spans or [], len(t))
                rows.append((len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(t, runs)).hexdigest()))
            n, gone, count, sums = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(docs.select(key, text), key, text).select(F.col("row")[key].alias("key"), "t", "spans")
    return found.mapInArrow(batches, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs``, repeated strings cut out of the text. Only whole characters go, so texts stay UTF-8; a null
    text stays null."""
    bounded_batches(docs.sparkSession)
    if text not in docs.columns:
        raise ValueError(f"no column {text}")
    found = with_spans(docs, key, text)

    def batches(stream):
        for batch in stream:
            out = []
            for some, packed_text, spans in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                t = unpacked_one(packed_text) if some else None
                out.append(kept_bytes(t, whole_characters(t, merged(spans, len(t)))) if spans else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["row", "t"])

    cut = found.mapInArrow(batches, StructType([found.schema["row"], StructField("t", StringType())]))
    return cut.select(*((F.col("t") if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
