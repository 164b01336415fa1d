"""Token ids in seekable binary files.

Format. A file is a sequence of independent zstandard frames, in ascending order of the documents in them, and ends with
two skippable frames, so that any zstandard reader can unpack it:

* data frame: ``<u4`` number of documents d, ``<u4`` bytes of one id (2 or 4), then d keys ``<i8``, d flags ``u1`` (1: the
  key is null), d numbers of ids ``<u8``, then the ids of the documents, one after the other. A frame holds whole
  documents, about ``FRAME_BYTES`` of ids, a longer document alone in one.
* directory, a skippable frame of magic 0x184D2A5D: for each data frame ``<u8`` its offset, ``<i8`` its first key, ``u1``
  whether that is null, ``<u8`` documents and ``<u8`` ids in it; then ``<u4`` data frames.
* seek table, a skippable frame of magic 0x184D2A5E as the public zstandard seekable format lays it down: for each data
  frame ``<u4`` compressed bytes, ``<u4`` decompressed bytes, ``<u4`` the low half of XXH64 of the decompressed bytes;
  then ``<u4`` data frames, one byte 0x80 (checksums are there), and ``<u4`` 0x8F92EAB1.

Readers find a document by the directory and unpack only its frame, whose checksum they verify.

Documents are dealt out by ranges of (key, text hash, row) and sorted within them, so the files in order are the corpus in
ascending key order, nulls first; rows that tie are equal rows or in order of their text's hash, and however many they are,
they spread over files. There are as many files as the bytes of text need. A task writes under a name of its own and the row
that it returns is what makes a file count, so a repeated or speculative attempt does no harm; what such attempts left is deleted.
Null texts count as empty; a document without ids still has its end id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, slices

#: Bytes of ids in a frame, and of text in a file, about.
FRAME_BYTES, FILE_BYTES = 1 << 20, 24 << 20
#: Units that a worker remembers: this operator's budget goes into encoding new ones.
UNITS = 800_000
SKIPPABLE_DIRECTORY, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
DIRECTORY = np.dtype([("offset", "<u8"), ("key", "<i8"), ("null", "u1"), ("docs", "<u8"), ("ids", "<u8")])
SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system of pyarrow and the path in it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes one file; documents come in ascending key order."""

    def __init__(self, out, width: int = 2, level: int = 1, frame_bytes: int = FRAME_BYTES):
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.at, self.directory, self.seek = 0, [], []
        self.keys, self.ids, self.size = [], [], 0
        self.n_docs = self.n_ids = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        if self.size and self.size + len(raw) > self.frame_bytes:
            self.flush()
        self.keys.append(key)
        self.ids.append(raw)
        self.size += len(raw)

    def flush(self) -> None:
        if not self.keys:
            return
        keys, null = np.array([k or 0 for k in self.keys], "<i8"), np.array([k is None for k in self.keys], "u1")
        counts = np.array([len(x) // self.width for x in self.ids], "<u8")
        data = struct.pack("<II", len(keys), self.width) + keys.tobytes() + null.tobytes() + counts.tobytes() + b"".join(self.ids)
        packed = self.pack(data)
        self.out.write(packed)
        self.directory.append((self.at, int(keys[0]), int(null[0]), len(keys), int(counts.sum())))
        self.seek.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.at += len(packed)
        self.n_docs += len(keys)
        self.n_ids += int(counts.sum())
        self.keys, self.ids, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        directory = np.array(self.directory, DIRECTORY).tobytes() + struct.pack("<I", len(self.directory))
        table = np.array(self.seek, SEEK).tobytes() + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        for magic, body in ((SKIPPABLE_DIRECTORY, directory), (SKIPPABLE_SEEK, table)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)


@dataclass
class Frame:
    keys: list[int | None]
    counts: np.ndarray
    ids: np.ndarray


class Reader:
    """Reads one file; the ends of it first, then only the frames that are asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        frames, flags, magic = struct.unpack("<IBI", self.part(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        n = frames * SEEK.itemsize
        self.seek = np.frombuffer(self.part(size - 9 - n, n), SEEK)
        end = size - 9 - n - 8
        n = frames * DIRECTORY.itemsize
        self.directory = np.frombuffer(self.part(end - 4 - n, n), DIRECTORY)

    def part(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.seek)

    def frame(self, i: int) -> Frame:
        entry = self.seek[i]
        data = zstandard.ZstdDecompressor().decompress(self.part(int(self.directory[i]["offset"]), int(entry["packed"])), max_output_size=int(entry["size"]))
        if len(data) != entry["size"] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != entry["sum"]:
            raise ValueError(f"frame {i}: its checksum is wrong")
        n, width = struct.unpack_from("<II", data)
        keys, null = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "u1", n, 8 + 8 * n)
        counts = np.frombuffer(data, "<u8", n, 8 + 9 * n)
        return Frame([None if x else int(k) for k, x in zip(keys, null, strict=True)], counts.astype(np.int64), np.frombuffer(data, "<u2" if width == 2 else "<u4", offset=8 + 17 * n))

    def documents(self, keys) -> dict[int, list[np.ndarray]]:
        """Ids of the documents with these keys; only frames that can hold one are unpacked."""
        first = [(-1, 0) if d["null"] else (0, int(d["key"])) for d in self.directory]
        wanted, out = set(keys), {}
        for i, low in enumerate(first):
            high = first[i + 1] if i + 1 < len(first) else (1, 0)
            here = {k for k in wanted if low <= (0, k) <= high}
            if here:
                frame = self.frame(i)
                ends = np.cumsum(frame.counts)
                for k, n, end in zip(frame.keys, frame.counts, ends, strict=True):
                    if k in here:
                        out.setdefault(k, []).append(frame.ids[end - n : end])
        return out


class Encoder:
    """A tokenizer file's ids of texts, with its number of ids."""

    def __init__(self, path: str):
        from .hf import UnitIds, open_tokenizer, splits_at_space
        from .units import UnitCoder

        self.tokenizer = open_tokenizer(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.coder = UnitCoder(UnitIds(self.tokenizer), UNITS) if splits_at_space(self.tokenizer) else None

    @staticmethod
    @lru_cache(maxsize=4)
    def of(path: str) -> Encoder:
        return Encoder(path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self.coder is None or any(a in t for a in self.added)]
        out = [None] * len(texts)
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4")
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, x in zip(rest, self.coder.encode([texts[i] for i in rest]), strict=True):
                out[i] = np.frombuffer(x, "<u4")
        return out


def write(docs: DataFrame, path: str, folder: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = 0, partitions: int | None = None, frame_bytes: int = FRAME_BYTES) -> list[dict]:
    """Writes the ids of all documents to files in ``folder``; returns, for each file in order, its name, documents, ids.

    path: the tokenizer file. end_id: appended to each document. The list has a row for each partition, so it is small.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // FILE_BYTES))
    if key == text:
        raise ValueError("the key and the text are the same column")
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumns({"h": F.xxhash64("t"), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(n, "k", "h", "row").sortWithinPartitions("k", "h").select("k", "t")

    run = uuid.uuid4().hex  # names this run's files

    def files(stream):
        from pyspark import TaskContext

        encoder = Encoder.of(path)
        store, at = opened(folder)
        store.create_dir(at, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"tokens-{run}-{part:06d}-{uuid.uuid4().hex[:12]}.zst"
        writer, end = None, np.array([] if end_id is None else [end_id], "<u4")
        with store.open_output_stream(f"{at}/{name}", compression=None) as out:
            writer = Writer(out, 2 if max(encoder.vocabulary, end_id or 0) <= 1 << 16 else 4, frame_bytes=frame_bytes)
            for batch in stream:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in slices(texts):
                    for k, ids in zip(keys[a:b], encoder.encode(texts[a:b]), strict=True):
                        writer.add(k, np.concatenate([ids, end]))
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())], names=["part", "name", "docs", "ids"])

    made = [r.asDict() for r in sorted(dealt.mapInArrow(files, "part bigint, name string, docs bigint, ids bigint").collect(), key=lambda r: r["part"])]
    store, at = opened(folder)
    for file in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if file.base_name.startswith(f"tokens-{run}-") and file.base_name not in {f["name"] for f in made if f["docs"]}:
            store.delete_file(file.path)
    return [f for f in made if f["docs"]]


def read(spark: SparkSession, folder: str, files: list[dict], *, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row for each document in the files: its key, start (ids before it), n_tokens, ids_crc32, and ``ids`` if asked for.

    A task reads one file, a frame at a time.
    """
    starts = np.cumsum([0, *(f["ids"] for f in files)])
    listed = spark.createDataFrame([(f["name"], int(s)) for f, s in zip(files, starts, strict=False)], "name string, start bigint").repartition(max(1, len(files)))

    def documents(stream):
        store, at = opened(folder)
        for batch in stream:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{name}") as file:
                    reader = Reader(file)
                    for i in range(len(reader)):
                        frame = reader.frame(i)
                        wide = frame.ids.astype("<u4")
                        ends = np.cumsum(frame.counts)
                        sums = [zlib.crc32(wide[e - n : e]) for n, e in zip(frame.counts, ends, strict=True)]
                        columns = [pa.array(frame.keys, pa.int64()), pa.array(start + ends - frame.counts, pa.int64()), pa.array(frame.counts, pa.int64()), pa.array(sums, pa.int64())]
                        names = [key, "start", "n_tokens", "ids_crc32"]
                        if keep_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(wide.astype(np.int32))))
                            names.append("ids")
                        start += int(ends[-1])
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return listed.mapInArrow(documents, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def write_and_read(docs: DataFrame, path: str, *, folder: str | None = None, **options) -> DataFrame:
    """Writes the ids of all documents to files below the shared folder (or in ``folder``) and reads them back."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    return read(spark, folder, write(docs, path, folder, **options), key=options.get("key", "doc_id"))
