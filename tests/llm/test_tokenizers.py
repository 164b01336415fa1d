import base64
import hashlib
import random
import zlib
from collections import Counter as Bag

import numpy as np
import public_tokenizers as P
import pyarrow.fs
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from specflow.llm import byte_bpe, token_counts, token_files, units
from specflow.llm.byte_bpe import ByteBpe, merge_long
from specflow.llm.token_counts import Counter

from .conftest import rows_of

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return ByteBpe.of(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab '\n\t1.é\x1c\u3000 sd😀你") for _ in range(rng.randint(0, 60))) for _ in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_bpe_equals_the_library(own, library, text):
    ids = own.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_bpe_long_pieces(own, library):
    rng = random.Random(0)
    for n in (100, 700, 2500):
        piece = "".join(rng.choice("abcdefgh") for _ in range(n))
        want = library.encode_ordinary(piece)
        assert merge_long(piece.encode(), own.ranks).tolist() == want and np.frombuffer(own.encode([piece])[0], "<u4").tolist() == want


def test_bpe_rows(odd, empty, library):
    found = rows_of(byte_bpe.encode(odd, RANKS, P.PATTERN))
    assert Bag(r["doc_id"] for r in found) == Bag(r["doc_id"] for r in odd.collect())
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_counts_of_chunks_equal_those_of_whole_texts():
    tokenizer, counter = Tokenizer.from_file(JSON), Counter(JSON, chunk=300, overlap=8)
    texts = ["x" * 5000, " ".join(["ab"] * 300) + "y" * 900 + " z" * 400, " " * 2000 + "a", "<|endoftext|>" * 200, "ab <|endoftext|> cd" * 100, *("".join(random_texts(40, s)) for s in range(20))]
    found = counter.count(texts)
    assert [n for n, _ in found] == [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter.widened > 0 and max(chunks for _, chunks in found) > 3


def test_a_third_of_the_documents_is_spliced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokenizer, texts = Tokenizer.from_file(JSON), {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = rows_of(token_counts.count_tokens(docs, JSON))
    assert all(r["n_tokens"] == len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False)) for r in found)
    assert sum(r["n_chunks"] > 1 for r in found) > 0.3 * len(texts)


def test_units_of_parts_equal_those_of_whole_texts(monkeypatch, library):
    monkeypatch.setattr(units, "PART", 7)
    coder = units.UnitCoder(lambda us: [np.array(library.encode_ordinary(u), "<u4").tobytes() for u in us], most=40)
    texts = [*random_texts(300, 4), "ab cd\nef gh ij\nkl", "x" * 50 + " y" * 20, ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_counts_of_rows(odd, empty):
    tokenizer = Tokenizer.from_file(JSON)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows_of(token_counts.count_tokens(odd, JSON, chunk=1000)):
        n = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)
    assert token_counts.count_tokens(empty, JSON).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(odd, name):
    counter = Counter(P.path(name))
    texts = ["The cat sat.", "", "héllo  world\n"]
    assert counter.count(texts) == [(counter.whole([t])[0], 1) for t in texts]


def test_files_round_trip(odd, empty, tmp_path):
    tokenizer = Tokenizer.from_file(JSON)
    folder = f"file://{tmp_path}/t"
    files = token_files.write(odd, JSON, folder, frame_bytes=2000)
    found = rows_of(token_files.read(odd.sparkSession, folder, files, keep_ids=True))
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])] == [None, *sorted(r["doc_id"] for r in odd.collect() if r["doc_id"] is not None)]
    assert token_files.write_and_read(empty, JSON, folder=f"file://{tmp_path}/e").count() == 0


def test_files_are_zstandard_and_seekable(tmp_path):
    path = tmp_path / "a.zst"
    with open(path, "wb") as out:
        writer = token_files.Writer(out, frame_bytes=50)
        for k in range(20):
            writer.add(k, np.arange(k, dtype="<u4"))
        writer.close()
    assert len(zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(path.read_bytes())) > 0
    store = pyarrow.fs.LocalFileSystem()
    reader = token_files.Reader(store.open_input_file(str(path)))
    assert len(reader) > 3 and reader.documents([7, 19, 99])[7][0].tolist() == list(range(7))
    broken = bytearray(path.read_bytes())
    broken[len(broken) // 3] ^= 1
    path.write_bytes(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader = token_files.Reader(store.open_input_file(str(path)))
        for i in range(len(reader)):
            reader.frame(i)


def test_long_special_strings_at_every_edge(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = "<|" + "the end of it " * 14 + "|>"  # 200 characters
    own.add_special_tokens([special])
    path = f"{tmp_path}/own.json"
    own.save(path)
    counter = token_counts.Counter(path, 256, 32)
    assert counter.margin == 201 and counter.overlap >= 4 * 201 and counter.chunk >= 4 * counter.overlap
    words = "some words, and more of them; " * 400
    for at in range(counter.chunk - 420, counter.chunk + 30, 3):
        text = words[:at] + special + words
        assert counter.count([text])[0][0] == len(own.encode(text, add_special_tokens=False))


def test_ids_of_units_equal_the_library():
    from specflow.llm import hf

    own = hf.open_tokenizer(P.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    usual, odd_ = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x180)]], list("ʼǅ世😀​́ \x00\x85")
    units = ["".join(rng.choices(usual, k=rng.randint(1, 12))) for _ in range(3000)] + ["".join(rng.choices(usual[60:90] + odd_, k=rng.randint(1, 6))) for _ in range(500)] + ["don't", "it's'll", "a'S", "²½ªº", "x\xady"]
    units = [rng.choice([" ", "", "\n"]) + u for u in units]
    made = hf.UnitIds(own, most=500)
    assert [np.frombuffer(x, "<u4").tolist() for x in made(units)] == [own.encode(u, add_special_tokens=False).ids for u in units]
