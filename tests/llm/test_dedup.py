import hashlib
import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import xxhash

from specflow.llm import simhash, suffix_dedup
from specflow.llm.components import connected_components

from .conftest import rows_of


def plain_fingerprint(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    made = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def check_simhash(df, **options):
    docs = df.collect()
    prints = [plain_fingerprint(r["text"]) for r in docs]
    groups = defaultdict(list)
    for r, c in zip(docs, plain_components(prints)):
        groups[c].append(r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{p:016x}", str(min((k for k in groups[c] if k is not None), default=None))) for r, p, c in zip(docs, prints, plain_components(prints)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows_of(simhash.simhash_links(df, **options))) == want


def test_simhash_odd_rows(odd, empty):
    check_simhash(odd)
    assert simhash.simhash_links(empty).count() == 0


def test_simhash_blocks_of_large_buckets(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") * 3 + str(rng.randint(0, 99)) for _ in range(400)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(400)] = "new" + str(rng.randint(0, 9))
        rows.append((i, " ".join(words)))
    check_simhash(spark.createDataFrame(rows, "doc_id bigint, text string"), block=16)


def test_bit_slices_equal_counts():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**63, (300, 4)).astype(np.uint64)
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    for radius in (1, 2, 100, 118, 127, 128):
        got = np.unpackbits(simhash.near(simhash.planes_of(f), f, radius).view(np.uint8), axis=1, bitorder="little")[:, :300]
        assert (got == (d <= radius)).all()
    assert (simhash.near_pairs(f[:99], f[1:100], 120) == (d[np.arange(99), np.arange(1, 100)] <= 120)).all()


def test_runs_of_a_text_equal_the_whole(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("aB \n\t é") for _ in range(rng.randint(0, 90))).encode() for _ in range(200)] + [b"x" * 300, b" " * 100, b"a" * 64 + b" b", None]
    want = simhash.fingerprints_of(texts, 3, 2, 2)
    assert [f"{x:016x}" for x in want[:, 0]] == [f"{plain_fingerprint((t or b'').decode()):016x}" for t in texts]
    for run, hashed in ((1, 1), (7, 5), (64, 1 << 16)):
        monkeypatch.setattr(simhash, "RUN", run)
        monkeypatch.setattr(simhash, "HASHED", hashed)
        assert (simhash.fingerprints_of(texts, 3, 2, 2) == want).all()


def test_a_very_long_text_takes_little_memory():
    code = """
import resource, pyarrow as pa
from specflow.llm import simhash
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = pa.array([" ".join(str(i) for i in range(7_000_000))])
simhash.fingerprints_of([t.as_buffer() for t in text], 5, 8, 5)
print(len(text[0].as_buffer()) >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    text_mb, used_mb = map(int, said.stdout.split())
    assert text_mb >= 50 and used_mb < 500


def test_keep_one_passes_columns_of_any_name(spark):
    names = ["k", "h", "row", "n", "_k", "_t", "_h", "stay_k", "stay_h", "_stay_k", "f0", "node", "component_id", "a.b", "text"]
    rows = [(i, *[f"{i}-{c}" for c in names[:-1]], f"a text of its own kind {i} " * 9) for i in (1, 1, 2)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id bigint", *(f"`{c}` string" for c in names)]))
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [tuple(rows[0]), tuple(rows[2])]


def test_keep_one(spark, odd, empty):
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 500)) for _ in range(n)]
    a, b = words(300), words(300)
    near = list(a)
    near[150] = "changed"
    rows = [(1, " ".join(b), 1), (2, " ".join(near), 1), (3, " ".join(a), 1), (4, " ".join(a), 1), (4, " ".join(a), 1), (9, " ".join(words(200)), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    assert sorted(r["doc_id"] for r in rows_of(simhash.keep_one(df))) == [1, 2, 9]
    same = spark.createDataFrame([(4, " ".join(a), 1), (4, " ".join(a), 1)], "doc_id bigint, text string, n int")
    assert simhash.keep_one(same).count() == 1
    assert simhash.keep_one(empty).count() == 0 and simhash.keep_one(odd).count() <= odd.count()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {r["node"]: r["root"] for r in rows_of(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")))}
    assert got == {v: find(v) for v in linked}


def plain_cover(texts):
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - 199):
            seen[t[p : p + 200]].append((i, p))
    out = [np.zeros(len(t) + 1, bool) for t in texts]
    for v in seen.values():
        if len(v) > 1:
            for i, p in v:
                out[i][p : p + 200] = True
    return out


def repeating_texts(seed=3, n=40):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé") for _ in range(2500))
    out = []
    for _ in range(n):
        t = "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 700)))
        for _ in range(rng.randint(0, 2)):
            s, k, p = rng.randint(0, 2000), rng.randint(120, 500), rng.randint(0, len(t))
            t = t[:p] + base[s : s + k] + t[p:]
        out.append(t)
    return [*out, "a" * 700, "ab" * 300, out[1], out[1] + "z", "", None]


def check_spans(df):
    docs = df.collect()
    want = []
    for r, c in zip(docs, plain_cover([(r["text"] or "").encode() for r in docs])):
        t = np.frombuffer((r["text"] or "").encode(), np.uint8)
        want.append((str(r["doc_id"]), len(t), int(c.sum()), int((np.diff(c.astype(int), prepend=0) == 1).sum()), hashlib.sha256(t[~c[:-1]].tobytes()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(suffix_dedup.digest(df))]
    assert sorted(got) == sorted(want)


def test_suffix_dedup(spark, odd, empty):
    check_spans(spark.createDataFrame(list(enumerate(repeating_texts())), "doc_id bigint, text string"))
    check_spans(odd)
    assert suffix_dedup.digest(empty).count() == 0


def test_groups_cut_by_boundaries_are_compared_across_them(spark):
    df = suffix_dedup.keyed(spark.createDataFrame(list(enumerate(repeating_texts())), "doc_id bigint, text string"), "doc_id", "text")
    found = []
    for bucket in (400, 2000, 10**9):  # one context a bucket, about five, and all of them in one
        spans = suffix_dedup.repeated_spans(df, bucket).collect()
        found.append(sorted((r["key"], tuple(suffix_dedup.merged(r["spans"], 10**9))) for r in spans))
    assert found[0] == found[1] == found[2] and found[0]


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(3)
    rows = [bytes(rng.integers(97, 99, rng.integers(0, 40)).astype(np.uint8)) for _ in range(500)] + [b"a" * 40] * 5
    words, length = suffix_dedup.matrix(rows, 40)
    assert [rows[i] for i in suffix_dedup.multikey_sort(words, length)] == sorted(rows)
    group = rng.integers(0, 7, len(rows))
    assert [(group[i], rows[i]) for i in suffix_dedup.multikey_sort(words, length, group)] == sorted(zip(group, rows))
    assert len(suffix_dedup.multikey_sort(words[:0], length[:0])) == 0


def test_null_and_repeated_keys_keep_texts_apart(spark):
    texts = [f"{i} " + "".join(random.Random(i).choice("abcdefg ") for _ in range(260)) for i in range(300)]
    rows = [(None, t) for t in texts] + [(1, t[:250] + "!") for t in texts[:20]] + [(1, texts[0])] * 40
    check_spans(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_removal_passes_columns_of_any_name(spark):
    names = ["row", "t", "key", "h", "some", "spans", "d", "s", "c0", "pos", "a.b", "text"]
    rows = [(i, *[f"{i}-{c}" for c in names[:-1]], f"text {i}") for i in (1, 2)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id bigint", *(f"`{c}` string" for c in names)]))
    got = suffix_dedup.remove(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == rows


def test_removal_keeps_characters_whole(spark):
    texts = repeating_texts(8)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, spans int")
    got = {r["doc_id"]: r for r in rows_of(suffix_dedup.remove(df))}
    assert len(got) == len(texts) and got[len(texts) - 1]["text"] is None and all(r["spans"] == 7 for r in got.values())
    assert any(len(got[i]["text"] or "") < len(t or "") for i, t in enumerate(texts))


def test_anchors_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(9000)).encode()
    whole = suffix_dedup.anchors([text])[1].tolist()
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert suffix_dedup.anchors([text])[1].tolist() == whole


def test_unique_text_of_several_pieces_stays(spark):
    text = np.random.default_rng(2).integers(97, 123, (2 << 20) + 5000).astype(np.uint8).tobytes().decode()
    got = rows_of(suffix_dedup.digest(spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == {1: (len(text), 0, 0), 2: (5, 0, 0)}
