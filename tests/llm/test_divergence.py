"""The audit of sources against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from specflow.llm import divergence


def brute(rows, least=30, top=50):
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(divergence.TERM, t or "")]
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, w = lang or "", source or "", words(text)
        n[lang, source].update(w)
        docs[lang].update(set(w))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= least)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[u] for u in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x[2], -x[0], k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, x in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard", [10**6, 20])
def test_counts(spark, monkeypatch, shard):
    rng = random.Random(4)
    vocabulary = ["The", "the", "Été", "été", "cat", "d'or", "x1y", "你好", "rare", *map(chr, range(97, 117))]
    rows = []
    for i in range(200):
        w = rng.choices(vocabulary, k=rng.randint(0, 40))
        rows.append((" ".join(w), rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "S3", "é", None]), i, "x"))
    rows += [rows[0], rows[0], (None, "en", "only nulls", 1, ""), ("", "zz", "a", 1, ""), ("b", "zz", "c", 1, ""), ("12 3", "alone", "a", 1, ""), ("word " * 400, "en", "s2", 1, "")]
    df = spark.createDataFrame(rows, "text string, lang string, source string, n int, term string").repartition(3)
    got = divergence.audit(df, least_docs=12, shard=shard, top=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute([r[:3] for r in rows], 12, 7)
    assert divergence.audit(df.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    import pyarrow as pa

    text = "abcdefgh ijk lm n1opqrs   tuvwxyzabcdefghijklmnop q " + "é" * 40
    assert "".join(divergence.pieces(text)) == text and len(list(divergence.pieces(text))) > 2
    batch = pa.RecordBatch.from_arrays([pa.array(["l", "l"]), pa.array(["s", "s"]), pa.array([text + " lm", "lm"])], names=["lang", "source", "text"])
    got = {r["term"]: (r["n"], r["docs"]) for b in divergence.counted([batch]) for r in b.to_pylist()}
    assert got.pop("") == (0, 0) and got == {**{w: (1, 1) for w in re.findall(divergence.TERM, text)}, "lm": (3, 2)}
