import math
import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from specflow.functions import models, special, text
from specflow.operators import clusters, statistics, tags, titles, transitions


def test_tails():
    assert math.isclose(special.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(special.t_two_sided(2.228138851964939, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(special.f_tail(4.102821, 2, 10), 0.05, rel_tol=1e-5)
    assert math.isclose(special.fisher_two_sided(8, 2, 1, 5), 0.034965034965, rel_tol=1e-9)
    assert math.isclose(special.mann_whitney_exact(3, 4, 5), 14 / 126, rel_tol=1e-9)


def test_chi2_is_corrected_in_two_by_two(spark):
    rows = [("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 10 + [(None, "x")]
    r = statistics.with_chi2_p(statistics.chi2(spark.createDataFrame(rows, "r string, c string"), "r", "c")).first()
    e = [17 * 15 / 30, 17 * 15 / 30, 13 * 15 / 30, 13 * 15 / 30]
    want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip((12, 5, 3, 10), e))
    assert math.isclose(r["chi2"], want) and r["dof"] == 1 and math.isclose(r["p"], special.chi2_tail(want, 1))


def test_power_transform_makes_lognormal_normal(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v),) for v in np.exp(rng.normal(size=400))], "v double")
    out, power = statistics.power_transformed(df, ["v"])
    assert abs(out.agg(F.skewness("v")).first()[0]) < 0.2 and power["v"] < 0.2


def test_models_on_separable_groups():
    rng = np.random.default_rng(0)
    x, y = np.vstack([rng.normal(0, 0.3, (40, 2)), rng.normal(3, 0.3, (40, 2))]), np.repeat([0, 1], 40)
    for labels in (models.mixture(x, 2).predict(x), models.cut(models.ward(x), 2), models.spectral(x, 2), models.hdbscan(x)):
        assert models.adjusted_rand(y, labels) > 0.95
    assert len(models.mixture_by_bic(x, 5, 3).means) == 2
    assert models.aligned(y, 1 - y).tolist() == y.tolist()


def test_nested_clusters_and_stability(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i:02d}", 2.4 + 0.3 * (i % 2) + 0.02 * rng.normal(), 200 + 20 * rng.normal(), 0.02 + 0.1 * (i % 2) + 0.004 * rng.normal(), 0.9) for i in range(40)]
    df = spark.createDataFrame([tuple(map(lambda v: v if isinstance(v, str) else float(v), r)) for r in rows], "sample_id string, E_g_eV double, E_u_meV double, A_sub double, A_sub_coverage double")
    found = clusters.nested(df, k=2).collect()
    assert {r["macro_cluster"] for r in found if int(r["sample_id"][1:]) % 2} == {1}
    kept, runs = clusters.stability(clusters.subsample_bootstrap(df, n=6))
    assert kept.agg(F.min("stability")).first()[0] > 0.9 and runs.agg(F.sum("n")).first()[0] == 6


def test_titles(spark):
    df = spark.createDataFrame([(1, "Photocatalysis of carbon nitride sheets"), (2, "Photocatalysis of carbon nitride sheet"), (3, "Something else altogether here"), (4, "photocatalysis of Carbon nitride sheets!"), (5, "x.pdf")], "id int, title string")
    assert {(r["id"], r["duplicate_of"]) for r in titles.exact_groups(df, "id", "title").collect()} == {(1, 1), (4, 1)}
    assert {(r["kind"], r["a"], r["b"]) for r in titles.fuzzy_pairs(df, "id", "title").collect()} == {("member", 1, 1), ("member", 2, 2), ("member", 3, 3), ("member", 4, 1), ("pair", 1, 2)}


def test_section(spark):
    body = "Melamine was heated at 550 °C for 4 h in a muffle furnace. " * 12
    article = f"Title\nIntro\n2. Experimental\n{body}\n3. Results and discussion\nmore"
    row = text.extracted(spark.createDataFrame([(article,), ("nothing here",)], "text string")).collect()
    assert row[0]["confidence"] == "high" and row[0]["experimental_text"].startswith("2. Experimental") and "Results" not in row[0]["experimental_text"]
    assert row[1]["experimental_text_raw"] is None and row[1]["confidence"] == "none"


def test_cleaning(spark):
    df = spark.createDataFrame([("eﬃcient synthe-\nsized [1,2] at 500 ℃ (Fig. 1a) (cid:12)\n 12 \nend https://a.b/c",)], "t string")
    assert df.select(text.cleaned(F.col("t"))).first()[0] == "efficient synthesized at 500 °C \nend"


def test_tags_and_pairs(spark):
    df = spark.createDataFrame([("Urea ",), ("melamine",), ("?",), (None,)], "v string")
    assert [r[0] for r in df.select(tags.validated(F.col("v"), tags.COMMON["precursor_family"], "other")).collect()] == ["urea", "melamine", "other", "other"]
    rows = spark.createDataFrame([("a", 1, "ref", 5.0, "x"), ("a", 2, "ref", 3.0, "y"), ("a", 3, "mod", 7.0, "x"), ("b", 4, "mod", 2.0, "z"), ("b", 5, "mod", 4.0, "z")], "g string, id int, kind string, v double, tag string")
    found = {r["mod_id"]: r for r in transitions.pairs(rows, group="g", kind="kind", value="v", order="id", measures=["v"], tags=["tag"], reference="ref", modified="mod").collect()}
    assert (found[3]["ref_id"], found[3]["d_v"], found[3]["tag_changed"], found[3]["virtual_ref"]) == (2, 4.0, True, False)
    assert (found[4]["d_v"], found[4]["virtual_ref"], found[4]["tag_changed"]) == (-1.0, True, False)


def test_flattening(spark):
    df = spark.createDataFrame([("a", '{"samples": [{"m": "x"}, {"m": "y"}], "drs_instrument": "d"}'), ("b", "no json"), ("c", '{"samples": []}')], "article_id string, response string")
    got = [(r["article_id"], r["extraction_status"], r["sample_index"], r["m"]) for r in tags.flattened(df, "samples array<struct<m:string>>, drs_instrument string, general_notes string").orderBy("article_id", "sample_index").collect()]
    assert got == [("a", "success", 0, "x"), ("a", "success", 1, "y"), ("b", "error", None, None), ("c", "no_samples", None, None)]


def made_titles(n, seed=4):
    rng = random.Random(seed)
    words = ["old", "cold", "hot", "blue", "plate", "plates", "ring", "photocatalytic", "nitride", "sheets", "evolution", "hydrogen", "of", "the"]
    made = [" ".join(rng.choices(words, k=rng.choice([3, 4, 5, 9, 14]))) + f" {rng.randint(1, 60)}" for _ in range(n)]
    for i in range(0, n, 3):  # near copies, with letters taken out, put in and moved
        t = list(made[rng.randrange(n)])
        for _ in range(rng.randint(1, 6)):
            t[rng.randrange(len(t))] = rng.choice(["", "", "x", "e "])
        made[i] = "".join(t)
    return made


def plain_pairs(titles_, least):
    """titles_: [(key, title)], by key."""
    out = {}
    for i, (a, s) in enumerate(titles_):
        for b, t in titles_[i + 1 :]:
            m = SequenceMatcher(None, s, t)
            if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (ratio := m.ratio()) >= least:
                out[a, b] = round(ratio, 9)
    return out


def test_fuzzy_titles_equal_brute_force(spark):
    rows = list(enumerate(made_titles(2000))) + [(5000 + i, "zzzzzzzzzzzz aaaaaaaaa " + "b" * (i % 5)) for i in range(10)] + [(9000, None), (9001, "x.pdf"), (None, "A title without a key")]
    frame = spark.createDataFrame(rows, "id int, title string")
    named = {}
    for k, t in rows[:-3]:
        t = " ".join(t.split())
        if len(t) >= 10:
            named.setdefault(t, []).append(k)
    reps = sorted((min(k), t) for t, k in named.items())
    for least, options in ((0.85, {}), (0.95, {"sample": 300, "block": 64})):
        got = titles.fuzzy_pairs(frame, "id", "title", least, **options).collect()
        pairs = [((r["a"], r["b"]), round(r["similarity"], 9)) for r in got if r["kind"] == "pair"]
        assert len(pairs) == len(dict(pairs)) and dict(pairs) == plain_pairs(reps, least) and len(pairs) > 30
        assert sorted((r["a"], r["b"]) for r in got if r["kind"] == "member") == sorted((k, min(ks)) for ks in named.values() for k in ks)
    assert titles.fuzzy_pairs(frame.limit(0), "id", "title").count() == 0


def test_common_letters():
    rng = random.Random(2)
    made = ["".join(rng.choices("abc 1", k=rng.randint(1, 64))) for _ in range(60)]
    t = titles.Titles(made)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    i, j = np.arange(59), np.arange(1, 60)
    assert titles.common_letters(t.places(), t.spelled(), i, j).tolist() == [lcs(made[a], made[b]) for a, b in zip(i, j)]


def test_star_groups_equal_the_loop(spark):
    rng = random.Random(3)
    edges = []
    for g in range(5000):
        n = rng.randint(2, 9)
        edges += [(g * 10 + a, g * 10 + b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
    want = {}
    for a, b in sorted(edges):
        if a not in want and b not in want:
            want[b] = a
    got = {r["key"]: r["duplicate_of"] for r in titles.star_groups(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(24)], "a int, b int")
    assert {r["key"]: r["duplicate_of"] for r in titles.star_groups(chain).collect()} == {i: i - 1 for i in range(1, 25, 2)}
    assert titles.star_groups(chain.limit(0)).count() == 0


def test_duplicates_equal_the_loop(spark):
    made = made_titles(260, 9)
    rows = list(enumerate(made)) + [(1000 + i, t.upper()) for i, t in enumerate(made[:40])] + [(2000, None), (2001, "   ")]
    plain = {k: " ".join(t.lower().split()) for k, t in rows[:-2] if len(t.strip()) >= 10}
    groups, want = {}, {k: (False, None, 0) for k, _ in rows}
    for k, t in plain.items():
        groups.setdefault(t, []).append(k)
    number = 0
    for t in sorted(groups):
        if len(groups[t]) > 1:
            number += 1
            want |= {k: (k != groups[t][0], groups[t][0] if k != groups[t][0] else None, number) for k in groups[t]}
    rest, done = [(k, t) for k, t in plain.items() if len(groups[t]) == 1], set()
    for i, (a, s) in enumerate(rest):
        if a in done:
            continue
        same = [b for b, t in rest[i + 1 :] if b not in done and SequenceMatcher(None, s, t).ratio() >= 0.85]
        if same:
            number += 1
            done |= {a, *same}
            want |= {a: (False, None, number)} | {b: (True, a, number) for b in same}
    got = {r["id"]: (r["is_duplicate"], r["duplicate_of"], r["duplicate_group"]) for r in titles.duplicates(spark.createDataFrame(rows, "id int, title string"), "id", "title").collect()}
    assert got == want and number > 10


def test_whole_texts_of_all_languages_are_normalised(spark, tmp_path):
    import re

    from specflow.plans import queries

    texts = ["First LINE &amp; more\nsecond&#xE4;\tline", "Größe\u00a0ÜBER\u3000alles\u2028x", "你好 World\n1", "\u212aelvin İx", " \n ", "", None]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["en", "de", None, "fr", "en", "es", "de"], strict=True))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda t: " ".join(re.sub(r"[^a-z0-9\s]", " ", re.sub(r"&#x[0-9a-f]+;|&[a-z]+;", "", t.lower())).split())
    got = {r["doc_id"]: r["title"] for r in queries.QUERIES["normalise_text"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else plain(t) for i, t, _ in rows}
