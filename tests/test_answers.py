"""Answers that outlive their run, and the fields of all configurations."""

import os

import pytest

from specflow.operators import answers, tags


def client_of(log, broken="", dead=""):
    """Writes down each call; fails on prompts with ``broken`` the first two times, and ends the run at one with ``dead``."""

    def make():
        def ask(prompt):
            with open(log, "a") as f:
                f.write(prompt + "\n")
            if dead and dead in prompt:
                os._exit(1)
            if broken and broken in prompt and open(log).read().split("\n").count(prompt) <= 2:
                raise ValueError("busy")
            return '{"samples": []}'

        return ask

    return make


def test_a_killed_run_goes_on(spark, tmp_path):
    log, at = f"{tmp_path}/calls", f"file://{tmp_path}/answers"
    df = spark.createDataFrame([(f"a{i:02d}", f"prompt {i:02d}") for i in range(12)] + [("a03", "prompt 03"), (None, "nobody")], "article_id string, prompt string")
    with pytest.raises(Exception):
        answers.answer(df, client_of(log, dead="07"), "prompt", at, version="v", batch=4, pause=0.0).collect()
    before = open(log).read().split("\n")[:-1]
    assert answers.read(spark, at).count() == 4 and before[:4] == [f"prompt {i:02d}" for i in range(4)]
    got = answers.answer(df, client_of(log), "prompt", at, version="v", batch=4, pause=0.0).collect()
    after = open(log).read().split("\n")[len(before) : -1]
    assert sorted(r["article_id"] for r in got) == [f"a{i:02d}" for i in range(12)] and {r["status"] for r in got} == {"success"}
    assert after == [f"prompt {i:02d}" for i in range(4, 12)]  # nothing that was committed
    answers.answer(df, client_of(log), "prompt", at, version="v", pause=0.0)
    assert len(open(log).read().split("\n")) - 1 == len(before) + len(after)
    with pytest.raises(ValueError, match="another configuration"):
        answers.answer(df, client_of(log), "prompt", at, version="w", pause=0.0)


def test_failures_are_tried_again_and_told(spark, tmp_path):
    log, at = f"{tmp_path}/calls", f"file://{tmp_path}/answers"
    df = spark.createDataFrame([("a", "one"), ("b", "two")], "article_id string, prompt string")
    got = {r["article_id"]: (r["status"], r["error"], r["tries"]) for r in answers.answer(df, client_of(log, broken="two"), "prompt", at, version="v", pause=0.0, wait=0.0, tries=2).collect()}
    assert got == {"a": ("success", None, 1), "b": ("error", "busy", 2)}
    again = {r["article_id"]: r["status"] for r in answers.answer(df, client_of(log, broken="two"), "prompt", at, version="v", again=True, pause=0.0).collect()}
    assert again == {"a": "success", "b": "success"} and open(log).read().split("\n").count("one") == 1


def test_fields_of_configurations(spark):
    for config in tags.available():
        assert all(default in allowed for allowed, default in tags.fields(config).values()) and set(tags.CONFIGS[config]) == set(tags.DEFAULTS[config])
    df = spark.createDataFrame([("UREA ", "LT2H", 1), ("?", None, 2)], "precursor_family string, mod_duration_bin string, n int")
    rows = [r.asDict() for r in tags.all_validated(df, "v2_staged").orderBy("n").collect()]
    assert [(r["precursor_family"], r["mod_duration_bin"], r["mod_method"], r["n"]) for r in rows] == [("urea", "lt2h", "none", 1), ("other", "none", "none", 2)]
    with pytest.raises(ValueError, match="no such configuration"):
        tags.fields("v9")


def test_steps_are_made_once(spark, tmp_path):
    from specflow.plans import catalog

    root, calls = f"file://{tmp_path}/steps", []
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, t string")

    def double(rows):
        calls.append("double")
        return rows.selectExpr("2 * i as i", "t")

    run = lambda df, **about: sorted(map(tuple, catalog.step(spark, root, "double", {"rows": df}, double, **about).collect()))
    assert run(rows) == run(rows.repartition(3)) == [(2, "a"), (4, "b"), (4, "b")] and calls == ["double"]
    assert run(rows.distinct()) == [(2, "a"), (4, "b")] and run(rows, scale=3) == [(2, "a"), (4, "b"), (4, "b")] and len(calls) == 3
    assert [(s["step"], s["about"]) for s in catalog.steps(spark, root)] == [("double", {}), ("double", {}), ("double", {"scale": 3})]

    # another session commits the same step while this one is making it
    def slow(rows):
        if len(calls) < 10:
            calls.extend(range(10))
            catalog.step(spark, root, "slow", {"rows": rows}, slow)
        return rows.selectExpr("i", "t", "uuid() as u")

    first = catalog.step(spark, root, "slow", {"rows": rows}, slow).collect()
    assert sorted(first) == sorted(catalog.step(spark, root, "slow", {"rows": rows}, slow).collect()) and len(first) == 3
    assert len([s for s in catalog.steps(spark, root) if s["step"] == "slow"]) == 1 and not list((tmp_path / "steps" / "slow").glob("_making*"))
    assert catalog.digest(rows.limit(0)) != catalog.digest(rows.limit(0).drop("t"))
