"""Frames, as-of lookups, dealt sums, stored relations, scoring in one pass, increments, guards and trigrams, against loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadica import catalogue
from dyadica.dialect import DUCKDB, SPARK
from dyadica.functions import formulas, frames
from dyadica.operators.model_relations import ROOMS
from dyadica.operators.relations import as_of, budgeted, needed, named, parts, rendered, shared
from dyadica.plans import experiments, ngram, run
from dyadica.plans.store import Store, shared_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(8)
    rows = [(s, 2 * i, rng.choice(["child", "mother"]), f"t{s}.{i}", rng.choice([1, 1, 2, 5, 9])) for s in range(12) for i in range(rng.randrange(1, 25))]
    rows += [(50, 0, "child", "only", 7), (51, 0, "child", "x", 10), (51, 1, "mother", "y", 11), (51, 2, "mother", "z", 10), (51, 3, "mother", "w", 0 + 1)]
    spark.createDataFrame(rows, "session int, line_num int, speaker string, text string, tokens int").createOrReplaceTempView("lines_case")
    text = "SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_num) AS pos, sum(tokens) OVER (PARTITION BY session ORDER BY line_num) AS upto FROM lines_case"
    spark.sql(text).createOrReplaceTempView("lines")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    yield by
    spark.catalog.dropTempView("lines")


@pytest.mark.parametrize("rooms", [[0], [1], [10, 21], [22, 400, 5]])
def test_budget_frames_equal_a_loop(spark, lines, rooms):
    got = {(r.session, r.line_num): r for r in spark.sql(budgeted(rooms, "text || '|'")).collect()}
    assert len(got) == sum(map(len, lines.values()))
    for rows in lines.values():
        for i, (session, line, _, _, own) in enumerate(rows):
            for c in rooms:
                n = 0
                while n < i and sum(r[4] for r in rows[i - n - 1 : i]) + own <= c:
                    n += 1
                r, fit = got[session, line], rows[i - n : i]
                assert (r[f"n_{c}"], r[f"start_{c}"], r[f"used_{c}"], r[f"context_{c}"]) == (n, fit[0][1] if fit else None, sum(x[4] for x in fit), "".join(x[3] + "|" for x in fit))


def test_rendered_lines_equal_a_loop(spark, lines):
    for k, here in ((3, True), (10, False)):
        got = {(r.session, r.line_num): r.context for r in spark.sql(rendered(k, "speaker || ' '", here)).collect()}
        for rows in lines.values():
            for i, r in enumerate(rows):
                assert got[r[0], r[1]] == "\n".join(f"{x[2]} {x[3]}" for x in rows[max(0, i - k) : i + here])


@pytest.mark.parametrize("name", ["context_budget", "context_render", "discourse_budget", "input_audit", "annotation_prompts"])
def test_lines_are_not_joined_with_lines(spark, name):
    """What joins there are meet a line by its number, and registries are broadcast."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join \w+, .*(pos|upto|line_num|context_start)#\d+L? [<>]", plan)
    assert name.startswith(("input", "annotation")) or "Join Inner" not in plan or "max_tokens" in plan or "room" in plan


def test_as_of_equals_a_loop(spark):
    rng = random.Random(9)
    rows = [(k, d, float(d + k), float(rng.randrange(9))) for k in range(4) for d in sorted(rng.sample(range(1, 400), 30))] + [(9, 300, 1.0, 2.0)]
    spark.createDataFrame(rows, "k int, dist int, x double, y double").createOrReplaceTempView("curve_case")
    grid = parts(SPARK)["grid"]
    got = {(r.k, r.k_max): (r.x, r.y) for r in spark.sql(as_of("k", "SELECT * FROM curve_case", ("x", "y"), grid)).collect()}
    want = {}
    for k in (0, 1, 2, 3, 9):
        for at in [*range(1, 201), 10**9]:
            behind = [r for r in rows if r[0] == k and r[1] <= at]
            if behind:
                want[k, at] = max(behind, key=lambda r: r[1])[2:]
    assert got == want and (9, 200) not in got and (9, 10**9) in got


def test_predicted_overlap_of_a_million_nouns(spark):
    n, s, b = 1_000_000, 5_000_000, 0.8
    h = math.fsum(1 / np.arange(1, n + 1))
    p = 1 / (np.arange(1, n + 1) * h)
    want = math.fsum(1 - (p * b + 1 - p) ** s - (p * (1 - b) + 1 - p) ** s + (1 - p) ** s) / n
    rows = f"SELECT 1 AS k, CAST({n} AS BIGINT) AS n, CAST({s} AS BIGINT) AS s, CAST({b} AS DOUBLE) AS bias UNION ALL SELECT 2, 1, 1, 0.8 UNION ALL SELECT 3, 0, 0, 0.8 UNION ALL SELECT 4, 40, 120, 0.8 UNION ALL SELECT 5, 4097, 9000, 0.6"
    got = {r.k: r.x for r in spark.sql(formulas.with_predicted(SPARK, rows, ("k", "n", "s", "bias"), {"x": "bias"})).collect()}
    assert math.isclose(got[1], want, rel_tol=1e-12) and got[2] is None and got[3] is None
    import duckdb

    small = duckdb.connect().execute(formulas.with_predicted(DUCKDB, rows.split(" UNION ALL ", 1)[1].replace("SELECT 2, 1, 1, 0.8", "SELECT 2 AS k, 1 AS n, 1 AS s, 0.8::DOUBLE AS bias"), ("k", "n", "s", "bias"), {"x": "bias"})).fetchall()
    assert {r[0]: r[4] and round(r[4], 12) for r in small} == {k: x and round(x, 12) for k, x in got.items() if k > 1}
    for k in (1, 63, 64, 65, 100, 5000):
        assert math.isclose(spark.sql(f"SELECT {formulas.harmonic_series(SPARK, str(k))}").first()[0], math.fsum(1 / i for i in range(1, k + 1)), rel_tol=1e-15)


def scans(final: str, known: dict, stored, table: str) -> int:
    """How often a table is read for a text, each stored relation being made once."""
    names = needed(final, known)
    each = {n: None for n in names}

    def reads(text):
        return sum(1 if n == table else 0 if n in stored or n not in known else of(n) for n in named(text))

    def of(n):
        if each[n] is None:
            each[n] = reads(known[n])
        return each[n]

    return reads(final) + sum(of(n) for n in names if n in stored)


def test_each_table_is_scanned_once(spark):
    known = parts(SPARK)
    for name, text in catalogue.texts(SPARK).items():
        stored = shared(text, known)
        assert scans(text, known, stored, "documents") <= 1 or name in ("pair_counts", "normalised_text"), name
        assert scans(text, known, stored, "conversations") <= (2 if "utterances" in named(text) else 1), name
    assert scans(catalogue.texts(SPARK)["model_four_tests"], known, (), "conversations") > 5  # what storing spares


def test_store_and_steps(spark, tmp_path):
    out = f"{tmp_path}/out"
    steps = ["sites", "input_audit", "transitions", "model_predictions"]
    made = []
    real = Store.relation

    def counted(self, name, key, make):
        return real(self, name, key, lambda: made.append(name) or make())

    Store.relation = counted
    try:
        assert run.run(spark, SF, out, steps) == steps
        assert len(made) == len(set(made)) and {"sites", "lines", "distances", "formcounts", "predictions"} <= set(made)
        assert run.run(spark, SF, out, steps) == [] and run.run(spark, SF, out, ["transitions", "tpr_by_k"]) == ["tpr_by_k"]
        assert run.run(spark, SF, out, ["transitions"], force=True) == ["transitions"] and len(made) == len(set(made))
        assert run.run(spark, "/root/testdata/sf0.01", out, ["transitions"]) == ["transitions"]  # another input, other tables
        assert Counter(made)["sites"] == 2
    finally:
        Store.relation = real
    assert spark.read.parquet(f"{out}/transitions").count() == catalogue.QUERIES["transitions"](spark, "/root/testdata/sf0.01").count()
    assert shared_folder(spark)


def test_guard_fails_what_isnt_sound(spark, tmp_path, monkeypatch):
    """99.8 % of the antecedents inside the window are in their context; more than 99.9 % must be."""
    final = "SELECT in_window, count(*) AS n, CASE WHEN in_window THEN avg(CASE WHEN held THEN 1e0 ELSE 0e0 END) > 0.999 END AS sound FROM audit_case GROUP BY in_window"
    for held, good in ((998, False), (1000, True)):
        spark.range(1000).selectExpr("id % 2 >= 0 AS in_window", f"id < {held} AS held").createOrReplaceTempView("audit_case")
        monkeypatch.setitem(catalogue.QUERIES, "input_audit", lambda spark, *_: spark.sql(final))
        out = f"{tmp_path}/{held}"
        if good:
            assert run.run(spark, SF, out, ["input_audit", "sites"]) == ["sites", "input_audit"]
        else:
            with pytest.raises(Exception, match="antecedent"):
                run.run(spark, SF, out, ["input_audit"])
            with pytest.raises(Exception, match="antecedent"):
                run.run(spark, SF, out, first="sites", last="transitions")
            assert not (tmp_path / str(held) / "transitions").exists()
    with pytest.raises(Exception, match="odd"):
        frames.guarded(spark.range(9), F.col("id") % 2 == 0, "odd").collect()


MODELS = [{"name": "x/m", "type": "mlm", "max_tokens": 100}, {"name": "g", "type": "ar"}, {"name": "g", "type": "seq2seq", "max_tokens": 60}]


def test_one_pass_gives_each_models_prompts(spark):
    cols = ["session", "line_num", "pair_index", "prompt", "context_length", "truncated"]
    got = {}
    for r in experiments.run(spark, SF, MODELS).select("mode", "model_type", *cols).collect():
        got.setdefault((r["mode"], r.model_type), set()).add(tuple(r[c] for c in cols))
    for m in MODELS:
        for mode in experiments.MODES:
            text = experiments.prompts(mode, m["type"], experiments.context_limit(m.get("max_tokens")))
            want = {tuple(r[c] for c in cols) for r in catalogue.frame(spark, SF, text).collect()}
            assert got[mode, m["type"]] == want and len(want) > 20


def test_sites_are_read_once_for_all_models(spark):
    def reads(models):
        store = Store(spark)
        plan = experiments.run(spark, SF, models, store=store)._jdf.queryExecution().optimizedPlan().toString()
        return store.made.count("sites"), store.made.count("lines"), len(re.findall(r"Relation \[", plan)), plan.count("conversations")

    one, many = reads(MODELS[:1]), reads([{**MODELS[i % 3], "name": f"m{i}"} for i in range(12)])
    assert one == many and one[:2] == (1, 1)


def test_a_state_for_each_model(spark):
    from dyadica.plans import scoring

    scoring.register("told", lambda config: config["level"], lambda state, prompt, forms: {f: state if f == "the" else 0.0 for f in forms})
    rows = spark.range(40).selectExpr("CAST(id % 4 AS INT) AS work", "id", "'p' AS prompt")
    out = scoring.score_each(rows, {i: {"type": "told", "level": float(i)} for i in range(4)}, ["id"]).collect()
    assert len(out) == 40 and all(math.isclose(r.probs["the"], math.exp(r.work) / (math.exp(r.work) + 2)) for r in out)


def test_only_missing_models_run(spark, tmp_path):
    out = f"{tmp_path}/predictions"
    assert len(experiments.run_missing(spark, SF, MODELS[:2], out, "both")) == 4
    before = {r.f: r.t for r in spark.read.parquet(out).selectExpr("_metadata.file_path AS f", "_metadata.file_modification_time AS t").distinct().collect()}
    assert experiments.run_missing(spark, SF, MODELS[:2], out, "both") == []
    assert experiments.run_missing(spark, SF, MODELS, out, "all") == sorted([("contextual", "ar", "g"), ("contextual", "mlm", "x/m"), *[(k, "seq2seq", "g") for k in experiments.MODES]])
    after = {r.f: r.t for r in spark.read.parquet(out).selectExpr("_metadata.file_path AS f", "_metadata.file_modification_time AS t").distinct().collect()}
    assert all(after[f] == t for f, t in before.items()) and len(after) > len(before)
    assert spark.read.parquet(out).groupBy(*experiments.WORK).count().count() == 9
    assert len(experiments.run_missing(spark, SF, MODELS[:1], out, "isolated", force=True)) == 1 and spark.read.parquet(out).groupBy(*experiments.WORK).count().count() == 9


def test_trigram_scores_equal_a_loop(spark):
    corpus = ["The dog saw a cat. The cat ran!", "a dog, a cat and the dog", "the", "", None, "THE cat saw the dog and an owl"]
    prompts = [(1, "I saw ___ cat"), (2, "___ dog"), (3, "the cat saw ___"), (4, "no blank"), (5, None), (6, "___"), (7, "the ___ the ___ zebra"), (8, "___ cat and the ___")]
    model = ngram.Model(spark.createDataFrame([(t,) for t in corpus], "text string"), Store(spark), "")
    got = {(r.id, r.form): r.log_p for r in model.score(spark.createDataFrame(prompts, "id int, prompt string"), ["id"], ["a", "an", "the"]).collect()}
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = [(["<s>", "<s>", *words(t)][i], ["<s>", "<s>", *words(t)][i + 1], words(t)[i]) for t in corpus if t for i in range(len(words(t)))]
    n, v = len(grams), len({g[2] for g in grams})

    def p(a, b, c):
        out = (sum(g[2] == c for g in grams) + 0.5) / (n + 0.5 * (v + 1))
        for near in ([g for g in grams if g[1] == b], [g for g in grams if g[:2] == (a, b)]):
            if near:
                t = len({g[2] for g in near})
                out = (sum(g[2] == c for g in near) + t * out) / (len(near) + t)
        return out

    want = {}
    for i, prompt in prompts:
        if prompt and "___" in prompt:
            for form in ("a", "an", "the"):
                w = ["<s>", "<s>", *words(prompt.split("___", 1)[0]), form, *words(prompt.split("___", 1)[1].replace("_", " "))]
                want[i, form] = sum(math.log(p(*w[k - 2 : k + 1])) for k in range(2, len(w)))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    total = sum(p("the", "dog", c) for c in {g[2] for g in grams}) + p("the", "dog", "zebra")
    assert math.isclose(total, 1)
    empty = ngram.Model(spark.createDataFrame([], "text string"), Store(spark), "")
    assert empty.n == 0 and empty.score(spark.createDataFrame([(1, "x ___")], "id int, prompt string"), ["id"], ["a"]).count() == 1


def test_other_adults_have_cases(spark):
    """Welch's and the one-sample test compare with the other adults, of whom there are cases."""
    sf = "/root/testdata/sf0.01"
    adults = catalogue.QUERIES["other_adult_dyads"](spark, sf).toPandas()
    four = catalogue.QUERIES["model_four_tests"](spark, sf).toPandas()
    assert len(adults) > 2 and four.onesample_t.notna().all() and four.p_welch.notna().all()
    assert np.allclose(four.adult_population_mean, (adults.tpr * adults.n_total).sum() / adults.n_total.sum(), atol=1e-8) and np.allclose(four.mean_adult_tpr, adults.tpr.mean(), atol=1e-8)
    by_k = catalogue.QUERIES["tests_by_k"](spark, sf).toPandas()
    assert by_k.t.notna().any() and by_k.adult_n.max() == adults.n_total.sum() and set(ROOMS)
