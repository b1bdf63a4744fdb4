"""Scorers, experiments, loaders, steps, streams and edge rows of the formulas."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from dyadica.dialect import DUCKDB, SPARK
from dyadica.functions import cac, formulas, frames, stats
from dyadica.operators.relations import parts
from dyadica.plans import experiments, run, scoring
from dyadica.sources import results

SF = "/root/testdata/sf0.001"


def test_sites_of_long_and_odd_texts(spark):
    rows = [("İa the cat", 1), ("the " * 3 + "dog", 2), ("word a thing " * 5000, 3), ("", 4), (None, 5), ("the", 6), ("An ÉTÉ the-dog", 7)]
    spark.createDataFrame(rows, "text string, k int").createOrReplaceTempView("src")
    p = parts(SPARK)["docsites"].replace("FROM documents", "FROM src").replace("doc_id, lang, source", "k")
    got = {(r.k, r.form, r.noun): (r.det_char_start, r.det_char_end) for r in spark.sql(p).where("k <> 3").collect()}
    assert got == {(1, "the", "cat"): (3, 6), (2, "the", "dog"): (8, 11), (7, "an", "été"): (0, 2), (7, "the", "dog"): (7, 10)}
    assert spark.sql(p).where("k = 3").count() == 5000


def test_overlap_of_one_token_is_undefined(spark):
    for d, one in ((SPARK, lambda q: spark.sql(q).first()[0]), (DUCKDB, lambda q: duckdb.connect().execute(q).fetchone()[0])):
        at = lambda n, s, b: one(f"SELECT {formulas.predicted_overlap(d, 'n', 's', 'b', 'h')} FROM (SELECT {n} AS n, {s} AS s, CAST({b} AS DOUBLE) AS b, {formulas.harmonic(d, str(n))} AS h) x")  # noqa: E731, B023
        assert at(1, 1, 0.8) is None and at(3, 9, 1) is None and at(3, 9, 0.8) > 0


def test_null_probabilities_count_as_rows_only(spark):
    rows = [("m", "mlm", 0, "child", "n", "the", 0.7, 0.3), ("m", "mlm", 0, "child", "n", "a", 0.0, 0.0), ("m", "mlm", 0, "child", "z", "a", 0.0, 0.0), ("m", "mlm", 0, "child", "w", "a", 1.0, 0.0), ("m", "mlm", 0, "child", "w", "a", 0.0, 1.0)]
    spark.createDataFrame(rows, "model_name string, model_type string, dyad int, speaker string, noun string, det string, p_the double, p_a double").createOrReplaceTempView("predictions_case")
    p = parts(SPARK)
    nouns = p["model_nouns"].replace("FROM predictions", "FROM predictions_case")
    got = {r.noun: (r.k, r.both_used) for r in spark.sql(nouns).collect()}
    assert got["n"][0] == 2 and abs(got["n"][1]) < 1e-12 and got["z"] == (1, None) and got["w"] == (2, 1.0)
    row = spark.sql(f"WITH model_nouns AS ({nouns}) {p['model_bias']}").first()
    assert (row.n, row.s) == (3, 5) and math.isclose(row.empirical, 1 / 3, abs_tol=1e-12)


def test_p_values_for_fractional_degrees(spark):
    rows = [(t, df) for t in (0.0, 0.5, 1.7, 6.0) for df in (1.0, 2.5, 3.3, 11.0, 20.71)]
    d = spark.createDataFrame(rows, "t double, df double")
    for r in d.select("*", stats.welch_p("t", "df").alias("p"), F.expr(formulas.p_value_any(SPARK, "t", "df")).alias("q")).collect():
        assert math.isclose(r.p, stats.t_p_value(r.t, r.df), abs_tol=1e-12) and math.isclose(r.p, r.q, abs_tol=1e-6)
    # Published: t, df and two-sided p.
    assert math.isclose(stats.t_p_value(2.228138852, 10), 0.05, abs_tol=1e-8) and math.isclose(stats.t_p_value(12.7062047, 1), 0.05, abs_tol=1e-8)


def test_scorers(spark):
    d = spark.createDataFrame([(1, "see [MASK] dog", "see ___ dog"), (2, "no blank", "no blank"), (3, None, None)], "id int, mlm string, ar string")
    for kind, column in (("mlm", "mlm"), ("ar", "ar"), ("seq2seq", "ar")):
        out = scoring.with_determiners(scoring.score(d, {"name": "m", "type": kind}, prompt=column), "id").orderBy("id").collect()
        assert all(math.isclose(r.P_a + r.P_the, 1) for r in out) and out[0].P_a != 0.5 and out[1].P_a == out[2].P_a == 0.5
        assert [r.predicted_det_argmax for r in out[1:]] == ["the", "the"]
    with pytest.raises(ValueError):
        scoring.score(d, {"name": "m", "type": "rnn"})
    scoring.register("fixed", lambda config: config["scores"], lambda state, prompt, forms: {f: state[f] for f in forms})
    row = scoring.score(d, {"name": "m", "type": "fixed", "scores": {"a": 0.0, "an": 0.0, "the": math.log(2)}}, prompt="ar").first()
    assert math.isclose(row.probs["a"], 0.5) and scoring.context_limit(None, 0, 10**6) == 512 and scoring.context_limit(2048, 1024) == 1024
    assert scoring.forms_of({"x": ["a", "b"], "y": ["b", "c"]}) == ["a", "b", "c"]
    p = F.create_map(F.lit("a"), F.lit(0.5), F.lit("the"), F.lit(0.5), F.lit("z"), F.lit(0.0))
    row = d.limit(1).select(cac.argmax(p, ["a", "the"]).alias("x"), cac.mass_on(p, ["a", "q"]).alias("y"), cac.surprisal(p, "z").alias("z"), cac.surprisal(p, "a", 2.0).alias("w")).first()
    assert (row.x, row.y, row.z, row.w) == ("a", 0.5, math.inf, 1.0)


def test_extractors(spark):
    assert scoring.NativePairs().extract("An Apple and the the dog, a") == ["a Apple", "the dog"] and scoring.NativePairs(1).extract("the big dog") == ["the dog"]
    out = scoring.extract_pairs(spark.createDataFrame([("the dog a cat",), (None,)], "text string")).collect()
    assert [(r.det, r.noun) for r in out] == [("the", "dog"), ("a", "cat")]


def test_experiments(spark):
    models = [{"name": "m", "type": "mlm", "max_tokens": 100}, {"name": "g", "type": "ar"}]
    out = experiments.run(spark, SF, models).toPandas()
    n = len(out[(out.model_name == "m") & (out["mode"] == "isolated")])
    assert n > 300 and set(out["mode"]) == set(experiments.MODES) and len(out[(out.model_name == "g") & (out["mode"] == "discourse")]) == n
    inside = out[(out["mode"] == "discourse") & (out.model_name == "m")]
    assert (inside.prompt.str.count("\n") >= inside.context_length).all() and inside.truncated.any() and inside.prompt.str.contains("[MASK]", regex=False).all()
    assert (out[out["mode"] == "contextual"].prompt.str.startswith(("Child: ", "Mother: "))).all()
    for bad in (("x", "mlm", 9, "spoken"), ("isolated", "x", 9, "spoken"), ("discourse", "ar", 9, "x")):
        with pytest.raises(ValueError):
            experiments.prompts(*bad)


def test_steps(spark, tmp_path):
    assert run.chosen("model_tpr", "tpr_by_k") == ["model_tpr", "tpr_by_k"] and run.chosen(only=["tpr_by_k", "sites"]) == ["sites", "tpr_by_k"]
    with pytest.raises(ValueError):
        run.chosen("nothing")
    for form in ("parquet", "csv"):
        out = f"{tmp_path}/{form}"
        assert run.run(spark, SF, out, ["sites"], form=form) == ["sites"] and run.run(spark, SF, out, ["sites"], form=form) == []
        assert spark.read.option("header", True).format(form).load(f"{out}/sites").count() == 374


def test_result_tables(spark, tmp_path):
    keys = "model_name string, model_type string, child_name string, speaker string"
    d = spark.createDataFrame([("x/m", "mlm", "c", "child", "dog", "the", "the", "a"), ("x/m", "mlm", "c", "child", "cat", "a", "a", "a")], f"{keys}, noun string, original_det string, predicted_det_argmax string, predicted_det_sample string")
    assert {(r.method, r.accuracy) for r in results.accuracy(d).collect()} == {("argmax", 1.0), ("sample", 0.5)}
    results.write_pairs(d, f"{tmp_path}/pairs")
    lines = spark.read.text(f"{tmp_path}/pairs").where("method = 'sample'").select("value").collect()
    assert sorted(r.value for r in lines) == ["a cat", "a dog"]
    folder = tmp_path / "r" / "mlm" / "m"
    folder.mkdir(parents=True)
    (folder / "analytical_overlap_summary.csv").write_text("model_name,model_type,child_name,speaker,N,S\nx/m,mlm,c,child,2,5\n")
    row = results.overlap_summaries(spark, f"{tmp_path}/r").first()
    assert (row.model_name, row.N) == ("m", 2)
    registry = spark.createDataFrame([("x/m", "m")], "name string, base_name string")
    named = results.with_full_names(spark.createDataFrame([("m",), ("q",)], "model_name string"), registry).collect()
    assert {(r.model_name, r.full_name) for r in named} == {("m", "x/m"), ("q", "q")}
    old = spark.createDataFrame([("model_argmax", 4, 1), ("human", 0, 0)], "method string, n_total int, n_maintained int")
    assert [(r.method, r.tpr, r.maintenance_rate) for r in results.switch_rates(old).collect()] == [("argmax", 0.75, 0.25), ("human", None, None)]
    assert results.latex(spark.createDataFrame([("a_b", "check (0.2)")], "model string, test string")) == "\\begin{tabular}{ll}\nmodel & test \\\\\na\\_b & $\\checkmark$ (0.2) \\\\\n\\end{tabular}\n"


def test_frames(spark):
    d = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert frames.require(d, ["a"]) is d and d.select(frames.first_available(d, "z", "b")).columns == ["b"]
    for bad in (lambda: frames.require(d, ["z"]), lambda: frames.first_available(d, "z")):
        with pytest.raises(ValueError):
            bad()
    assert frames.filter_if_any(d, F.col("a") > 1).count() == 1 and frames.filter_if_any(d, F.col("a") > 5).count() == 2
    assert frames.drop_missing(d).count() == 1 and frames.drop_missing(d, "a").count() == 2
    assert frames.union_all(d, d.select("a")).count() == 4 and d.select(frames.rate(F.lit(1), F.col("a") - 1).alias("r")).first().r is None


def test_last_mentions_over_a_stream(spark, tmp_path):
    from dyadica.streaming import last_mention

    shape = "session long, item string, line_num long, pair_index int, speaker string, det string"
    first = [(1, "d", 1, 1, "mother", "a"), (1, "d", 3, 1, "child", "the"), (2, "d", 1, 1, "child", "a")]
    spark.createDataFrame(first, shape).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = last_mention.transitions(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("mentions_out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.session, r.line_num, r.previous_det, r.previous_speaker) for r in spark.table("mentions_out").collect()} == {(1, 1, None, None), (1, 3, "a", "mother"), (2, 1, None, None)}


def test_predictions_of_all_sites_are_not_broadcast(spark):
    from dyadica.catalogue import frame

    plan = frame(spark, SF, "SELECT * FROM model_dyads", always=["predictions"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [session" in plan and "BroadcastHashJoin [session" not in plan


def test_scores_of_sites_equal_a_loop_where_a_sentence_holds_the_blanks_sign(spark):
    from dyadica.plans.ngram import Model
    from dyadica.plans.store import Store

    corpus = spark.createDataFrame([("the cat saw a dog",), ("a cat ___ the dog",)], "text string")
    model = Model(corpus, Store(spark), "")
    text = "so ___ the cat saw a dog"
    sites = spark.createDataFrame([(1, text, "the", 7, 10), (2, text, "a", 19, 20)], "k int, sentence string, form string, det_char_start int, det_char_end int")
    got = {(r.k, r.form): r.log_p for r in model.score_sites(sites, ["k"], ["a", "the"], "x").collect()}
    words, expected = ["so", "the", "cat", "saw", "a", "dog"], {}
    grams = lambda w: list(zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False))
    wanted = {(k, f): grams(words[:at] + [f] + words[at + 1 :]) for k, at in ((1, 1), (2, 4)) for f in ("a", "the")}
    every = sorted({g for v in wanted.values() for g in v})
    p = {(r.a, r.b, r.c): r.log_p for r in model.log_probabilities(spark.createDataFrame(every, "a string, b string, c string")).collect()}
    expected = {k: sum(p[g] for g in v) for k, v in wanted.items()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], abs_tol=1e-9) for k in got)
