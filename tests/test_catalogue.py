import math
import random

import duckdb
import pandas as pd
import pytest

from dyadica import catalogue
from dyadica.dialect import DUCKDB, SPARK
from dyadica.functions import formulas

SF = "/root/testdata/sf0.001"


def cells(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert cells(catalogue.QUERIES[name](spark, SF).toPandas()) == cells(duck.execute(catalogue.SQL[name]).fetchdf())


def test_predicted_overlap_equals_a_loop(spark):
    n, s, b = 40, 120, 0.8
    h = sum(1 / r for r in range(1, n + 1))
    p = [1 / (r * h) for r in range(1, n + 1)]
    expected = sum(1 - (x * b + 1 - x) ** s - (x * (1 - b) + 1 - x) ** s + (1 - x) ** s for x in p) / n
    for d, run in ((SPARK, lambda q: spark.sql(q).first()[0]), (DUCKDB, lambda q: duckdb.connect().execute(q).fetchone()[0])):
        assert math.isclose(run(f"SELECT {formulas.predicted_overlap(d, str(n), str(s), 'CAST(0.8 AS DOUBLE)', 'h')} FROM (SELECT {formulas.harmonic(d, str(n))} AS h) x"), expected, rel_tol=1e-12)


def test_p_values_agree_with_the_beta_function(spark):
    from dyadica.functions.stats import t_p_value

    for df in (1, 2, 3, 4, 5, 11, 16):
        for t in (0.1, 0.7, 2.0, 4.5):
            got = spark.sql(f"SELECT {formulas.p_value(SPARK, f'CAST({t} AS DOUBLE)', str(df))}").first()[0]
            assert math.isclose(got, t_p_value(t, df), abs_tol=1e-12)


def test_last_mention_equals_a_loop(spark):
    from dyadica.operators.relations import parts

    rng = random.Random(3)
    rows = [(1, rng.randrange(3), line, 1, rng.choice(["child", "mother", "other_adult", None]), rng.choice("ab"), rng.choice(["a", "the"])) for line in range(120)]
    spark.createDataFrame(rows, "dyad int, session int, line_num int, pair_index int, speaker string, item string, det string").selectExpr("*", "'s' AS sentence", "0 AS pos", "0 AS upto", "0 AS tokens").createOrReplaceTempView("sites_case")
    p = parts(SPARK)
    text = f"WITH sites AS (SELECT * FROM sites_case), mentions AS ({p['mentions']}), transitions AS ({p['transitions']}) SELECT session, line_num, previous_det FROM transitions"
    last, expected = {}, set()
    for _, session, line, _, speaker, item, det in rows:
        if speaker is None:
            continue
        before = last.get((session, item))
        if before and before[1] == ("child" if speaker == "mother" else "mother"):
            expected.add((session, line, before[0]))
        last[session, item] = (det, speaker)
    assert {tuple(r) for r in spark.sql(text).collect()} == expected


def test_a_word_is_held_between_ascii_boundaries_in_any_case(spark):
    rows = [("la école", "école"), ("laÉcole x", "école"), ("zécole", "école"), ("dé ab", "ab"), ("déab", "ab"), ("ÉTÉ", "été"), ("x ÀB", "àb"), ("vÀb", "àb"), ("v_ab", "ab"), ("the ſo", "so"), ("aéb AÉB", "aéb"), ("aıa", "aia"), ("aİa", "aia"), ("a.b", "a"), ("", "a"), (None, "a")]
    text, word = (f"SELECT text, word, {d.holds_word('text', 'word')} AS held FROM " for d in (SPARK, DUCKDB))
    spark.createDataFrame(rows, "text string, word string").createOrReplaceTempView("held_words")
    values = duckdb.connect()
    values.execute("CREATE TABLE held_words (text VARCHAR, word VARCHAR)")
    values.executemany("INSERT INTO held_words VALUES (?, ?)", rows)
    assert {tuple(r) for r in spark.sql(text + "held_words").collect()} == set(values.execute(word + "held_words").fetchall())
