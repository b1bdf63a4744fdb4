import json
import random

import pytest
from pyspark.sql import functions as F

from dyadica.functions import cac
from dyadica.functions.textnorm import clean
from dyadica.plans.store import Store
from dyadica.sources import transcripts


def test_cleaner(spark):
    # Golden rows: text and what the rules leave of it.
    cases = [("the xxx dog", "the dog"), ("yyy yyyy", "yyy"), ("<the dog> [/] the dog", "the dog"), ("wug [/] wug", "wug"), ("é::", "é"), ("go +//.", "go /."), ("&=laughs hi @s", "hi"), ("ice+cream .", "ice cream."), ("wait (1.5) , now", "wait, now"), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in cases], "t string").select(clean(F.col("t"))).collect()
    assert [r[0] for r in got] == [b for _, b in cases]


def test_chat_and_sessions(spark, tmp_path):
    (tmp_path / "anne").mkdir()
    (tmp_path / "anne" / "010101.cha").write_text("@Begin\n*CHI:\tthe dog xxx .\n%mor:\tx\n*MOT:\ta dog ?\n\tmore of it\n*FAT:\tno\n*CHI:\txxx\n")
    rows = transcripts.chat(spark, str(tmp_path)).orderBy("line_num").collect()
    assert [(r.child_name, r.filename, r.speaker_type, r.sentence, r.line_num) for r in rows] == [("anne", "010101.cha", "child", "the dog.", 0), ("anne", "010101.cha", "mother", "a dog?", 2)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "d1.cha").write_text("1 *CHI: the dog\n1 *FAT: a dog\n\n2 *MOT: hello\n")
    rows = transcripts.sessions(spark, str(tmp_path / "s")).orderBy("line_num").collect()
    assert [(r.child_name, r.filename, r.speaker_type, r.line_num) for r in rows] == [("d1", "1", "child", 0), ("d1", "1", "other_adult", 1), ("d1", "2", "mother", 3)]


@pytest.mark.parametrize("joined", [False, True])
def test_lines_of_files_in_many_splits(spark, tmp_path, joined):
    rng = random.Random(3)
    files = {}
    for name in ("a", "b", "c"):
        (tmp_path / "k").mkdir(exist_ok=True)
        files[name] = [rng.choice([f"*CHI:\tw{i} é", f"*MOT:\tthe w{i}", "\tmore", "%mor:\tx", "", "@End", "*FAT:\tno\tx"]) for i in range(rng.choice([400, 900]))]
        (tmp_path / "k" / f"{name}.cha").write_text(rng.choice(["\n", "\r\n"]).join(files[name]) + rng.choice(["", "\n"]), newline="")
    (tmp_path / "k" / "bad.cha").write_bytes(b"*CHI:\tgood\n" * 300 + b"*CHI:\t\xff\xfe\n")
    (tmp_path / "k" / "broken.cha.gz").write_bytes(b"no archive" * 9)
    want = set()
    for name, lines in files.items():
        if joined:
            whole = []
            for line in lines:
                if line.startswith("\t") and whole:
                    whole[-1] += " " + line.strip(" ")
                else:
                    whole.append(line.strip(" "))
            lines = whole
        parts = [x.split("\t", 1) for x in lines]
        numbered = enumerate(p for p in parts if len(p) == 2 and p[0] and p[1])
        want |= {(f"{name}.cha", i, s, " ".join(t.split())) for i, (s, t) in numbered if s in ("*CHI:", "*MOT:")}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        raw = transcripts._raw(spark, f"{tmp_path}/*/*.cha")
        assert raw.select("file", "block").distinct().count() > 30
        rows = transcripts.chat(spark, str(tmp_path), join_continuations=joined).collect()
        assert len(rows) == len(want) and {(r.filename, r.line_num, r.speaker, r.sentence) for r in rows} == want
        bad = {(r.file.rsplit("/", 1)[1], r.reason) for r in transcripts.unreadable(spark, f"{tmp_path}/*/*").collect()}
        assert bad == {("bad.cha", "encoding"), ("broken.cha.gz", "damaged")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_corpus_is_read_once(spark, tmp_path):
    (tmp_path / "in" / "k").mkdir(parents=True)
    (tmp_path / "in" / "k" / "a.cha").write_text("*CHI:\tthe dog\n")
    for _ in range(2):
        store = Store(spark, str(tmp_path / "out"))
        assert transcripts.corpus(store, str(tmp_path / "in")).count() == 1
    assert store.made == []
    (tmp_path / "in" / "k" / "b.cha").write_text("*MOT:\ta dog\n")
    assert transcripts.corpus(store, str(tmp_path / "in")).count() == 2 and store.made == ["corpus"]


def test_pairs_registry_predictions(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a dog\nthe dog\na dog\nbad\n")
    assert {tuple(r) for r in transcripts.pairs(spark, str(tmp_path / "p.txt")).collect()} == {("a", "dog", 2), ("the", "dog", 1)}
    (tmp_path / "m.json").write_text(json.dumps([{"name": "x/y", "type": "ar", "description": ""}, {"name": "z", "type": "odd"}]))
    assert [r.base_name for r in transcripts.registry(spark, str(tmp_path / "m.json")).collect()] == ["y"]
    done = spark.createDataFrame([("ar", "y", "anne", "child", 0.5)], "model_type string, model_name string, child_name string, speaker string, P_a double")
    transcripts.write_predictions(done, str(tmp_path / "out"))
    read = transcripts.read_predictions(spark, str(tmp_path / "out"))
    work = done.unionByName(done.withColumn("child_name", F.lit("ben")))
    assert read.count() == 1 and [r.child_name for r in transcripts.missing(work, read).collect()] == ["ben"]


def test_readouts(spark):
    probs = cac.distribution(F.from_json("j", "map<string,double>"), {"a": ["a", "an"], "the": ["the"]})
    df = spark.createDataFrame([('{"a": -1, "an": -1, "the": -1}',), ("{}",), ('{"the": -2}',)], "j string").select(probs.alias("p"))
    rows = df.select("p", cac.argmax(F.col("p"), ["a", "the"]).alias("m"), cac.determiner_argmax(F.col("p")).alias("d"), cac.mass_on(F.col("p"), ["a", "the"]).alias("s"), cac.surprisal(F.col("p"), "a").alias("i"), cac.draw(F.col("p"), ["a", "the"], F.lit(1)).alias("x")).collect()
    assert abs(rows[0].p["a"] - 2 / 3) < 1e-12 and rows[1].p["a"] == 0.5 and rows[2].p["the"] == 1
    assert [r.m for r in rows] == ["a", "a", "the"] and rows[1].d == "the" and rows[2].i == float("inf") and rows[2].x == "the"
    assert all(abs(r.s - 1) < 1e-12 for r in rows)
