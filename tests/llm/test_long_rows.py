"""Stages that pass whole texts on hold few of them at a time, whatever the session's settings are, and leave these as they were."""

import random
import re

import pyarrow.parquet as pq
import pytest

from dyadica.llm import quality, toxicity

SF = "/root/testdata/sf0.001"
SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


@pytest.mark.parametrize("module", [quality, toxicity])
def test_stages_hold_few_texts(spark, monkeypatch, tmp_path, module):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**9):09d}" for _ in range(500))) for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(1200)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    monkeypatch.setattr(module, "GROUP_BYTES", 1 << 20, raising=False)
    before, seen = [spark.conf.get(x) for x in SETTINGS], []
    if hasattr(module, "written"):
        write = module.written
        monkeypatch.setattr(module, "written", lambda df, name, *a: (seen.append([int(spark.conf.get(x)) for x in SETTINGS]), write(df, name, *a))[1])
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    out = module.stage(spark, docs, f"file://{tmp_path}" if module is quality else SF)
    assert sorted(map(tuple, out.collect())) == rows  # none lost
    assert seen and all(x <= 256 for batch in seen for x in batch) and [spark.conf.get(x) for x in SETTINGS] == before
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in out.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 5 << 20 and max(sizes) < 3 << 20


def test_words_are_found_once(spark):
    """Words, their characters and repeated windows come from one cut of the text, beside one search for symbols; words are those that a search finds."""
    texts = [None, "", " ", "a", " \x0b\x0c\r\n\ta  b\n", "\xa0  b é\U0001f600 x", "\n\nx", "x\t", "a b c d e f a b c d e f"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = quality.score(made, made.limit(0))
    got = {r.doc_id: (r.n_words, r.word_chars) for r in out.collect()}
    found = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(texts)}
    assert got == {i: (len(w), sum(map(len, w))) for i, w in found.items()}
    plan = made.select(*[c.alias(k) for k, c in quality.measures(made.text).items()])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract_all" not in plan
