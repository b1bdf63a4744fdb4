"""What the pipeline's stages leave in the shared folder."""

import os

import corpus_pipeline
from dyadica.llm import common

SF = "/root/testdata/sf0.001"


def tables(spark):
    return set(os.listdir(common.run_dir(spark).removeprefix("file://")))


def test_stages_drop_what_earlier_ones_left(spark, tmp_path):
    """Stages as a caller runs them that writes each result: only the last stage's tables lie beside those of before."""
    before, docs, rows = tables(spark), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        mine = {name.rpartition("-")[0] for name in tables(spark) - before}
        assert not k or not mine & {"ratios", "kept"}  # the first stage's
        assert k < 2 or "harmless" not in mine
        assert k < 3 or not mine & {"found", "runs", "kept-ids"}
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        rows.append(docs.count())
    assert rows == sorted(rows, reverse=True) and rows[-1]


def test_stages_keep_what_is_still_read(spark):
    """A result that goes on without having been written is not dropped under its reader."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    out = corpus_pipeline.STAGES[1][1](spark, kept.where("doc_id >= 0"), SF)
    assert kept.count() >= out.count() > 0


def test_run_leaves_its_result_alone(spark):
    before = tables(spark)
    out = corpus_pipeline.run(spark, SF)
    assert {name.rpartition("-")[0] for name in tables(spark) - before} == {"best-fit-packing"} and out.count()
