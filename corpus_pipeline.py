"""A training corpus from documents: quality rules, toxicity, near copies, packing. Each stage works on what the last one kept.

A stage of STAGES begins when the result of the one before has been written (by `run`, or whoever calls the stages), so it
first drops the tables that the earlier stage made and that its own documents don't read: else each stage's texts would lie in the shared folder
twice until the driver ends. The operators' own `stage` functions drop nothing of each other's.
"""

import functools

from dyadica.llm import jaccard, packing, quality, toxicity
from dyadica.llm.common import drop_folders, drop_written, folders_of, noted, table, written

_left: list[str] = []


def _drop_left(spark, docs):
    """Drop what the stage before has made, without what docs reads."""
    read = {folder.rpartition("/")[2] for folder in folders_of(docs)}  # table names are unique, their folders' schemes may differ
    over = [path for path in _left if path.rpartition("/")[2] not in read]
    drop_folders(spark, over)
    _left[:] = [path for path in _left if path not in over]


def _alone(stage):
    @functools.wraps(stage)
    def begun(spark, docs, sf_dir):
        _drop_left(spark, docs)
        with noted() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return begun


STAGES = [
    ("quality rules", _alone(quality.stage)),
    ("toxicity", _alone(toxicity.stage)),
    ("n-gram Jaccard join", _alone(jaccard.stage)),
    ("best-fit packing", _alone(packing.stage)),
]
#: Factorization machines and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = given = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not given:
            drop_written(before)
    _drop_left(spark, docs)
    return docs
