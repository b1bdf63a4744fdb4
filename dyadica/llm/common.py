"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Of a row group of whole texts: a task that writes some holds one of them.
GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one in the warehouse, which they share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_dyadica"
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return folder.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one. It is deleted when the driver ends, with all that was written for results it has read by then."""
    folder = f"{shared_dir(spark)}/dyadica-{spark.sparkContext.applicationId}"
    if folder not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _made.add(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what runs inside; then the session's setting holds again. Texts and lists may be long."""
    return _set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def long_rows(spark: SparkSession, rows: int = 256):
    """Batches of at most so many rows where what runs inside reads parquet files or passes rows to Python.

    By default a task holds 4,096 whole texts as it reads, and 10,000 more as it passes them on: some 100 MB for each of an executor's cores.
    """
    return _set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.parquet.columnarReaderBatchSize": str(rows)})


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """df, written as a table into the shared folder and read again: lineage ends there and a lost executor costs nothing. group_bytes: of a row group, which a task's writer and a later reader hold whole."""
    path = fresh_path(df.sparkSession, name)
    for paths in _noted:
        paths.append(path)
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_noted: list[list[str]] = []


@contextlib.contextmanager
def noted():
    """The paths of tables that written() makes inside."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted[:] = [x for x in _noted if x is not paths]


def folders_of(df: DataFrame) -> set[str]:
    """The folders of the files that df reads."""
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def drop_folders(spark: SparkSession, folders) -> None:
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in frames:
        drop_folders(df.sparkSession, folders_of(df))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """text with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_common(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """rows joined to groups (unique keys; weight: how many rows have them), where a key may be in most of the rows. how: left, or inner for the rows of these groups alone.

    At most 1,000 keys are in a thousandth or more of the rows: those are joined by a broadcast, the rest by a shuffle.
    Both inputs are read twice, so they should be written tables.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    common = F.col(weight) * 1000 >= total
    if how == "inner":
        hot = groups.where(common).limit(1000)
        rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(~common), keys)
        return rows.join(F.broadcast(hot), keys).unionByName(rest)
    more = [c for c in groups.columns if c not in keys]
    hot = groups.where(common).limit(1000).select(*keys, *more, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    rest = marked.where("_hot is null").drop("_hot", *more).join(groups.where(~common), keys, "left")
    return marked.where("_hot").drop("_hot").unionByName(rest)
