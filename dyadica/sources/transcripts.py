"""Transcripts, pair lists, model registries and predictions as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.textnorm import clean


def _before(rows: DataFrame, *sums: Column) -> DataFrame:
    """file, block and the sums over the blocks that come earlier in the file. rows are grouped by block first, so a window holds a row for each of a file's splits."""
    names = [f"before_{i}" for i in range(len(sums))]
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(*[x.alias(n) for x, n in zip(sums, names, strict=True)])
    return blocks.select("file", "block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names])


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, line, whether it is UTF-8): files are read in splits, `block` being a split's offset; within a split ids follow the lines, without gaps."""
    own = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", True).text(path).select(*own, F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"), F.is_valid_utf8("value").alias("valid"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, line) of the readable files, n counting a file's lines from 0 however it is split. No line is shuffled but to the table of splits."""
    raw = _raw(spark, path)
    splits = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n_lines"), F.min("valid").alias("valid"))
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", (F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.min("valid").over(whole).alias("valid")).where("valid")
    return raw.drop("valid").join(starts, ["file", "block"]).select("file", "block", (F.col("id") + F.col("shift")).alias("n"), "line")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """Files that the readers skip, with the reason: `encoding` where a line isn't UTF-8, `damaged` where no line can be read, though the file isn't empty. Of an archive the lines before the damage are read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    found = _raw(spark, path).groupBy("file").agg(F.min("valid").alias("valid"))
    key = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  # the two readers write local paths in two ways
    joined = files.withColumn("key", key("file")).join(found.select(key("file").alias("key"), "valid"), "key", "left")
    return joined.where("valid IS NULL OR NOT valid").select("file", F.when(F.col("valid").isNull(), "damaged").otherwise("encoding").alias("reason"))


def chat(spark: SparkSession, root: str, *, join_continuations: bool = False, fix_yyy: bool = False) -> DataFrame:
    """CHAT files `root/<child>/*.cha` as (child_name, filename, speaker, sentence, line_num, speaker_type).

    A line is speaker, tab, sentence; lines without a speaker or a sentence have no number. Only `*CHI:` and `*MOT:` stay,
    normalised, if any text is left. Files with a line that isn't UTF-8 are skipped (`unreadable` names them). join_continuations: lines that begin with a tab go on with the line before.
    """
    lines = _lines(spark, f"{root.rstrip('/')}/*/*.cha")
    of_split = Window.partitionBy("file", "block").orderBy("n")
    if join_continuations:
        begin = F.when(F.col("line").startswith("\t"), 0).otherwise(1)
        marked = lines.withColumn("own", F.sum(begin).over(of_split)).join(_before(lines, F.sum(begin)), ["file", "block"])
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.trim("line").alias("line")))), lambda x: x["line"]), " ")
        # A line that goes on in the next split belongs to the split where it begins.
        lines = marked.groupBy("file", (F.col("own") + F.col("before_0")).alias("whole")).agg(F.min(F.struct("n", "block")).alias("at"), joined.alias("line")).select("file", F.col("at.block").alias("block"), F.col("at.n").alias("n"), "line")
    parts = F.split("line", "\t", 2)
    rows = lines.select("file", "block", "n", F.get(parts, F.lit(0)).alias("speaker"), F.get(parts, F.lit(1)).alias("sentence")).where("speaker <> '' AND sentence IS NOT NULL AND sentence <> ''")
    rows = rows.withColumn("own", F.row_number().over(of_split)).join(_before(rows, F.count("*")), ["file", "block"]).withColumn("line_num", (F.col("own") + F.col("before_0") - 1).cast("int"))
    kind = F.when(F.col("speaker").contains("*CHI:"), "child").when(F.col("speaker").contains("*MOT:"), "mother")
    path = F.split("file", "/")
    out = rows.select(F.element_at(path, -2).alias("child_name"), F.element_at(path, -1).alias("filename"), "speaker", clean(F.col("sentence"), fix_yyy).alias("sentence"), "line_num", kind.alias("speaker_type"))
    return out.where("speaker_type IS NOT NULL AND trim(sentence) <> ''")


def corpus(store, root: str, **options) -> DataFrame:
    """chat()'s rows as a table of a store, which is made anew only for other files or options."""
    from ..plans.store import signature

    return store.relation("corpus", f"{signature(store.spark, root)}{sorted(options.items())}", lambda: chat(store.spark, root, **options))


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Files `root/*.cha` of lines `session speaker sentence`, of the columns of chat(); other speakers than CHI and MOT are other adults."""
    parts = F.split(F.trim("line"), r"\s+", 3)
    rows = _lines(spark, f"{root.rstrip('/')}/*.cha").where(F.size(parts) == 3)
    speaker = F.regexp_replace(F.get(parts, F.lit(1)), "[*:]", "")
    kind = F.when(speaker == "CHI", "child").when(speaker == "MOT", "mother").otherwise("other_adult")
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.cha$", "")
    return rows.select(name.alias("child_name"), F.get(parts, F.lit(0)).alias("filename"), speaker.alias("speaker"), clean(F.get(parts, F.lit(2))).alias("sentence"), F.col("n").alias("line_num"), kind.alias("speaker_type")).where("trim(sentence) <> ''")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Counts of `det noun` lines; other lines are skipped."""
    words = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(words) == 2).select(F.get(words, F.lit(0)).alias("det"), F.get(words, F.lit(1)).alias("noun")).groupBy("det", "noun").count()


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Models of a JSON array, with the last part of the name."""
    models = spark.read.schema("name string, type string, description string").option("multiLine", True).json(path)
    return models.where(F.col("type").isin("mlm", "ar", "seq2seq")).withColumn("base_name", F.element_at(F.split("name", "/"), -1))


PREDICTION_KEYS = ("model_type", "model_name", "child_name", "speaker")


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("append").partitionBy(*PREDICTION_KEYS).parquet(path)


def read_predictions(spark: SparkSession, path: str, model_types=("mlm", "ar", "seq2seq")) -> DataFrame:
    """Predictions, pruned to folders of the given types."""
    return spark.read.option("basePath", path).parquet(path).where(F.col("model_type").isin(*model_types))


def missing(work: DataFrame, done: DataFrame, keys=PREDICTION_KEYS) -> DataFrame:
    """The work whose keys have no results yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
