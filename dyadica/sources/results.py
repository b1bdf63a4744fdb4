"""Results of models: loaders, pair files and tables for papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import first_available, rate, require

METHODS = {"argmax": "predicted_det_argmax", "sample": "predicted_det_sample"}
#: Names that older files use for the same methods.
METHOD_NAMES = {"predicted_argmax": "argmax", "model_argmax": "argmax", "predicted_sample": "sample", "model_sample": "sample", "human": "human"}


def base_name(name: Column) -> Column:
    """The part behind the last slash."""
    return F.trim(F.element_at(F.split(name, "/"), -1))


def overlap_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Files `root/<type>/<model>/analytical_overlap_summary.csv` as one table, models by base name."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{root.rstrip('/')}/*/*/analytical_overlap_summary.csv")
    return rows.withColumn("model_name", base_name(F.col("model_name")))


def accuracy(predictions: DataFrame) -> DataFrame:
    """Share of sites whose determiner a model predicts, by model, type, child, speaker and method."""
    keys = ["model_name", "model_type", "child_name", "speaker"]
    require(predictions, [*keys, "original_det"])
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("said")) for m, c in METHODS.items() if c in predictions.columns])).alias("s")
    rows = predictions.select(*keys, "original_det", stack).where("s.said IS NOT NULL")
    return rows.groupBy(*keys, F.col("s.method").alias("method")).agg(F.avg((F.col("s.said") == F.col("original_det")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def switch_rates(results: DataFrame) -> DataFrame:
    """Result tables of any age with tpr as the switch rate: from tpr_overall, an older name, or the counts. The maintenance rate stands apart."""
    names = [c for c in ("tpr_overall", "overall_switch_rate", "switch_rate") if c in results.columns]
    counted = rate(F.col("n_total") - F.col("n_maintained"), F.col("n_total")) if {"n_total", "n_maintained"} <= set(results.columns) else F.lit(None).cast("double")
    out = results.withColumn("tpr", F.coalesce(*[F.col(c) for c in names], counted)).withColumn("maintenance_rate", 1 - F.col("tpr"))
    known = F.create_map(*[F.lit(x) for pair in METHOD_NAMES.items() for x in pair])
    method = first_available(results, "method", "source") if {"method", "source"} & set(results.columns) else F.lit("human")
    return out.withColumn("method", F.coalesce(F.try_element_at(known, F.lower(method)), F.lower(method)))


def with_full_names(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows with full_name, by the registry's base names; a name that isn't there stays as it is. The registry is one file of models."""
    names = registry.groupBy("base_name").agg(F.min("name").alias("full_name"))
    return rows.withColumn("base_name", base_name(F.col("model_name"))).join(F.broadcast(names), "base_name", "left").withColumn("full_name", F.coalesce("full_name", "model_name"))


def write_pairs(predictions: DataFrame, path: str) -> None:
    """Text files `det noun` in folders by model, child, speaker and method."""
    keys = ["model_type", "model_name", "child_name", "speaker"]
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("said")) for m, c in METHODS.items()])).alias("s")
    rows = predictions.select(*[F.regexp_replace(k, "/", "_").alias(k) for k in keys], "noun", stack)
    rows.select(*keys, F.col("s.method").alias("method"), F.concat_ws(" ", "s.said", "noun").alias("value")).write.mode("overwrite").partitionBy(*keys, "method").text(path)


def latex(table: DataFrame, rows: int = 1000) -> str:
    """A LaTeX tabular of a report's table, in the order of its columns, by its first column; a report has few rows, and more than `rows` are an error."""
    found = table.orderBy(*table.columns).limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows")
    marks = {"check": r"$\checkmark$", "cross": r"$\times$"}

    def cell(x) -> str:
        text = "" if x is None else str(x)
        for a in ("\\", "&", "%", "_", "#", "$"):
            text = text.replace(a, r"\textbackslash{}" if a == "\\" else "\\" + a)
        for word, sign in marks.items():
            text = text.replace(word, sign) if text.split(" ")[0] == word else text
        return text

    lines = [" & ".join(map(cell, table.columns)), *(" & ".join(map(cell, r)) for r in found)]
    return "\\begin{tabular}{" + "l" * len(table.columns) + "}\n" + " \\\\\n".join(lines) + " \\\\\n\\end{tabular}\n"
