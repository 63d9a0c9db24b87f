"""Writing tables, reports and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import fixed


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite"):
    """Write ``df`` and return it as read back from ``path``."""
    df.write.mode(mode).format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> str:
    """CSV with a header.  Multi-line CSV is read one file per task, so the
    rows per file are bounded."""
    writer = df.write.mode("overwrite").option("header", True)
    writer = writer.option("escape", '"').option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)
    return path


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """All counters in one pass, as ``(metric, value)`` rows."""
    totals = df.agg(*[c.cast("long").alias(name) for name, c in metrics.items()])
    return totals.unpivot([], list(metrics), "metric", "value")


def feedback_rows(df: DataFrame, recorded_at: Column) -> DataFrame:
    """Feedback records in the shape the log keeps."""
    return df.select(
        recorded_at.alias("timestamp"),
        F.substring("description", 1, fixed.FEEDBACK_DESCRIPTION_CHARS).alias("description"),
        "source",
        F.col("num_similar").cast("int"),
        F.col("num_steps").cast("int"),
        "useful",
    )


def append_feedback(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def usefulness(spark: SparkSession, path: str, schema) -> DataFrame:
    """Share of useful answers per answer source."""
    log = spark.read.schema(schema).parquet(path)
    useful = F.sum(F.when(F.col("useful") == "yes", 1).otherwise(0))
    return log.groupBy("source").agg(
        F.count("*").alias("answers"),
        useful.alias("useful_answers"),
        F.round(useful / F.count("*"), 6).alias("useful_rate"),
    )
