"""Reading tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from triagelake.session import prepare
from triagelake.sources import csv


WHOLE_FILES = {"quote", "escape", "comment", "encoding", "charset", "header", "linesep", "multiline"}
# Tables of long texts, with the key to spread them by.
TEXT_TABLES = {"documents": "doc_id"}


class Tables:
    """Parquet tables of one folder, opened by attribute name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(self.path(name))
        return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a piece of a table stored in fewer pieces than cores.

    Text work is bound by CPU, and a file is read by one task per row group.
    A large table has more pieces than the cluster has cores and is left
    where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, naming every column a later step would miss."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, **options
) -> DataFrame:
    """Header CSV with quoted multi-line text; the schema is explicit.

    Files are cut into ranges that many tasks read.  Options that change how a
    quote or a line is told need whole files, one task each.
    """
    if not {k.lower() for k in options} & WHOLE_FILES:
        return csv.read(spark, path, schema, **options)
    reader = spark.read.schema(schema).option("header", True)
    reader = reader.option("multiLine", True).option("escape", '"')
    # An empty quoted string is text, an empty field is NULL.
    return reader.options(**options).csv(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options):
    """Named table scan; ``fmt='jdbc'`` reads a database table."""
    return spark.read.format(fmt).options(**options).load(path or None)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str):
    """The table at ``path``, or an empty one with ``schema`` if absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
