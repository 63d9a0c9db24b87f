"""Session settings and places for intermediate data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, list[str]] = {}
# Where true, the files of a query's shuffles are removed when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Check the one setting the operators rely on: times are read in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    session whose executors are threads of this machine gets a temporary
    folder; any other is refused, as its executors would not see one.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="triagelake-")
    return _local[app]


_local: dict[str, str] = {}


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.conf.get("spark.app.id", ""), []).append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Remove every folder this session made by ``new_dir``, once their
    results have been written; returns how many there were."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = _made.pop(spark.conf.get("spark.app.id", ""), [])
    removed = 0
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        removed += where.getFileSystem(conf).delete(where, True)
    return removed


def discard(df: DataFrame) -> None:
    """Remove the files of a ``checkpoint`` that a later one has taken the place of."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def measured(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, a written table of a few numbers per row, marked for broadcast
    if it has at most ``rows`` rows; else the planner shuffles it."""
    return F.broadcast(df) if df.count() <= rows else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared folder, and go on from the files.

    This cuts the lineage like a reliable checkpoint and survives lost
    executors; the files also give later joins a measured size and columns
    to prune.  Nothing reads the step's shuffles again, so their files go with
    it and do not add up over the steps of a job.
    """
    spark = df.sparkSession
    path = new_dir(spark, "step")
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)
