"""Shared-folder materialisation and size-checked broadcast, used by every subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder of this machine is made once, under a local master
    only, as in tests; anywhere else the setting is required.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return f"file://{_local_dir}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage with a table that survives lost executors, and keeps the columns compressed
    (``checkpoint()`` would write uncompressed rows). The table stays until :func:`drop_tables`.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path, through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """A point in the list of tables that :func:`materialize` has written in this process."""
    return len(_written)


def drop_tables(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete what :func:`materialize` has written since ``mark()`` gave ``since``, before it gave ``until``.

    Call it when the results that read those tables have been written or collected.
    """
    for path in _written[since:until]:
        drop_path(spark, path)
    del _written[since:until]


class Scratch:
    """Tables in the shared folder that a computation drops itself as soon as nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """:func:`materialize`, remembered."""
        table = materialize(df, name)
        self._paths[id(table)] = (table, _written[-1])
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all that were kept; no DataFrame still to be evaluated may read them."""
        for key in [id(t) for t in tables] or list(self._paths):
            _, path = self._paths.pop(key)
            _written.remove(path)
            drop_path(self.spark, path)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the order of ``by`` as column ``name``, without a global window.

    Rows are range-partitioned and written once; a row's number is its place in its partition plus the rows of the
    partitions before, of which one count each is needed. Equal keys are numbered in no particular order.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered")
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a task
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    table = spark.createDataFrame(starts or [(-1, 0)], "_part long, _start long")
    out = placed.join(F.broadcast(table), part == F.col("_part"))
    return out.withColumn(name, F.col("_start") + inside).drop("_place", "_part", "_start")


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Hint a broadcast only when a count proves that ``df`` has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
