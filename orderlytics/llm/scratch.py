"""Intermediate tables in the folder all executors share, and size-checked broadcasts."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.session import ensure_checkpoint_dir

#: Most rows of a few narrow columns that a join may broadcast; beyond, it shuffles.
BROADCAST_ROWS = 500_000
#: Rows of a few narrow columns that one task writes at least, where a bound is known.
TASK_ROWS = 100_000


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}"


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in no more partitions than those need:
    a small shuffle is read by few tasks, whatever the session's setting."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def table(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back: the
    lineage is cut, each row is computed once, and the loss of an executor loses
    nothing. ``rows`` is about how many it has, if known and narrow, for ``few``.
    ``clear`` removes the folder; until then it may be read again."""
    spark = df.sparkSession
    df = df if rows is None else few(df, rows)
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    _held.setdefault(_folder(spark), set()).add(path)
    return stored


#: Tables that were written and not deleted, by the folder of their application.
_held: dict[str, set[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame | None) -> None:
    """Delete stored tables from which nothing more will be computed."""
    for df in tables:
        if df is not None:
            _delete(df.sparkSession, df.scratch_path)
            _held.get(_folder(df.sparkSession), set()).discard(df.scratch_path)


def release(spark: SparkSession, *kept: DataFrame) -> None:
    """Delete every table this application wrote, but for the tables ``kept``, which
    only ``drop`` and ``clear`` delete from then on, and let Spark delete
    the shuffles of plans that are no longer referred to: it does so for those that the
    driver's garbage collector finds. Call it when what was derived from the tables has
    been stored."""
    keep = {vars(df)["scratch_path"] for df in kept if "scratch_path" in vars(df)}
    for path in _held.get(_folder(spark), set()) - keep:
        _delete(spark, path)
    _held[_folder(spark)] = set()  # the tables kept are the caller's from now on
    forget(spark)


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of plans that are no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete every table this application wrote. Call it when the results that
    were derived from them have been stored."""
    _delete(spark, _folder(spark))
    _held.pop(_folder(spark), None)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table, marked for broadcast when it has at most ``rows``
    rows; otherwise as it is, and the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
