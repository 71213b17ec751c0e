"""Session helpers: reliable storage for state that is read more than once."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def folder_for(master: str, named: str | None, warehouse: str | None) -> str:
    """The checkpoint folder the session names, else one below a warehouse that nodes share.

    A temporary folder will do only where driver and tasks are one process (tests).
    """
    if named:
        return named
    if master.startswith("local") and not master.startswith("local-cluster"):
        return tempfile.mkdtemp(prefix="shelfcast-")
    if warehouse and "://" in warehouse and not warehouse.startswith("file:"):
        return f"{warehouse.rstrip('/')}/shelfcast-intermediate"
    raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder_for(sc.master, spark.conf.get("spark.checkpoint.dir", None),
                                       spark.conf.get("spark.sql.warehouse.dir", None)))
    return sc.getCheckpointDir()


def state_of(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the tables in a folder and their files: it changes when they are rewritten."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ""
    found = []
    for top in fs.listStatus(path):
        for f in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            found.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iterative job's state to reliable storage, so lost executors do not replay the loop."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """A frame that is read several times, as parquet in the shared folder: readers take only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions of at most about ``per_task`` rows, one per core at least: a task's memory doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))


_WRITTEN: dict[tuple[str, str, str, str], str] = {}


def written_once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame],
                 sort_by: list[str] | None = None) -> DataFrame:
    """An intermediate table, written as parquet to the shared folder on first use and read from then on.

    Bronze, silver, gold and forecasts are tables that many reports read; recomputing them per
    report would repeat the expensive shuffles. Rewritten sources are noticed, and built from anew. Parquet keeps column pruning and filter pushdown.
    """
    key = (spark.sparkContext.applicationId, source, name, state_of(spark, source))
    try:
        if key in _WRITTEN:
            return spark.read.parquet(_WRITTEN[key])
    except AnalysisException:
        del _WRITTEN[key]  # someone cleared the folder: write it again
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df = build()
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        df.write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
