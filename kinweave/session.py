"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(name: str = "kinweave", cpus: int | str = "*", **conf: object) -> SparkSession:
    """A local session with the settings the operators are written for; on a cluster pass the cluster's own."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k: str(v) for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables: below the shared folder that spark.checkpoint.dir names.

    Where that setting is absent (local tests) a temporary folder of this machine is used, which only a
    single-machine session may do; on a cluster without the setting this raises.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "kinweave-checkpoints")
        sc.setCheckpointDir(folder)
    folder = f"{sc.getCheckpointDir()}/kinweave-{sc.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, sc, folder)
    return folder


_FOLDERS: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(sc: SparkContext, path: str) -> None:
    try:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # the JVM has gone; the folder of a finished application holds nothing that is read again
        pass


def _storable(df: DataFrame) -> bool:
    """Whether Parquet can hold df: no void or interval column, no names that differ in case only."""
    plain = not any(x in kind for _, kind in df.dtypes for x in ("void", "interval"))
    return plain and len({c.lower() for c in df.columns}) == len(df.columns)


def scratch_path(spark: SparkSession) -> str:
    """A new path for a table that goes with the application."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of what runs inside as soon as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder and read from there: its lineage ends.

    Executors may be lost afterwards, and the optimiser knows the table's true size. Partitions and their order are not
    kept, so row numbers and partition numbers must be columns of df. What Parquet cannot hold is checkpointed.
    """
    return cut_counting(df)[0]


def cut_counting(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut, and aggregates of df that are observed while it is written."""
    spark = df.sparkSession
    seen = Observation() if measures else None
    if seen:
        df = df.observe(seen, *[c.alias(k) for k, c in measures.items()])
    path = scratch_path(spark)
    if _storable(df):
        with _shuffles_deleted(spark):
            df.write.parquet(path)
        table = spark.read.schema(df.schema).parquet(path)
        table._cut_at = path
    else:
        table = df.checkpoint(eager=True)
    return table, dict(seen.get) if seen else {}


def cut_parts(spark: SparkSession, frames: Iterable[DataFrame]) -> DataFrame:
    """cut of the union of frames of one storable schema, of which there is one at least. They are written one after the other, so that
    the disk holds the shuffle files of one at a time."""
    path = scratch_path(spark)
    for df in frames:
        with _shuffles_deleted(spark):
            df.write.mode("append").parquet(path)
        schema = df.schema
    table = spark.read.schema(schema).parquet(path)
    table._cut_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete cut tables that nothing will read again, as in loops; the others go with the application."""
    for t in tables:
        if path := getattr(t, "_cut_at", None):
            _delete(t.sparkSession.sparkContext, path)
