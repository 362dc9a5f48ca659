"""Tables written to the folder that the driver and the executors share.

A staged table cuts lineage: a lost executor repeats only the work since the
last staged table, and a costly step (tokenising, hashing) runs once although
several later jobs read it.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one if the session is local, else an error.

    On a cluster a local folder would be another one on each machine, and rows
    would be missing without a word.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_root:
        _own_root[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        context.setCheckpointDir(_own_root[context.applicationId])
    return _own_root[context.applicationId]


def _stages(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/tracemill-stages/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str, hashes: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and returns a reader of it; for columns of ``hashes`` dictionaries are not tried."""
    spark = df.sparkSession
    path = f"{_stages(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


def drop_stage(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`stage` returned; later reads of it fail."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stage_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows in a batch that crosses to Python: whole texts have no bound, and 10,000 of them, Spark's default, fill a worker."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def released(function: Callable) -> Callable:
    """``function`` for Arrow batches or groups; afterwards the worker gives its free memory back.

    Python workers outlive tasks, and several stand beside each executor's JVM:
    what their allocators keep would add up over the steps of a job.
    """

    def release() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    if inspect.isgeneratorfunction(function):

        @functools.wraps(function)
        def run(*args):
            yield from function(*args)
            release()

    else:

        @functools.wraps(function)
        def run(*args):
            out = function(*args)
            release()
            return out

    run.__signature__ = inspect.signature(function)
    return run


def spare_names(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before each as make it unlike all columns; Spark does not tell cases apart."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def without(columns: list[str], *names: str) -> list[str]:
    """The columns but those of the names, in whatever case."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def clear_stages(spark: SparkSession) -> None:
    """Deletes all staged tables of this application, for use once results have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stages(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
