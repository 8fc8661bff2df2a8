"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Spark frees a finished query's shuffle files when this is on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a temporary folder, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark, "_tallyloom_dir"):
        SparkSession._tallyloom_dir = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, SparkSession._tallyloom_dir, True)
    return f"file://{SparkSession._tallyloom_dir}"


def lean(run):
    """``run``, a function on Arrow batches, that gives memory back to the system when its task ends.

    Python workers outlive their tasks, and what they keep would stand beside the memory of later stages.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_tallyloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="tallyloom-code-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "tallyloom-code.zip", "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(str(folder / "tallyloom-code.zip"))
    context._tallyloom_shipped = True


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries that end in this block leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what reads the table survives the loss of any executor. The files go
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    table = spark.read.schema(df.schema).parquet(path)
    table._tallyloom_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete shared tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._tallyloom_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def input_parts(df: DataFrame, part_bytes: int = 8 << 20) -> int:
    """A partition count that follows the input's size, from the optimizer's estimate of it.

    Rows without an estimate (made by the driver) get twice the default parallelism.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = df.sparkSession.sparkContext.defaultParallelism
    return 2 * least if size > 1 << 52 else max(least, size // part_bytes + 1)


def meet(rows: DataFrame, few: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` and ``few`` (a shared table, its keys unique) in which no hot key lands in one task.

    ``few`` says in ``weight`` how many of the ``total`` rows have a key, at least. Keys with over a thousandth of
    them are under 1,000, so these are broadcast; the rest is shuffled by key. ``weight`` is left out.
    """
    from pyspark.sql import functions as F

    hot = F.col(weight) * 1000 > total
    most = F.broadcast(few.where(hot).drop(weight))
    rest = rows.join(F.broadcast(few.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(most, keys).unionByName(rest.join(few.where(~hot).drop(weight), keys))
