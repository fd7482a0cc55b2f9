"""Where intermediate tables go, which is the folder that the driver and all executors share; and the package's code on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has written, with their sessions; removed when it ends.
written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, as in tests, a temporary folder is set, but only if driver and executors are one machine; it goes when the process ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="attestry-")
        spark.conf.set("spark.checkpoint.dir", found)
        written.append((spark, found))
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as computed once, without its lineage. Its files go when the process ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
        written.append((spark, context._jsc.sc().getCheckpointDir().get()))
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """df as computed once, written as Parquet and read again. Unlike a checkpoint it has the size of its files, not one estimated from the plan before, which in a loop of joins grows without end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in written:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
            elif path.startswith("file:"):  # the session was stopped before
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), True)
        except Exception:  # the JVM may be gone when Python ends
            return
    written.clear()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python, once per context: their workers import it by name."""
    context = spark.sparkContext
    if not getattr(context, "_attestry_shipped", False):
        root = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp(prefix="attestry-code-"))
        context.addPyFile(shutil.make_archive(str(target / "attestry"), "zip", root, "attestry"))
        atexit.register(shutil.rmtree, target, True)
        context._attestry_shipped = True
    return spark


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings (with _ for .) while a table is computed; put back afterwards."""
    names = {k: k.replace("_", ".") for k in values}
    before = {k: spark.conf.get(name, None) for k, name in names.items()}
    for k, value in values.items():
        spark.conf.set(names[k], value)
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(names[k]) if value is None else spark.conf.set(names[k], value)
