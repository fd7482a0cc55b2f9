"""What the operators share: staged tables, joins on hot keys, and clean-up."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import staging

#: Folders written by this process; removed when it ends.
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="attestry-")
        spark.conf.set("spark.checkpoint.dir", found)
        _staged.append((spark, found))
    return found.rstrip("/")


def stage(df: DataFrame, apart: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage, survives lost executors, and is computed once.

    apart: a column of few values by which files are apart, so that a reader of one value reads no other. What was shuffled for it goes when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestry-{uuid.uuid4().hex}"
    with staging.settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        (df.write.partitionBy(apart) if apart else df.write).parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1, ..., which no name of an operator's own clashes with, and the columns as they are called."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), df.columns


def place_of(df: DataFrame, column: str) -> str:
    """What numbered() calls a column."""
    return f"c{df.columns.index(column)}"


def release(df: DataFrame) -> None:
    """Deletes what stage() wrote for df, which must not be read any more."""
    files = df.inputFiles()
    for item in [x for x in _staged if any(x[1].split("://")[-1].lstrip("/") + "/" in f for f in files)]:
        _delete(*item)
        _staged.remove(item)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone when Python ends
            return
    _staged.clear()


def spread(spark: SparkSession, rows: int, per_task: int) -> int:
    """A number of partitions: the session's own, or more where a task would get over per_task rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, staged: bool = False) -> DataFrame:
    """Left-joins one fact per key to rows (key not null). Keys whose weight (their number of rows) is over a thousandth of
    total are at most 1000, so their facts are broadcast and their rows stay where they are; the others meet in a shuffle.
    staged: facts is, so it is looked at first, and where no key is so heavy the plan, which the driver holds, is the shuffle alone."""
    limit = max(2000, total // 1000)
    hot = facts.where(F.col(weight) > limit)
    if staged and hot.isEmpty():
        return rows.join(facts, key, "left")
    others = [c for c in facts.columns if c != key]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    warm = marked.where(F.col("_hot").isNotNull()).drop("_hot")
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns)
    cold = rest.join(facts.where(F.col(weight) <= limit), key, "left")
    columns = [*rows.columns, *others]
    return warm.select(*columns).unionByName(cold.select(*columns))


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python, once per context: their workers import it by name."""
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if not getattr(context, "_attestry_shipped", False):
        root = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp(prefix="attestry-code-"))
        context.addPyFile(shutil.make_archive(str(target / "attestry"), "zip", root, "attestry"))
        atexit.register(shutil.rmtree, target, True)
        context._attestry_shipped = True
    if spark.conf.get(BATCH_BYTES, "64m") in ("64m", "67108864b", "67108864"):  # the default: texts would fill the workers' memory
        spark.conf.set(BATCH_BYTES, "8m")
    return spark


#: How much Spark sends to a Python worker at a time.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def tidy(run):
    """A batch function that leaves its worker, which later tasks and stages use again, without the memory that it took."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
