"""Reading documents and writing what was found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.operators import engine


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file: key (the file's path) and raw."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("key"), F.col("value").alias("raw"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line that is not blank; the key is a hash of the line, and for the second and further equal lines a number behind it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("place"))
    placed = lines.select(F.sha2("value", 256).alias("key"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("place")).withColumn("nth", nth)
    return placed.select(F.when(F.col("nth") == 1, F.col("key")).otherwise(F.concat_ws("-", "key", "nth")).alias("key"), "raw")


def from_objects(spark: SparkSession, documents: dict[str, object]) -> DataFrame:
    """Documents held in memory, by key."""
    import json

    return spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()], "key string, raw string")


def sample(spark: SparkSession, name: str) -> DataFrame:
    """One valid document that comes with the library: pack, draft (its sources are those of context) or context. Columns key, raw, and for a draft context."""
    from importlib.resources import files

    text = lambda n: (files("attestry.fixtures") / f"{n}.json").read_text()
    row = (name, text(name), text("context")) if name == "draft" else (name, text(name))
    return spark.createDataFrame([row], "key string, raw string" + (", context string" if name == "draft" else ""))


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of files whose content is not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "modificationTime")


def write_issues(issues: DataFrame, verdicts: DataFrame, path: str) -> None:
    """issues and verdicts as Parquet below path, issues apart by code so that a reader of one code reads little."""
    issues.write.mode("overwrite").partitionBy("code").parquet(f"{path}/issues")
    verdicts.write.mode("overwrite").parquet(f"{path}/verdicts")


def write_checked(docs: DataFrame, path: str, checkpoint: str, validate: Callable[[DataFrame], DataFrame] = engine.validate_pack, **trigger) -> StreamingQuery:
    """docs: a stream with the columns that validate takes. Issues and verdicts of each batch as Parquet below path, in folders by the batch's number (a column batch when they are read).

    A batch that is run again, after a failure, has its number and its documents again, and its folders are written anew: what was written of it before counts for nothing, so every
    document's issues are there once. trigger: as for writeStream.trigger.
    """

    def check(batch: DataFrame, number: int) -> None:
        issues = validate(batch)
        issues.write.mode("overwrite").parquet(f"{path}/issues/batch={number}")
        engine.verdicts(batch, issues).write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")

    stream = docs.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()
