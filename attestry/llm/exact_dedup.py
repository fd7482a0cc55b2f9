"""Exact duplicates found by two Bloom passes.

Texts are equal if they are identical after each run of ASCII white space has become one space. The first pass sets, for every
row's hash, bits of a filter that can tell "once" from "more than once"; the second pass tests every row against the bits set
more than once. Rows that fail the test are certainly alone and pass straight through, without a shuffle; only the others meet
in an aggregation on the SHA-256 of their normalised text, which settles them exactly. So a false positive of the filter costs a
shuffled row and never changes a result.

Filter size: 32 bits a row and two hash positions, in segments of 2^16 bits. Tasks send the positions that they set, segment by
segment; a segment's positions are merged on executors. The bits set more than once come to the driver and are broadcast; they
hold at most ``max_bits`` (2^28 bits, 32 MB). Where the rows need more, the hash space is cut into slices that are filtered one
after the other, each with its own filter, so memory stays bounded at any size.

A hot group costs no more than any other: tasks send a position once, equal rows are pre-aggregated before they shuffle, and
the facts of groups with over a thousandth of the rows are broadcast (at most 1000 of them) rather than joined in one task.

Defined results: a null text counts as empty, so null, empty and all-white-space texts differ only as "" and " " do. Of rows that
share both text and the smallest id exactly one stays. A null id sorts after every other. An empty table gives an empty
result. Extra columns are kept; those named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import common

SEGMENT = 16
HASHES = 2
BITS_A_ROW = 32
OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised_sha256(text: Column) -> Column:
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), "UTF-8"), 256)


def _positions(hashes: np.ndarray, log_bits: int) -> np.ndarray:
    """rows x HASHES filter positions of 64-bit hashes."""
    x = hashes.astype(np.uint64)
    out = np.empty((len(x), HASHES), dtype=np.int64)
    for k in range(HASHES):
        y = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x51ED270B)
        out[:, k] = (y >> np.uint64(64 - log_bits)).astype(np.int64)
        x = y ^ (y >> np.uint64(29))
    return out


def _mark(log_bits: int):
    """Batches of a hash column -> (segment, seen, again): sorted 16-bit positions set in this task, and those set more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            found = _positions(hashes, log_bits)
            found[:, 1] = np.where(found[:, 1] == found[:, 0], -1, found[:, 1])  # a row counts once at a position
            at, n = np.unique(found[found >= 0], return_counts=True)
            cuts = np.flatnonzero(np.diff(at >> SEGMENT)) + 1
            rows = [(int(p[0] >> SEGMENT), (p & 0xFFFF).astype(np.uint16).tobytes(), (p[c > 1] & 0xFFFF).astype(np.uint16).tobytes()) for p, c in zip(np.split(at, cuts), np.split(n, cuts), strict=True) if len(p)]
            yield pa.RecordBatch.from_pylist([dict(zip(("segment", "seen", "again"), r, strict=True)) for r in rows], pa.schema([("segment", pa.int64()), ("seen", pa.binary()), ("again", pa.binary())]))

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The bits of one segment that were set more than once over all batches, as a bitmap."""
    seen, again = (np.zeros(1 << SEGMENT, dtype=bool) for _ in range(2))
    for one, more in zip(table.column("seen"), table.column("again"), strict=True):
        at = np.frombuffer(one.as_py(), dtype=np.uint16)
        again[at[seen[at]]] = True
        again[np.frombuffer(more.as_py(), dtype=np.uint16)] = True
        seen[at] = True
    return pa.table({"segment": pa.array([table.column("segment")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(again).tobytes()], pa.binary())})


def repeated_bits(hashes: DataFrame, log_bits: int) -> np.ndarray:
    """First pass over a DataFrame of one long column: the filter's bits (packed) that more than one row has set."""
    marked = hashes.mapInArrow(common.tidy(_mark(log_bits)), "segment long, seen binary, again binary")
    merged = marked.groupBy("segment").applyInArrow(_merge, "segment long, bits binary")
    found = merged.where(F.col("bits") != F.lit(bytes(1 << SEGMENT - 3))).toArrow()  # bounded by max_bits
    bits = np.zeros(1 << log_bits - 3, dtype=np.uint8)
    step = 1 << SEGMENT - 3
    for segment, value in zip(found.column("segment").to_pylist(), found.column("bits").to_pylist(), strict=True):
        bits[segment * step : (segment + 1) * step] = np.frombuffer(value, dtype=np.uint8)
    return bits


def _tester(spark, bits: np.ndarray, log_bits: int):
    held = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe_repeated(h):
        import pandas as pd

        at = _positions(h.to_numpy(), log_bits)
        return pd.Series(((held.value[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1))

    maybe_repeated.release = held.unpersist
    return maybe_repeated


def decide(hashed: DataFrame, id_col: str = "doc_id", max_bits: int = 1 << 28) -> DataFrame:
    """hashed: rows with a column text_sha256, cheap to read again. Returns them with keep_id, group_size and kept."""
    spark = hashed.sparkSession
    rows = hashed.drop(*(c for c in OUTPUT if c != "text_sha256")).withColumn("_h", F.xxhash64("text_sha256"))
    total = rows.count()
    slices = max(1, -(-total * BITS_A_ROW // max_bits))
    log_bits = max(SEGMENT, int(np.ceil(np.log2(max(1, total * BITS_A_ROW / slices)))))

    alone, maybe = [], []
    if slices > 1:  # written by slice, so that each is read as often as one alone
        rows = common.stage(rows.withColumn("_slice", F.pmod(F.xxhash64("_h"), F.lit(slices)).cast("int")), apart="_slice")
    for k in range(slices):
        part = rows if slices == 1 else rows.where(F.col("_slice") == k).drop("_slice")
        test = _tester(spark, repeated_bits(part.select("_h"), log_bits), log_bits)
        tested = part.withColumn("_maybe", test("_h")).drop("_h")
        if slices > 1:  # tested now, so that its filter need not be kept
            tested = common.stage(tested)
            test.release()
        alone.append(tested.where(~F.col("_maybe")).drop("_maybe"))
        maybe.append(tested.where("_maybe").drop("_maybe"))

    single = _union(alone).withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    again = common.stage(_union(maybe).withColumn("_row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row")))
    groups = again.groupBy("text_sha256").agg(first.alias("_first"), F.count("*").alias("group_size"))
    settled = common.attach(again, groups, "text_sha256", "group_size", total)
    settled = settled.withColumns({"keep_id": F.col("_first.id"), "kept": F.col("_row") == F.col("_first.row")}).drop("_row", "_first")
    return single.unionByName(settled)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Reads the texts once."""
    hashed = common.stage(docs.select(F.col(id_col), normalised_sha256(F.col(text_col)).alias("text_sha256")))
    return decide(hashed, id_col, **options).select(id_col, *OUTPUT)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with their own columns whatever they are called. Texts of rows that are certainly alone are not shuffled."""
    own, names = common.numbered(docs)
    hashed = own.withColumn("text_sha256", normalised_sha256(F.col(common.place_of(docs, text_col))))
    return decide(hashed, common.place_of(docs, id_col), **options).where("kept").select(*own.columns).toDF(*names)
