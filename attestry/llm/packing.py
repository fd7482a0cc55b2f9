"""Best-fit packing of token sequences by non-negative least squares.

1. Every document is tokenised once and cut: a document of over ``size`` tokens becomes pieces of exactly ``size`` tokens, of which
   the first takes the remainder. Only the pieces' numbers are kept (staged), never the tokens.
2. The histogram of piece lengths, at most ``size`` counts, is all that the driver sees of the corpus.
3. Patterns of one, two or three lengths that fill a sequence exactly are enumerated, and repeat counts x >= 0 are fitted so
   that A x comes close to the histogram (accelerated projected gradient). Counts are rounded, most used pattern first, never
   beyond what is left of each length.
4. What is left is packed best-fit, longest first, on the histogram too: lengths go by the bundle, not one by one.
5. The plan is a table of runs: "ranks r0..r1 of length L go to sequences s0.. at offset o". Every piece gets its rank among those
   of its length from counts by (length, bucket), prefix sums over buckets, and a row number in its bucket. Buckets are dealt evenly
   over the rows of each task, so no length, however common, meets in one task.

Defined results: a null text is an empty one, which has the end token alone. Repeated rows are packed as often as they occur.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm import chunks, common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def cut(ids: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many ids."""
    first = (ids - 1) % size + 1
    return [(0, first), *((at, size) for at in range(first, ids, size))]


def tokenised(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, size: int, cached: int) -> DataFrame:
    """docs: id and text. The pieces of every document, staged."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunks.Encoder(tokenizer, pattern, cached)
        salt = TaskContext.get().partitionId() << 40  # another for every row, the same when a task runs again
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids = text + tail
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    salt += 1
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), salt), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return common.stage(docs.mapInArrow(common.tidy(run), PIECES))


def patterns(size: int) -> np.ndarray:
    """All a <= b <= c of lengths with a + b + c = size, where 0 stands for no piece: n x 3."""
    a = np.arange(0, size // 3 + 1)
    rows = []
    for x in a:
        b = np.arange(x, (size - x) // 2 + 1)
        rows.append(np.stack([np.full_like(b, x), b, size - x - b], axis=1))
    return np.concatenate(rows)


def fit(kinds: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - histogram|, column j of A counting the lengths in pattern j."""
    n = len(histogram)
    forward = lambda x: sum(np.bincount(kinds[:, k], weights=x, minlength=n) for k in range(3)) * keep
    keep = np.ones(n)
    keep[0] = 0
    backward = lambda r: (r * keep)[kinds].sum(axis=1)
    v = np.ones(len(kinds))
    for _ in range(12):
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(kinds))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - backward(forward(y) - histogram) / (1.02 * norm))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def plan(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """histogram[l]: pieces of length l. (lengths in a sequence, how many such sequences), which uses every piece up.

    Fitted counts are rounded down and, for comparison, to the nearest whole number but 1 at least; the plan with fewer sequences wins.
    """
    left = histogram.astype(np.int64).copy()
    full = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    if not left.any():
        return full
    kinds = patterns(size)
    present = np.concatenate([[True], left[1:] > 0])
    kinds = kinds[present[kinds].all(axis=1)]
    x = fit(kinds, left.astype(float)) if len(kinds) else np.zeros(0)
    order = [j for j in np.argsort(-x, kind="stable") if x[j] > 1e-3]
    plans = []
    for counts in (np.floor(x + 1e-9), np.maximum(1, np.round(x))):
        rest, out = left.copy(), []
        for j in order:
            if counts[j] >= 1:
                _take(rest, out, tuple(int(v) for v in kinds[j] if v), int(counts[j]))
        plans.append(out + best_fit(rest, size))
    return full + min(plans, key=lambda p: sum(n for _, n in p))


def _take(left: np.ndarray, out: list, lengths: tuple[int, ...], wanted: int) -> None:
    """Plans as many sequences of these lengths as wanted, or as the pieces that are left allow."""
    need: dict[int, int] = {}
    for length in lengths:
        need[length] = need.get(length, 0) + 1
    n = min(wanted, *(int(left[length]) // k for length, k in need.items()))
    if n > 0:
        out.append((lengths, n))
        for length, k in need.items():
            left[length] -= n * k


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of the pieces in a histogram, many alike at a time."""
    open_: dict[int, list[list]] = {}  # room -> [lengths, number of sequences]
    for length in range(size, 0, -1):
        todo = int(left[length])
        while todo:
            room = next((r for r in range(length, size) if open_.get(r)), None)
            if room is None:
                each = size // length
                full, rest = divmod(todo, each)
                for lengths, n in (((length,) * each, full), ((length,) * rest, 1 if rest else 0)):
                    if n:
                        open_.setdefault(size - length * len(lengths), []).append([lengths, n])
                break
            group = open_[room][-1]
            n = min(todo, group[1])
            group[1] -= n
            if not group[1]:
                open_[room].pop()
            open_.setdefault(room - length, []).append([group[0] + (length,), n])
            todo -= n
    return [(lengths, n) for groups in open_.values() for lengths, n in groups]


def runs(planned: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, np.ndarray]:
    """length -> rows of (first rank, first sequence, offset), ranks ascending."""
    used = dict.fromkeys(range(1, size + 1), 0)
    out: dict[int, list] = {}
    sequence = 0
    for lengths, n in planned:
        offset = 0
        for length in lengths:
            out.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


def pack(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, bucket_rows: int = 50_000, cached: int = 300_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. A worker keeps the ids of at most cached words and chunks."""
    spark = docs.sparkSession
    pieces = tokenised(docs.select(F.col(id_col).cast("long"), F.col(text_col)), tokenizer, pattern, end_id, size, cached)
    total = pieces.count()
    buckets = max(1, -(-total // bucket_rows))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("salt"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    histogram = np.zeros(size + 1, dtype=np.int64)
    for length, n in by_length.items():
        histogram[length] = n
    held = spark.sparkContext.broadcast(runs(plan(histogram, size), size))  # grows with the number of patterns, not with the data

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "bucket", "base")
    within = Window.partitionBy("length", "bucket").orderBy("salt")
    ranked = dealt.withColumn("own", F.row_number().over(within)).join(base, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("own") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.empty((len(lengths), 2), dtype=np.int64)
        for x in np.unique(lengths):
            at = np.flatnonzero(lengths == x)
            table = held.value[int(x)]
            found = table[np.searchsorted(table[:, 0], ranks[at], side="right") - 1]
            out[at, 0] = found[:, 1] + ranks[at] - found[:, 0]
            out[at, 1] = found[:, 2]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    placed = ranked.withColumn("_at", place("length", "rank"))
    return placed.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
