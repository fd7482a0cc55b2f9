"""Approximate nearest neighbours by low-dimensional stable projections in kd-trees.

Vectors are projected onto a few random Gaussian directions. Since the Gaussian is 2-stable, the squared distance of two projections over the
squared distance of the vectors is a chi-square variable with as many degrees of freedom as there are directions. A query takes its neighbours in
the projected space in order of their distance there, out of a kd-tree, and verifies each by its true distance. It stops when the next
projected distance is so large that a vector better than its k-th best so far would lie within it with the given confidence:
next^2 > quantile(chi-square, confidence) * best_k^2.

Rows are dealt evenly into blocks of about ``block_rows``; every block has a tree of its own and answers every query, and the answers of
all blocks are merged by pre-aggregated top lists. Identical vectors are one point of the tree with their smallest k + 1 ids, which
is all that a top-k answer can need of them, so a vector that a third of the rows share is one point per block. Only the query set, which a
search states, goes to all blocks; it travels in chunks of ``query_rows``, so a task holds a block and a chunk.

Defined results: vectors that are null, zero, of another length than the query's, or hold a null or non-finite component take no part,
neither as query nor as candidate. A query without candidates has no rows. Fewer than k candidates: all of them. Ties go to the
smaller id. Of repeated rows with one id each counts as a candidate. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm import common


def chi_square_quantile(p: float, dof: int) -> float:
    """The value that a chi-square variable exceeds with probability 1 - p, by bisection on its series."""

    def below(x: float) -> float:
        term = total = 1.0 / math.gamma(dof / 2 + 1)
        for k in range(1, 400):
            term *= (x / 2) / (dof / 2 + k)
            total += term
        return total * (x / 2) ** (dof / 2) * math.exp(-x / 2)

    low, high = 0.0, 20.0 * dof + 100
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(dim: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class KdTree:
    """A kd-tree of points whose leaves hold at most ``leaf`` of them, for taking points in order of distance. order: the points as they lie in the tree, leaf by leaf; places are places in it."""

    def __init__(self, points: np.ndarray, leaf: int = 512):
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (lo, hi, left, right, min corner, max corner)
        stack = [(0, len(points), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            own = points[self.order[lo:hi]]
            low, high = own.min(axis=0), own.max(axis=0)
            at = len(self.nodes)
            self.nodes.append([lo, hi, -1, -1, low, high])
            if parent >= 0:
                self.nodes[parent][2 + side] = at
            if hi - lo > leaf:
                axis = int(np.argmax(high - low))
                if high[axis] > low[axis]:
                    mid = (hi - lo) // 2
                    self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], mid)]
                    stack += [(lo, lo + mid, at, 0), (lo + mid, hi, at, 1)]
        self.points = points[self.order]
        self.boxes = [(n[4], n[5]) for n in self.nodes]

    def _outside(self, at: int, query: np.ndarray) -> float:
        low, high = self.boxes[at]
        gap = np.maximum(0, np.maximum(low - query, query - high))
        return float(gap @ gap)

    def increments(self, query: np.ndarray, opened: Callable[[int, int], np.ndarray], few: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(squared distances, places, what opened gave for them) of points in order of distance, so many at a time as no unopened node can come before. Nodes are met as they are reached, and leaves opened until a few
        points are there to be put in order; opened gets the places of a leaf."""
        heap = [(self._outside(0, query), 0)]
        far, places, more = np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0)
        while heap or len(far):
            fresh, n = [(far, places, more)], 0
            while heap and n < few:
                _, at = heapq.heappop(heap)
                lo, hi, left, right, _, _ = self.nodes[at]
                if left >= 0:
                    for child in (left, right):
                        heapq.heappush(heap, (self._outside(child, query), child))
                    continue
                diff = self.points[lo:hi] - query
                fresh.append((np.einsum("ij,ij->i", diff, diff), np.arange(lo, hi), opened(lo, hi)))
                n += hi - lo
            far, places, more = (np.concatenate(x) for x in zip(*fresh, strict=True))
            order = np.argsort(far, kind="stable")
            far, places, more = far[order], places[order], more[order]
            n = int(np.searchsorted(far, heap[0][0] if heap else np.inf, side="right"))
            if n:
                yield far[:n], places[:n], more[:n]
                far, places, more = far[n:], places[n:], more[n:]


class Block:
    """Vectors of one length as points of a tree, with the ids of each."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], m: int):
        self.axes = directions(vectors.shape[1], m)
        self.tree = KdTree(vectors @ self.axes)
        self.vectors, self.ids = vectors[self.tree.order], [ids[i] for i in self.tree.order]
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.largest = float(self.squares.max())

    def top(self, query: np.ndarray, own: int, k: int, quantile: float) -> tuple[list[float], list[int]]:
        """The k nearest that are found, as (distance, id) ascending. Points are verified in order of projected distance until one stands the stopping test.

        The product with the query, which a leaf's vectors get at once, says nearly how far a point is; only what may be among the nearest by it is measured.
        """
        best: list[tuple[float, int]] = []
        square = float(query @ query)
        error = 1e-11 * (self.largest + square)  # far more than rounding makes of it
        for far, places, about in self.tree.increments(query @ self.axes, lambda lo, hi: self.squares[lo:hi] + square - 2 * (self.vectors[lo:hi] @ query)):
            limit = best[k - 1][0] if len(best) >= k else np.inf
            within = int(np.searchsorted(far, quantile * limit**2, side="right")) if np.isfinite(limit) else len(far)
            about = about[:within]
            most = min(limit**2, np.partition(about, k)[k] + error if within > k else np.inf)  # one of k + 1 may be the query's own
            places = places[:within][~(about > most + error)]  # what is too large for a product is not a number, and stays
            diff = self.vectors[places] - query
            found = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            for place in np.flatnonzero(found <= limit):
                best += [(float(found[place]), int(i)) for i in self.ids[places[place]] if i != own]
            best.sort()
            del best[k:]
            if within < len(far):
                break
        return [d for d, _ in best], [i for _, i in best]


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, m: int = 10, confidence: float = 0.95, block_rows: int = 20_000, query_rows: int = 10_000) -> DataFrame:
    """queries: rows like those of vectors, searched against all of them but the one with their own id. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    valid = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    rank = Window.partitionBy("v").orderBy("id")
    first = valid(vectors).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1)  # cut to k + 1 a task before the shuffle, too
    points = common.stage(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = common.stage(valid(queries).dropDuplicates())
    blocks = max(1, -(-points.count() // block_rows))
    chunks = max(1, -(-asked.count() // query_rows))
    quantile = chi_square_quantile(confidence, m)

    dealt = points.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "v", "ids", F.lit(None).cast("long").alias("query"))
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), "v", F.lit(None).cast("array<long>").alias("ids"), F.col("id").alias("query"))

    def answer(table: pa.Table) -> pa.Table:
        query = table.column("query").to_pylist()
        dims = np.array([len(v) for v in table.column("v")])
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        starts = np.cumsum(dims) - dims
        out: list[list] = [[], [], []]
        ids = table.column("ids").to_pylist()
        for dim in np.unique(dims):
            own = [i for i in np.flatnonzero(dims == dim) if query[i] is None]
            ask = [i for i in np.flatnonzero(dims == dim) if query[i] is not None]
            if not own or not ask:
                continue
            held = Block(np.stack([flat[starts[i] : starts[i] + dim] for i in own]), [np.array(ids[i]) for i in own], m)
            for i in ask:
                found, who = held.top(flat[starts[i] : starts[i] + dim], query[i], k, quantile)
                for column, values in zip(out, ([query[i]] * len(found), who, found), strict=True):
                    column.extend(values)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = dealt.unionByName(sent).groupBy("block", "chunk").applyInArrow(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
