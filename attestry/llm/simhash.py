"""Near-duplicates by SimHash, linked through a hierarchical index in Gray order.

A fingerprint has a bit for each bit of a 64-bit hash, set if it is set in over half of the hashes of the document's word shingles.
Fingerprints at a small Hamming distance are linked, and components of linked fingerprints are groups of near-duplicates.

Only distinct fingerprints are compared, so exact copies cost nothing. They are dealt into cells by their leading bits, which
are also the leading bits of the Gray rank. A fingerprint is a member of its own cell and a query in each lower cell whose leading
bits differ from its own in no more bits than the radius, so every pair meets exactly once. Each task builds the index of a cell's
members (see gray_index) and streams the queries past it. Links that join nothing new within a cell are not emitted: a cell
gives no more links than it has members and queries. A cell with too many members is taken apart at more leading bits, again and
again if need be, so no task holds more than ``cell_rows`` members. Within radius 2 a fingerprint has at most 2080 others.

Defined results: null and empty texts and those of white space have no words; their fingerprint is zero and is linked like any
other. Fewer words than a shingle: the whole sequence is the one shingle. Repeated rows each get their row; a null id is never
the smallest of its component unless all are null. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import common, graph
from attestry.llm.gray_index import GrayIndex

SEED = 42


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, repeats included."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), SEED)] if found else [], dtype=np.uint64)
    joined = b" ".join(found)
    ends = [at - 1 for at in accumulate(len(w) + 1 for w in found)]
    starts = [0, *(e + 1 for e in ends)]
    return np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :], strict=False)], dtype=np.uint64)


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The word whose bits are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[at : at + step]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([majority(shingle_hashes(t.as_py(), words)) for t in batch.column(1).cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.stage(docs.select(id_col, text_col).mapInArrow(common.tidy(run), f"`{id_col}` {kind}, fp long"))


def _near_masks(bits: int, radius: int) -> list[int]:
    """All words of so many bits with at most radius bits set."""
    out = level = [0]
    for _ in range(radius):
        level = sorted({x | 1 << k for x in level for k in range(bits) if not x >> k & 1})
        out = out + level
    return out


def find(parents: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of some members of a forest of parents, which then hang on them directly."""
    roots = parents[at]
    while ((up := parents[roots]) != roots).any():
        roots = up
    parents[at] = roots
    return roots


def _forest(radius: int):
    """Rows (cell, role, fp) sorted by cell and role, members (role 0) first -> links that join something new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, index, parts, members, groups = None, None, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def links(values: np.ndarray, inner: bool) -> Iterator[pa.RecordBatch]:
            for q, m in index.search(values, radius):
                if inner:
                    q, m = q[m < q], m[m < q]
                if not len(q):
                    continue
                order = np.argsort(q, kind="stable")
                q, m = q[order], m[order]
                a, b = [], []
                for own in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
                    who, near = q[own[0]], m[own]
                    roots, first = np.unique(find(groups, near), return_index=True)
                    if inner:
                        keep = roots != find(groups, q[own[:1]])[0]
                        groups[find(groups, q[own[:1]])] = roots[0]
                        groups[roots] = roots[0]
                        first = first[keep]
                    else:
                        groups[roots] = roots[0]
                    a.extend([values[who]] * len(first))
                    b.extend(members[near[first]])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

        def build() -> Iterator[pa.RecordBatch]:
            nonlocal index, members, groups, parts
            members = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            parts, groups = [], np.arange(len(members))
            index = GrayIndex(members)
            yield from links(members, True)

        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            roles = batch.column(1).to_numpy(zero_copy_only=False)
            fps = np.ascontiguousarray(batch.column(2).to_numpy(zero_copy_only=False)).view(np.uint64)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(roles) != 0)) + 1
            for own in np.split(np.arange(len(cells)), cuts):
                if not len(own):
                    continue
                if cells[own[0]] != cell:
                    if index is None and parts:
                        yield from build()
                    cell, index, parts = cells[own[0]], None, []
                if roles[own[0]] == 0:
                    parts.append(fps[own])
                else:
                    if index is None:
                        yield from build()
                    yield from links(fps[own], False)
        if index is None and parts:
            yield from build()

    return run


def links(distinct: DataFrame, radius: int, cell_rows: int = 1 << 16, per_cell: int = 1 << 13) -> DataFrame:
    """distinct: a staged column fp. Links a, b that join every pair of fingerprints within the radius, each component a forest or little more."""
    spark = distinct.sparkSession
    total = distinct.count()
    bits = min(16, max(0, int(np.ceil(np.log2(max(1, total / per_cell))))))
    scope, scope_bits, found = None, 0, None
    while True:
        shift = 64 - bits
        cell_of = F.shiftrightunsigned("fp", shift) if bits else F.lit(0).cast("long")
        own = distinct.select("fp", cell_of.alias("own"))
        masks = F.array(*[F.lit(m).cast("long") for m in _near_masks(bits, radius)])
        target = F.explode(F.transform(F.filter(masks, lambda m: (m == 0) | (F.col("own").bitwiseXOR(m) < F.col("own"))), lambda m: F.col("own").bitwiseXOR(m)))
        routed = own.select("fp", "own", target.alias("cell"))
        members = own.select(F.col("own").alias("cell"))
        if scope is not None:
            inside = F.shiftrightunsigned("cell", bits - scope_bits)
            routed = routed.join(F.broadcast(scope), inside == F.col("scope"), "left_semi")
            members = members.join(F.broadcast(scope), inside == F.col("scope"), "left_semi")
        heavy = None
        if bits < 64:
            full = members.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell").collect()  # at most total / cell_rows
            if full:
                heavy = spark.createDataFrame(full, "scope long")
                routed = routed.join(F.broadcast(heavy), F.col("cell") == F.col("scope"), "left_anti")
        role = F.when(F.col("cell") == F.col("own"), 0).otherwise(1)
        parts = common.spread(spark, total, cell_rows)
        sorted_ = routed.select("cell", role.alias("role"), "fp").repartition(parts, "cell").sortWithinPartitions("cell", "role")
        part = common.stage(sorted_.mapInArrow(common.tidy(_forest(radius)), "a long, b long"))
        found = part if found is None else found.unionByName(part)
        if heavy is None:
            return found
        scope, scope_bits, bits = heavy, bits, min(64, bits + 6)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id that links reach)."""
    prints = fingerprints(docs, id_col, text_col, words)
    by_print = common.stage(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    roots = graph.components(links(by_print.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = common.stage(by_print.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    facts = common.attach(rooted, least, "root", "prints", rooted.count()).select("fp", "n", "component_id")
    out = common.attach(prints, common.stage(facts), "fp", "n", prints.count())
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(id_col, digits.alias("fingerprint"), "component_id")
