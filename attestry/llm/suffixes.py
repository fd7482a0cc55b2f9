"""Repeated substrings by deep-shallow suffix sorting over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Strings are judged on the input.

Sampling, which is exact: in each window of ``length`` bytes one place is chosen, the leftmost smallest by hash of the ``gram`` bytes
there. The choice depends on the window's content alone, so equal windows choose the same place in them, and a window can only
repeat if the gram at its place does. A place is chosen by a run of neighbouring windows; run and text under it are its context.

1. Every task hashes all bytes of its texts (a rolling hash in numpy) and writes one row per chosen place: hash of the gram, XXH3 of the
   context's bytes, document, first window, number of windows, offset of the place. This is staged; it is about a tenth of the texts.
2. Counts by (gram, context) and by gram, pre-aggregated. A context that occurs twice is repeated in full. A gram that occurs once is
   no repeat. Contexts that occur once, under a gram that does not, are compared: one place per distinct context fetches its bytes.
3. The compared places meet by gram. Their suffixes (the text from the place on) are sorted deep-shallow: multikey quicksort to a shallow
   depth, then a blind trie for each group that still agrees there. Walking the tries bottom-up while keeping the texts to the left
   of each place in (reversed) order, smaller set into larger, gives for every place the longest common text to the left at each common
   length to the right, and so exactly the windows that repeat.
4. A gram with over ``group_places`` distinct contexts is not brought together in one task: all windows of its places are counted by a
   128-bit hash instead, which gives the same windows and pre-aggregates.
5. Windows become runs of bytes per document, and the documents are rewritten.

Defined results: a null text is empty and stays null where texts are returned. Matches never cross documents; two rows are two documents even with
the same id (a row number tells them apart). A very long text is gone through in pieces that overlap. Empty table: empty result. Columns of the input are
kept, whatever they are called.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from attestry.llm import common

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
GAP = 1 << 18  # bytes hashed at a time
PLACES = "gram long, context long, doc long, first int, windows short, offset short"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = (np.full(n, x, dtype=np.uint64) for x in (BASE, inverse))
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Sampler:
    """Chosen places of a text: (gram hash, context hash, first window, number of windows, offset of the place from the first window)."""

    def __init__(self, length: int, gram: int, most: int = GAP):
        self.length, self.gram = length, gram
        self.span = length - gram + 1  # places in a window
        self.up, self.down = _powers(most + length)
        self.most = most

    def __call__(self, text: bytes) -> tuple[np.ndarray, ...]:
        parts = []
        for at in range(0, max(1, len(text) - self.length + 1), self.most - self.length + 1):
            parts.append((at, self._part(np.frombuffer(text, dtype=np.uint8)[at : at + self.most])))
        if len(parts) == 1:
            return parts[0][1]
        return tuple(np.concatenate([p[k] + (at if k == 2 else 0) for at, p in parts]) for k in range(5))

    def _part(self, text: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(text) - self.length + 1  # windows
        if n <= 0:
            return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[: len(text)], out=sums[1:])
        grams = _mixed((sums[self.gram :] - sums[: -self.gram]) * self.down[: len(text) - self.gram + 1])
        keys = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)  # leftmost of equals
        span = self.span
        padded = np.full(-(-len(keys) // span) * span, ~np.uint64(0))
        padded[: len(keys)] = keys
        rows = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        windows = np.diff(np.append(first, n))
        place = chosen[first]
        end = first + windows + self.length - 1
        raw, shape = text.tobytes(), _mixed((windows.astype(np.uint64) << np.uint64(20)) + (place - first).astype(np.uint64))
        bytes_of = np.array([xxh3_64_intdigest(raw[s:e]) for s, e in zip(first.tolist(), end.tolist(), strict=True)], dtype=np.uint64)
        return grams[place], bytes_of ^ shape, first, windows, place - first


def _sample(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length, gram)
        for batch in batches:
            found = [(doc, sampler(text)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True) if text and len(text) >= length]
            if not found:
                continue
            cols = [np.concatenate([f[k] for _, f in found]) for k in range(5)]
            docs = np.repeat(np.array([d for d, _ in found], dtype=np.int64), [len(f[0]) for _, f in found])
            arrays = [cols[0].view(np.int64), cols[1].view(np.int64), docs, cols[2].astype(np.int32), cols[3].astype(np.int16), cols[4].astype(np.int16)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["gram", "context", "doc", "first", "windows", "offset"])

    return run


# --- sorting -----------------------------------------------------------------------------------------------------------------


def shallow_sort(texts: list[bytes], members: list[int], depth: int, limit: int) -> list[list[int]]:
    """Multikey quicksort of the members by their texts from depth on, down to the depth limit: groups in order that agree so far."""
    out: list[list[int]] = []
    stack = [(members, depth)]
    while stack:
        group, at = stack.pop()
        if len(group) == 1 or at >= limit:
            out.append(group)
            continue
        step = 8  # the characters of the quicksort are words of 8 bytes
        keys = [texts[i][at : at + step] for i in group]
        pivot = keys[len(keys) // 2]
        less, same, more = ([i for i, k in zip(group, keys, strict=True) if c(k)] for c in (pivot.__gt__, pivot.__eq__, pivot.__lt__))
        if more:
            stack.append((more, at))
        stack.append((same, at + step if len(pivot) == step else limit))
        if less:
            stack.append((less, at))
    return out


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, at least known of which is certain."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie(texts: list[bytes], group: list[int]) -> tuple[list[int], list[int]]:
    """Orders a group by inserting its texts into a blind trie. Returns the order, and the common prefix of each with the one before (0 first).

    A node knows only the length at which its children part and their first bytes there. An insertion goes down blindly, compares
    with one leaf, and puts a branch where the texts really part.
    """
    root: list = [None, {}, group[0]]  # [length, byte -> child, some leaf below]; a leaf has length None
    for i in group[1:]:
        text, node = texts[i], root
        while node[0] is not None:  # blind descent
            key = text[node[0]] if node[0] < len(text) else -1
            child = node[1].get(key)
            if child is None:
                break
            node = child
        length = common_prefix(text, texts[node[2]])
        node, parent, edge = root, None, None
        while node[0] is not None and node[0] < length:
            edge = text[node[0]] if node[0] < len(text) else -1
            parent, node = node, node[1][edge]
        leaf = [None, {}, i]
        if node[0] == length:
            node[1].setdefault(text[length] if length < len(text) else -1, leaf)
            continue
        other = texts[node[2]]
        branch = [length, {other[length] if length < len(other) else -1: node}, node[2]]
        branch[1][text[length] if length < len(text) else -1] = leaf
        if parent is None:
            root = branch
        else:
            parent[1][edge] = branch
    order, shared, stack = [], [], [(root, 0)]
    while stack:
        node, above = stack.pop()
        if node[0] is None:
            order.append(node[2])
            shared.append(above)
            continue
        children = [node[1][k] for k in sorted(node[1])]
        for k, child in reversed(list(enumerate(children))):
            stack.append((child, node[0] if k else above))
    return order, shared


def repeats_within(lefts: list[bytes], rights: list[bytes], length: int, gram: int, shallow: int = 32) -> list[list[tuple[int, int]]]:
    """Of places under one gram: for each, the (low, high) ranges of i such that the window that starts i bytes left of it repeats at another.

    lefts: the text before a place, reversed; rights: the text from the place on, whose first gram bytes are the same for all. Places differ
    in one or the other. A set of places whose right texts share a prefix is kept in order of left texts, where the best partner of a place
    stands next to it. Sets are joined in order of falling common prefix, so each pair of neighbours is compared at its true one.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in lefts]

    def compare(a: int, b: int, right: int) -> None:
        left = common_prefix(lefts[a], lefts[b])
        if left + right >= length:
            found[a].append((max(0, length - right), left))
            found[b].append((max(0, length - right), left))

    if len(lefts) == 2:
        compare(0, 1, common_prefix(rights[0], rights[1]))
        return found
    alike: dict[bytes, list[int]] = {}
    for i, text in enumerate(rights):
        alike.setdefault(text, []).append(i)
    order: list[int] = []
    shared: list[int] = []
    for group in shallow_sort(rights, [own[0] for own in alike.values()], gram, gram + shallow):
        own, between = blind_trie(rights, group)
        if order:
            between[0] = common_prefix(rights[order[-1]], rights[own[0]])
        order += own
        shared += between

    def join(a: tuple[list, list], b: tuple[list, list], right: int) -> tuple[list, list]:
        (texts, places), few = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
        for text, place in zip(*few, strict=True):
            at = bisect.bisect_left(texts, text)
            for near in (at - 1, at):
                if 0 <= near < len(texts):
                    compare(place, places[near], right)
            texts.insert(at, text)
            places.insert(at, place)
        return texts, places

    sets, ends = [], list(range(len(order)))  # ends[k]: the other end of the run of joined sets that k is an end of
    for head in order:
        one: tuple[list, list] = ([], [])
        for place in alike[rights[head]]:
            one = join(one, ([lefts[place]], [place]), len(rights[head]))
        sets.append(one)
    for k in sorted(range(1, len(order)), key=lambda k: -shared[k]):
        low, high = ends[k - 1], ends[k]
        sets[low] = join(sets[low], sets[k], shared[k])
        ends[low], ends[high] = high, low
        sets[k] = sets[low] if k == low else None
    return found


# --- the operator ------------------------------------------------------------------------------------------------------------


def _compare(length: int, gram: int):
    """Rows (gram, doc, first, windows, offset, n, bytes) sorted by gram -> runs (doc, start, windows) that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[dict]) -> list[tuple[int, int, int]]:
            lefts = [r["bytes"][: r["offset"]][::-1] for r in rows]
            rights = [r["bytes"][r["offset"] :] for r in rows]
            out = []
            for r, spans in zip(rows, repeats_within(lefts, rights, length, gram), strict=True):
                if r["n"] == 1:
                    for low, high in set(spans):
                        begin, end = max(0, r["offset"] - high), min(r["windows"] - 1, r["offset"] - low)
                        if begin <= end:
                            out.append((r["doc"], r["first"] + begin, end - begin + 1))
            return out

        rows: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if rows and row["gram"] != rows[0]["gram"]:
                    out += settle(rows)
                    rows = []
                rows.append(row)
            yield _runs(out)
        if rows:
            yield _runs(settle(rows))

    return run


def _runs(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64()))], ["doc", "start", "windows"])


def _windows(length: int):
    """Every window of the given contexts with a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["bytes"]
                hashes = [hashlib.blake2b(text[j : j + length], digest_size=16).digest() for j in range(row["windows"])]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([row["doc"]] * n, pa.int64()), pa.array(range(row["first"], row["first"] + n), pa.int64()), pa.array([row["n"]] * n, pa.int64())], ["hash", "doc", "start", "n"])

    return run


def repeated_runs(texts: DataFrame, length: int = 400, gram: int = 128, group_places: int = 20_000) -> DataFrame:
    """texts: doc (long, unique) and text. Returns doc, start, windows: runs of windows, by their first bytes, that also start elsewhere."""
    spark = texts.sparkSession
    places = common.stage(texts.mapInArrow(common.tidy(_sample(length, gram)), PLACES))
    total = places.count()
    by_context = places.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "windows", "offset")).alias("head"))
    by_gram = by_context.groupBy("gram").agg(F.count("*").alias("contexts"), F.sum("n").alias("places"), F.count_if(F.col("n") == 1).alias("singles"))
    classes = common.stage(by_context.join(by_gram.where("places > 1"), "gram"))

    repeated = classes.where("n > 1").select(F.struct("gram", "context").alias("key"), "n")
    keyed = places.select(F.struct("gram", "context").alias("key"), "doc", "first", "windows")
    runs = common.attach(keyed, repeated, "key", "n", total).where("n is not null").select("doc", F.col("first").cast("long").alias("start"), F.col("windows").cast("long").alias("windows"))

    asked = classes.where("contexts > 1 and singles > 0").select("gram", "n", "contexts", "head.*")
    by_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("gram", "n", "contexts", "first", "windows", "offset")).alias("asked"))
    fetched = texts.join(by_doc, "doc").select("doc", F.encode("text", "UTF-8").alias("b"), "asked")
    cut = F.transform("asked", lambda p: F.struct(p["gram"].alias("gram"), p["n"].alias("n"), p["contexts"].alias("contexts"), p["first"].alias("first"), p["windows"].cast("int").alias("windows"), p["offset"].cast("int").alias("offset"), F.substring("b", p["first"] + 1, p["windows"] + F.lit(length - 1)).alias("bytes")))
    contexts = common.stage(fetched.select("doc", F.explode(cut).alias("p")).select("doc", "p.*"))

    near = contexts.where(F.col("contexts") <= group_places).drop("contexts")
    parts = common.spread(spark, total // 8, 50_000)
    sorted_ = near.select("gram", "doc", "first", "windows", "offset", "n", "bytes").repartition(parts, "gram").sortWithinPartitions("gram")
    compared = sorted_.mapInArrow(common.tidy(_compare(length, gram)), "doc long, start long, windows long")

    crowded = contexts.where(F.col("contexts") > group_places).select("doc", "first", "windows", "n", "bytes")
    singly = crowded.mapInArrow(common.tidy(_windows(length)), "hash binary, doc long, start long, n long")
    often = singly.groupBy("hash").agg(F.sum("n").alias("times")).where("times > 1")
    apart = singly.where("n = 1").join(often, "hash", "left_semi").select("doc", "start", F.lit(1).cast("long").alias("windows"))
    found = common.stage(runs.unionByName(compared).unionByName(apart))
    for done in (places, classes, contexts):
        common.release(done)
    return found


def _rewrite(length: int, text_place: int, runs_place: int):
    """Batches with a text and its runs -> the other columns, kept, n_bytes, n_removed, n_spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, numbers = [], []
            for text, runs in zip(batch.column(text_place).cast(pa.binary()).to_pylist(), batch.column(runs_place).to_pylist(), strict=True):
                text = text or b""
                parts, at, removed, spans = [], 0, 0, 0
                end = -1
                for start, windows in sorted((r["start"], r["windows"]) for r in runs or ()):
                    stop = start + windows - 1 + length
                    if start > end:  # a gap: another span begins
                        parts.append(text[max(at, 0) : start])
                        spans += 1
                        removed += stop - start
                        end = stop
                    elif stop > end:
                        removed += stop - end
                        end = stop
                    at = end
                parts.append(text[at:])
                kept.append(b"".join(parts))
                numbers.append((len(text), removed, spans))
            rest = [k for k in range(batch.num_columns) if k not in (text_place, runs_place)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(kept, pa.binary()), *(pa.array([x[k] for x in numbers], pa.int64()) for k in range(3))], [*(batch.schema.names[k] for k in rest), "kept", "n_bytes", "n_removed", "n_spans"])

    return run


@F.pandas_udf(T.StringType())
def whole_characters(kept: pd.Series) -> pd.Series:
    """Bytes as text, without the parts of characters that a cut has left."""
    return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def _worded(length: int, words: int):
    """(doc, text, runs) -> (doc, repeats): whether some run of repeated windows has more than so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, runs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for start, windows in sorted((r["start"], r["windows"]) for r in runs):
                    stop = start + windows - 1 + length
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(stop, spans[-1][1])
                    else:
                        spans.append([start, stop])
                found.append(any(len(text[a:b].split()) > words for a, b in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], ["doc", "repeats"])

    return run


def with_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 240, gram: int = 96, words: int = 50) -> DataFrame:
    """id_col (a unique integer) of the documents with a passage of over so many words, and of length bytes at least, that also stands elsewhere."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    by_doc = repeated_runs(texts, length, gram).groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    found = texts.join(by_doc, "doc").select("doc", "text", "runs").mapInArrow(common.tidy(_worded(length, words)), "doc long, repeats boolean")
    return found.where("repeats").select(F.col("doc").alias(id_col)).distinct()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 128, group_places: int = 20_000) -> DataFrame:
    """docs without its text, and with kept (the remaining bytes), n_bytes, n_removed and n_spans. Columns of these four names are replaced; any other is kept."""
    own, names = common.numbered(docs.drop("kept", "n_bytes", "n_removed", "n_spans"))
    ident, text = (own.columns[names.index(c)] for c in (id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    if kind in ("bigint", "int") and own.groupBy(ident).count().where((F.col("count") > 1) | F.col(ident).isNull()).isEmpty():
        keyed = own.withColumn("doc", F.col(ident).cast("long"))
    else:
        keyed = common.stage(own.withColumn("doc", F.monotonically_increasing_id()))
    runs = repeated_runs(keyed.select("doc", F.col(text).alias("text")), length, gram, group_places)
    by_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    joined = keyed.join(by_doc, "doc", "left").select(*own.columns, "runs")
    rest = [f for f in own.schema if f.name != text]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)
    cut = joined.mapInArrow(common.tidy(_rewrite(length, own.columns.index(text), len(own.columns))), f"{schema}, kept binary, n_bytes long, n_removed long, n_spans long")
    return cut.toDF(*[n for n in names if n != text_col], "kept", "n_bytes", "n_removed", "n_spans")
