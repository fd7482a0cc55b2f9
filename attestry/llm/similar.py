"""Groups of similar documents: a Jaccard similarity of their sets of word shingles of 0.8 or more, links being transitive.

Candidates come from a SimHash of 504 bits in 21 slices of 24. Two documents of similarity 0.8 differ in about 15 of 100 bits, far too many for a
search of the whole fingerprint, but in some slice nearly always in 2 or fewer. So each slice has its own hierarchical index in Gray order (see gray_index)
that is searched within 2 bits; what differs in no more of the 504 bits than the mean at the threshold and four standard deviations is a candidate.
A candidate is a link only if the shingle sets themselves, as 64-bit hashes, are that similar.

Sets are large, so few pairs should meet. First, of each document (then of each group that hangs together) the candidate with the smallest key and the
nearest one are compared. A second search, among documents with a candidate, gives all candidates across the groups found so far that can be similar
enough: each document brings the size of its set and a bitmap of it, of 2048 bits, which together say how many shingles two sets have in common at most.
Those that cannot reach the similarity never leave the task, so many documents that are a little less similar to each other cost no rows; all others are
compared. No pair that is similar enough is left out but those that hang together already, so the groups are those of all candidates. Cells by leading
bits, members and queries are as in simhash.links.

Missed pairs: at similarity 0.8, one slice in 3.6 agrees within 2 bits, so that all 21 fail for one pair in 1000; of sets of a few shingles more do.

Defined results: a null, empty or all-white-space text has no word; repeated rows are one group; of ids that are repeated, null or no integers, the first row
stays; a very long text is one set of shingles; an empty table gives an empty result. Documents without a word are all alike, as are those of one fingerprint. Fewer words than a shingle: the whole sequence
is the one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import common, graph, simhash
from attestry.llm.gray_index import GrayIndex

SLICES, WIDTH, RADIUS = 21, 24, 2
WORDS64 = 8
BITMAP64 = 32


def most_bits(similarity: float, slack: float = 4) -> int:
    """Differing bits of 504 at this similarity of sets of one size, with slack standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = SLICES * WIDTH
    return math.floor(n * p + slack * math.sqrt(n * p * (1 - p)))


def wide_fingerprint(text: bytes | None, words: int) -> bytes:
    """Eight 64-bit words, of which the first 504 bits count: majorities over the set of shingles, each hashed eight ways."""
    h = np.unique(simhash.shingle_hashes(text, words))
    out = np.zeros(WORDS64, dtype=np.uint64)
    for k in range(WORDS64 if len(h) else 0):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[k] = simhash.majority(x ^ (x >> np.uint64(31)))
    return out.tobytes()


def size_and_bitmap(hashes: np.ndarray) -> np.ndarray:
    """The size of a set of 64-bit hashes, and which values their last 11 bits take."""
    bits = np.zeros(BITMAP64 * 64, dtype=np.uint8)
    bits[hashes & np.uint64(BITMAP64 * 64 - 1)] = 1
    return np.concatenate([np.array([len(hashes)], dtype=np.uint64), np.packbits(bits).view(np.uint64)])


def may_reach(similarity: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether two sets can be so similar: each bit of one bitmap alone stands for at least one hash that the other set lacks."""
    n, m = a[:, 0].astype(np.int64), b[:, 0].astype(np.int64)
    only_a, only_b = (np.bitwise_count(x[:, 1:] & ~y[:, 1:]).sum(axis=1).astype(np.int64) for x, y in ((a, b), (b, a)))
    both = np.minimum(n - only_a, m - only_b)
    return both >= similarity * (n + m - both) - 1e-9


def slices(prints: np.ndarray) -> np.ndarray:
    """prints: n x 64 bytes or more. The slices as 24-bit numbers: n x 21."""
    three = prints[:, : SLICES * 3].reshape(len(prints), SLICES, 3).astype(np.uint32)
    return three[:, :, 0] << 16 | three[:, :, 1] << 8 | three[:, :, 2]


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _dealt(bits: int):
    """(key, label, print) -> (cell, role, value, key, label, print): each slice's own cell, and lower ones within the radius."""
    masks = np.array(simhash._near_masks(bits, RADIUS), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels, prints = (batch.column(k) for k in range(3))
            if not batch.num_rows:
                continue
            cut = slices(_rows_of(prints))
            for t in range(SLICES):
                own = (cut[:, t] >> (WIDTH - bits)).astype(np.int64) if bits else np.zeros(len(cut), dtype=np.int64)
                to = own[:, None] ^ masks[None, :]
                who, which = np.nonzero((masks[None, :] == 0) | (to < own[:, None]))
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(t) << bits) | to[who, which]), pa.array((which > 0).astype(np.int32)), pa.array(cut[who, t].astype(np.int64)), keys.take(at), labels.take(at), prints.take(at)], ["cell", "role", "value", "key", "label", "print"])

    return run


def _cut(lo: np.ndarray, hi: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges in pieces of at most step: of which range, from, to."""
    n = -(-(hi - lo) // step)
    of = np.repeat(np.arange(len(lo)), n)
    start = lo[of] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step[of]
    return of, start, np.minimum(start + step[of], hi[of])


def _blocks(q_lo: np.ndarray, q_hi: np.ndarray, m_lo: np.ndarray, m_hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All of each range of q with all of the range of m beside it, in blocks of at most twice so many pairs, however long a range is."""
    of, m_lo, m_hi = _cut(m_lo, m_hi, np.full(len(m_lo), most))
    again, q_lo, q_hi = _cut(q_lo[of], q_hi[of], most // np.maximum(m_hi - m_lo, 1))
    m_lo, m_hi = m_lo[again], m_hi[again]
    sizes = (q_hi - q_lo) * (m_hi - m_lo)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1, [len(sizes)]])
    for lo, hi in zip(edges, edges[1:], strict=False):
        if lo < hi:
            size, each = sizes[lo:hi], np.repeat(m_hi[lo:hi] - m_lo[lo:hi], sizes[lo:hi])
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield np.repeat(q_lo[lo:hi], size) + within // each, np.repeat(m_lo[lo:hi], size) + within % each


class _Grouped:
    """Rows of a cell by slice value, then label: of uniq[u] starts[u] to starts[u + 1]; those of one label too from subs[k] to subs[k + 1]."""

    def __init__(self, values: np.ndarray, keys: np.ndarray, labels: np.ndarray, prints: np.ndarray):
        order = np.lexsort((keys, labels, values))
        values, self.keys, self.labels = values[order], keys[order], labels[order]
        self.prints, self.sets = prints[order, :WORDS64], prints[order, WORDS64:]
        self.uniq, starts = np.unique(values, return_index=True)
        self.starts = np.append(starts, len(values))
        changed = (np.diff(values) != 0) | (np.diff(self.labels) != 0)
        self.subs = np.concatenate([[0], np.flatnonzero(changed) + 1, [len(values)]]) if len(values) else np.zeros(1, dtype=np.int64)
        self.sub_starts = np.searchsorted(self.subs, self.starts)

    def choose_pivots(self, limit: int, few: int = 16) -> None:
        """Of few rows of a value all are pivots; of more, so many that each row is one or is within the limit of one."""
        is_pivot = np.ones(len(self.keys), dtype=bool)
        for u in np.flatnonzero(np.diff(self.starts) > few):
            rest = np.arange(self.starts[u], self.starts[u + 1])
            is_pivot[rest] = False
            while len(rest):
                is_pivot[rest[0]] = True
                rest = rest[1:][np.bitwise_count(self.prints[rest[1:]] ^ self.prints[rest[0]]).sum(axis=1) > limit]
        self.is_pivot, self.pivots = is_pivot, np.flatnonzero(is_pivot)
        self.pivot_starts = np.searchsorted(self.pivots, self.starts)


def _chosen(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs, those of the smallest and of the nearest partner of every key, which comes first."""
    return _best(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d]))


def _best(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a, the pair with the smallest b and that of the smallest d."""
    kept = []
    for order in (np.lexsort((b, a)), np.lexsort((b, d, a))):
        kept.append(order[np.flatnonzero(np.diff(a[order], prepend=a[order[:1]] - 1))])
    smallest, nearest = kept
    at = np.concatenate([smallest, nearest[b[nearest] != b[smallest]]])  # both have one place for each a, in the order of a
    return a[at], b[at], d[at]


def _candidates(limit: int, every: bool, similarity: float = 0, most_pairs: int = 1 << 16):
    """Rows (cell, role, value, key, label, print) sorted by cell and role, members (role 0) first -> candidates a, b of d differing bits.

    every: all those of different labels, and with a similarity only those whose sets may be so similar, prints being followed by sizes and bitmaps; groups of one value and label are left out whole. Otherwise of each fingerprint, as a, the smallest and the
    nearest b of the whole cell, two rows at most; where many have one value they meet only pivots, so a group of near copies costs in proportion to its size, but each that has a candidate gets one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, held = None, [], None
        pending, size, room = [], 0, 4 * most_pairs  # what is chosen in the cell so far

        def near(q: _Grouped, m: _Grouped, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = np.bitwise_count(q.prints[x] ^ m.prints[y]).sum(axis=1).astype(np.int64)
            keep = np.flatnonzero(d <= limit)
            if similarity:
                keep = keep[may_reach(similarity, q.sets[x[keep]], m.sets[y[keep]])]
            return x[keep], y[keep], d[keep]

        def to_pivots(q: _Grouped, m: _Grouped, qu: np.ndarray, mu: np.ndarray, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            alone = np.ones(len(q.keys), dtype=bool)
            for x, k in _blocks(q.starts[qu], q.starts[qu + 1], m.pivot_starts[mu], m.pivot_starts[mu + 1], most_pairs):
                y = m.pivots[k]
                if inner:
                    keep = np.where(q.is_pivot[x], y < x, True)
                    x, y = x[keep], y[keep]
                x, y, d = near(q, m, x, y)
                alone[x] = False
                yield x, y, d
            if inner:  # whatever is near a row that is no pivot is a pivot or near one, and that row is, too
                return
            more = np.flatnonzero(m.pivot_starts[mu + 1] - m.pivot_starts[mu] < m.starts[mu + 1] - m.starts[mu])
            of, x, _ = _cut(q.starts[qu[more]], q.starts[qu[more] + 1], np.ones(len(more), dtype=np.int64))
            of, x = of[alone[x]], x[alone[x]]
            for x, y in _blocks(x, x + 1, m.starts[mu[more[of]]], m.starts[mu[more[of]] + 1], most_pairs):
                yield near(q, m, x, y)

        def across_labels(q: _Grouped, m: _Grouped, qu: np.ndarray, mu: np.ndarray, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for s, t in _blocks(q.sub_starts[qu], q.sub_starts[qu + 1], m.sub_starts[mu], m.sub_starts[mu + 1], most_pairs):
                keep = q.labels[q.subs[s]] != m.labels[m.subs[t]]
                if inner:
                    keep &= t < s
                s, t = s[keep], t[keep]
                for x, y in _blocks(q.subs[s], q.subs[s + 1], m.subs[t], m.subs[t + 1], most_pairs):
                    yield near(q, m, x, y)

        def batch_of(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "d"])

        def found(q: _Grouped, inner: bool) -> Iterator[pa.RecordBatch]:
            nonlocal size, room
            index, m = held
            for qu, mu in index.search(q.uniq.astype(np.uint64) << np.uint64(64 - WIDTH), RADIUS, 128):  # a query meets thousands of nodes on its way
                for x, y, d in (across_labels if every else to_pivots)(q, m, qu, mu, inner):
                    if not len(x):
                        continue
                    if every:
                        yield batch_of((q.keys[x], m.keys[y], d))
                        continue
                    pending.append(_chosen(q.keys[x], m.keys[y], d))
                    size += len(pending[-1][0])
                    if size > room:
                        pending[:] = [_best(*(np.concatenate(c) for c in zip(*pending, strict=True)))]
                        size = len(pending[0][0])
                        room = max(4 * most_pairs, 2 * size)

        def chosen() -> Iterator[pa.RecordBatch]:
            nonlocal size, room
            if pending:
                yield batch_of(_best(*(np.concatenate(c) for c in zip(*pending, strict=True))))
            pending.clear()
            size, room = 0, 4 * most_pairs

        def build() -> Iterator[pa.RecordBatch]:
            nonlocal parts, held
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros((0, WORDS64 + (1 + BITMAP64 if similarity else 0)) if k == 3 else 0, dtype=np.uint64 if k == 3 else np.int64) for k in range(4)]
            parts = []
            members = _Grouped(*columns)
            if not every:
                members.choose_pivots(limit)
            held = (GrayIndex(members.uniq.astype(np.uint64) << np.uint64(64 - WIDTH)), members)
            yield from found(members, True)

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, roles, *columns = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            columns.append(_rows_of(batch.column(5)).view(np.uint64))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(roles) != 0)) + 1
            for own in np.split(np.arange(len(cells)), cuts):
                if cells[own[0]] != cell:
                    if held is None and parts:
                        yield from build()
                    yield from chosen()
                    cell, held, parts = cells[own[0]], None, []
                if roles[own[0]] == 0:
                    parts.append([c[own] for c in columns])
                else:
                    if held is None:
                        yield from build()
                    yield from found(_Grouped(*(c[own] for c in columns)), False)
        if held is None and parts:
            yield from build()
        yield from chosen()

    return run


def _searched(prints: DataFrame, similarity: float, every: bool, per_cell: int) -> DataFrame:
    """prints: key, label, print (for every: followed by size and bitmap), staged. Candidates a, b, d, staged."""
    total = prints.count()
    bits = min(WIDTH - 4, max(0, math.ceil(math.log2(max(1, total / per_cell)))))
    dealt = prints.select("key", "label", "print").mapInArrow(common.tidy(_dealt(bits)), "cell long, role int, value long, key long, label long, print binary")
    parts = common.spread(prints.sparkSession, total * SLICES, per_cell)
    sorted_ = dealt.repartition(parts, "cell").sortWithinPartitions("cell", "role")
    return common.stage(sorted_.mapInArrow(common.tidy(_candidates(most_bits(similarity), every, similarity if every else 0)), "a long, b long, d long"))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), staged, those whose sets are so similar. sets: key, hashes, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                small, large = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if small >= similarity * large - 1e-9 else 0
                alike.append(both >= similarity * (small + large - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    total, held, both = pairs.count(), [], pairs
    for side in ("a", "b"):
        uses = pairs.groupBy(F.col(side).alias("key")).agg(F.count("*").alias("uses"))
        held.append(common.stage(sets.join(uses, "key").select(F.col("key").alias(side), F.col("hashes").alias(f"{side}_hashes"), "uses")))
        both = common.attach(both, held[-1], side, "uses", total, staged=True).drop("uses")
    out = common.stage(both.mapInArrow(common.tidy(run), "a long, b long"))
    for facts in held:
        common.release(facts)
    return out


def _links(docs: DataFrame, row_col: str, text_col: str, distinct: DataFrame, words: int, similarity: float, per_cell: int, rounds: int = 2) -> DataFrame:
    """distinct: key, print, staged. Links a, b between keys, whose components are those of all candidates that are so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(simhash.shingle_hashes(t.as_py(), words)) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in found], pa.binary()), pa.array([size_and_bitmap(h).tobytes() for h in found], pa.binary())], ["key", "hashes", "bound"])

    found = _searched(distinct.withColumn("label", F.col("key")), similarity, False, per_cell)
    first = common.stage(found.distinct())  # several slices find the same
    common.release(found)
    keys = common.stage(first.select(F.col("a").alias("key")).distinct())
    sets = common.stage(docs.join(keys, docs[row_col] == keys["key"], "left_semi").select(row_col, text_col).mapInArrow(common.tidy(run), "key long, hashes binary, bound binary"))
    labels, tried, links = keys.withColumn("label", F.col("key")), None, None

    def compare(pairs: DataFrame) -> bool:
        nonlocal labels, tried, links
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = common.stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return False
        more = _confirmed(pairs, sets, similarity)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = more if links is None else links.unionByName(more)
        return True

    def label() -> None:
        nonlocal labels
        roots = graph.components(links).withColumnRenamed("node", "key")
        labels = common.stage(keys.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("label")))

    for _ in range(rounds):
        if tried is None:  # each is a group of its own: nothing is to be looked up
            sides = first.select("a", "b", "d", F.col("a").alias("a_label"), F.col("b").alias("b_label"))
        else:
            sides = first.join(labels.toDF("a", "a_label"), "a").join(labels.toDF("b", "b_label"), "b").where("a_label <> b_label")
            sides = sides.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b")).join(tried.toDF("low", "high"), ["low", "high"], "left_anti")
        best = sides.groupBy("a_label").agg(F.min(F.struct("b_label", "d", "a", "b")).alias("small"), F.min(F.struct("d", "b_label", "a", "b")).alias("near"))
        if not compare(best.select(F.explode(F.array(*[F.struct(f"{c}.a", f"{c}.b") for c in ("small", "near")])).alias("p")).select("p.a", "p.b")):
            break
        label()
    if links is not None:
        bounded = distinct.join(labels, "key").join(sets.select("key", "bound"), "key").select("key", "label", F.concat("print", "bound").alias("print"))
        compare(_searched(common.stage(bounded), similarity, True, per_cell))
    return links if links is not None else first.select("a", "b")


def groups(docs: DataFrame, row_col: str, text_col: str, words: int = 5, similarity: float = 0.8, per_cell: int = 1 << 18) -> DataFrame:
    """docs: a unique long row_col and a text. row_col and root (the smallest row of its group) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([wide_fingerprint(t.as_py(), words) for t in batch.column(1).cast(pa.binary())], pa.binary())], [row_col, "print"])

    prints = common.stage(docs.select(row_col, text_col).mapInArrow(common.tidy(run), f"`{row_col}` long, print binary"))
    total = prints.count()
    distinct = common.stage(prints.groupBy("print").agg(F.min(row_col).alias("key"), F.count("*").alias("n")))
    links = common.stage(_links(docs, row_col, text_col, distinct, words, similarity, per_cell))
    roots = graph.components(links).withColumnRenamed("node", "key")
    facts = distinct.join(roots, "key", "left").select("print", "n", F.coalesce("root", "key").alias("root"))
    return common.attach(prints, common.stage(facts), "print", "n", total, staged=True).select(row_col, "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest id. Columns as they are, whatever they are called."""
    own, names = common.numbered(docs)
    ident, text = common.place_of(docs, id_col), common.place_of(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    if kind in ("bigint", "int") and own.groupBy(ident).count().where((F.col("count") > 1) | F.col(ident).isNull()).isEmpty():
        keyed = own.withColumn("row", F.col(ident).cast("long"))
    else:
        keyed = common.stage(own.withColumn("row", F.monotonically_increasing_id()))
    grouped = groups(keyed, "row", text, **options)
    dropped = grouped.where(F.col("row") != F.col("root")).select("row")
    return keyed.join(dropped, "row", "left_anti").select(*own.columns).toDF(*names)
