"""Alignment of two tokenizers' tokens over the same bytes, and how often which tokens meet in the corpus.

A is a byte-level BPE tokenizer (tokenizers library), B one of pieces with byte fallback (sentencepiece). A encodes a space and the text, B the text (it adds the
space). Tokens link where their byte ranges overlap.

1. Texts are cut where both tokenizers must cut: before a single space or line feed between two characters that are no white space. Every distinct chunk of a block of texts is encoded
   and aligned once: the ends of B's tokens are a static index over their intervals; each token of A stabs it by bisection, at its start and at its end, and gets the range
   of tokens of B that it overlaps. An end of a token of B that no token of A spans is a boundary between groups. New chunks lie on one axis, one after the other.
2. A block of texts becomes one row: the documents, the places of their chunks among the distinct ones, and the block's distinct pairs of ids with their counts. It
   is staged, so texts are read and encoded once.
3. Pairs are counted over all blocks; the highest count of every id of B is a window over its pairs (no more than A has ids).
4. The counts of a block's pairs come back to it by a join on the pair and one on the block, and are summed by chunk and then by document. What shuffles
   is numbers only: the distinct pairs of each block twice, the ids of its distinct chunks and their places once.

A pair is in as many rows as there are blocks at most, so no pair is hot. A block ends after the 256 texts with which
it has so many distinct chunks or places.

Defined results: texts that are null or empty, or whose bytes the tokens of A or B don't give back (for B, those that hold U+2581), have no tokens: zeros, and no
groups (an empty string). They count for nothing. Strings of special tokens are plain text. Repeated rows count as often as they occur and each get their row, whatever their
ids; ties of count are all best. Very long texts are aligned whole. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm import chunks, common

#: Bits of B's id in a pair of ids.
SHIFT = 24
#: Before a single space or line feed between characters that no tokenizer takes for white space.
CUT = re.compile(r"(?<=[^\s\x85])(?=[ \n][^\s\x85])")
BLOCK = "block long, rows array<{kind}>, sizes array<int>, places binary, a_ids binary, a_sizes binary, b_ids binary, b_sizes binary, pairs array<long>, counts array<long>"


def split(text: str) -> list[str]:
    """text, which begins with a space: in chunks that are encoded for themselves, each with its space or its line feed."""
    if chunks.OTHER_SPACE.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text.endswith((" ", "\n")):
        return CUT.split(text)
    return [x if x[:1] == "\n" else " " + x for x in text[1:].replace("\n", " \n").split(" ")]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of A the first token of B that it overlaps and the one after the last; and the tokens of B with which a group ends.

    Tokens follow each other without gaps from 0; both arrays of ends end alike.
    """
    starts = np.concatenate([[0], a_ends[:-1]])
    low, high = np.searchsorted(b_ends, starts, side="right"), np.searchsorted(b_ends, a_ends, side="left") + 1
    spanned = np.zeros(len(b_ends) + 1, dtype=np.int64)  # the gap after token j of B lies inside a token of A for low <= j < high - 1
    np.add.at(spanned, low, 1)
    np.add.at(spanned, high - 1, -1)
    return low, high, np.flatnonzero(np.cumsum(spanned[:-1]) == 0)


class Aligned(NamedTuple):
    """Chunks: their numbers of groups; groups as text; pairs of ids, one after the other, with how often they link, and how many pairs each chunk has."""

    n_groups: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    times: np.ndarray
    width: np.ndarray


def _pieces(listed: list[list[int]]) -> list[bytes]:
    """Each list as unsigned 32-bit integers."""
    sizes = np.fromiter(map(len, listed), dtype=np.int64, count=len(listed))
    flat = np.fromiter(chain.from_iterable(listed), dtype="<u4", count=int(sizes.sum())).tobytes()
    ends = (4 * np.cumsum(sizes)).tolist()
    return [flat[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]


#: The tokenizers, kept as long as the Python worker lives.
_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a: str, b: str) -> Pair:
    found = _pairs.get((a, b))
    if found is None:
        found = _pairs[a, b] = Pair(a, b)
    return found


class Pair:
    """The two tokenizers, and the tokens of at most about so many chunks."""

    def __init__(self, a: str, b: str, cached: int = 150_000):
        chunks.os_environ_off()
        import sentencepiece
        from tokenizers import Tokenizer

        self.cached = cached
        self.seen: dict[str, bytes | None] = {}
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        own = {c: bytes([n]) for n, c in chunks.byte_alphabet().items()}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = b"".join(own.get(c, c.encode()) for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or self.b.encode("a b", out_type=str)[0] != "▁a":
            raise ValueError("a tokenizer is needed of which no piece goes on over a space or a line feed, and which adds one before the text")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in parts]) for parts in (self.a_bytes, self.b_bytes))
        shown = lambda n, end: np.array([f"{i}{end}" for i in range(n)], dtype=object)
        self.a_text, self.b_text = ([shown(len(parts), end) for end in ends] for parts, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))

    def encode(self, listed: list[str]) -> list[bytes | None]:
        """Chunks that begin with a space or a line feed: how many ids of A, these, and those of B (unsigned, 32 bits each); None where their bytes are not those of the chunk."""
        if not listed:
            return []
        a = _pieces([e.ids for e in self.a.encode_batch_fast(listed, add_special_tokens=False)])
        b = self.b.encode([x[1:] if x[0] == " " else x for x in listed], num_threads=1)  # it adds a space
        b = _pieces([ids if x[0] == " " else ids[1:] for x, ids in zip(listed, b, strict=True)])
        return [(len(x) // 4).to_bytes(4, "little") + x + y if good else None for x, y, good in zip(a, b, self._known(listed, a, b), strict=True)]

    def _known(self, listed: list[str], a: list[bytes], b: list[bytes]) -> list[bool]:
        """Which chunks have tokens whose bytes are theirs: all of a list looked at together, or else each half."""
        whole = "".join(listed).encode()
        sizes = np.fromiter(map(len, map(str.encode, listed)), dtype=np.int64, count=len(listed))
        good = True
        for own, table, size in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            ids = np.frombuffer(b"".join(own), dtype="<u4")
            ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4)
            good = good and np.array_equal(np.concatenate([[0], np.cumsum(size[ids])])[ends], np.cumsum(sizes)) and b"".join(map(table.__getitem__, ids.tolist())) == whole
        if good or len(listed) == 1:
            return [bool(good)] * len(listed)
        half = len(listed) // 2
        return self._known(listed[:half], a[:half], b[:half]) + self._known(listed[half:], a[half:], b[half:])

    def align(self, left: np.ndarray, n_a: np.ndarray, right: np.ndarray, n_b: np.ndarray, texts: bool = True) -> Aligned:
        """Chunks of equal bytes on both sides, on one axis: ids of A and how many each chunk has, and the same of B. Chunk ends are ends of tokens of both."""
        if not len(left):
            return Aligned(n_a, [], left, left, n_a)
        a_ends, b_ends = np.cumsum(self.a_size[left]), np.cumsum(self.b_size[right])
        low, high, last_b = overlaps(a_ends, b_ends)
        chunk_of_a, chunk_of_b = (np.repeat(np.arange(len(n)), n) for n in (n_a, n_b))
        n_groups = np.bincount(chunk_of_b[last_b], minlength=len(n_a))
        # links, and how often each pair of ids links in a chunk
        many = high - low
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        other = np.arange(many.sum()) - np.repeat(first - low, many)
        n_right, n_pairs = len(self.b_bytes), len(self.a_bytes) * len(self.b_bytes)
        keys = np.repeat(chunk_of_a * n_pairs + left * n_right, many) + right[other]
        keys.sort()
        fresh = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
        times = np.diff(np.append(fresh, len(keys)))
        keys = keys[fresh]
        at = keys // n_pairs
        keys -= at * n_pairs
        codes = (keys // n_right << SHIFT) | keys % n_right
        groups = self._shown(left, n_a, right, n_b, a_ends, b_ends, last_b) if texts else []
        return Aligned(n_groups, groups, codes, times, np.bincount(at, minlength=len(n_a)))

    def _shown(self, left: np.ndarray, n_a: np.ndarray, right: np.ndarray, n_b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, last_b: np.ndarray) -> list[str]:
        """The groups of each chunk as text: the ids of A of a group, then those of B, each with what follows it."""
        last_a = np.searchsorted(a_ends, b_ends[last_b])
        words = np.empty(len(left) + len(right), dtype=object)
        size_a, size_b = (np.diff(last, prepend=-1) for last in (last_a, last_b))  # tokens of each group
        places_a = np.arange(len(left)) + np.repeat(np.cumsum(size_b) - size_b, size_a)
        places_b = np.arange(len(right)) + np.repeat(np.cumsum(size_a), size_b)
        words[places_a], words[places_b] = self.a_text[0][left], self.b_text[0][right]
        words[places_a[last_a]], words[places_b[last_b]] = self.a_text[1][left[last_a]], self.b_text[1][right[last_b]]
        listed = words.tolist()
        stops = np.cumsum(n_a + n_b).tolist()
        return ["".join(listed[lo:hi])[:-1] for lo, hi in zip([0, *stops], stops, strict=False)]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, small ones first by byte and then compressed."""
    values = values.astype("<u4")
    return len(values).to_bytes(8, "little") + pa.compress(values.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.int64)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Block:
    def __init__(self, pair: Pair):
        self.pair = pair
        self.rows: list = []
        self.sizes: list[int] = []
        self.places: list[bytes] = []
        self.size = 0
        self.at: dict[str, int] = {}  # chunk -> its place, or -1 where it has no tokens
        self.tokens: list[bytes] = []  # of the chunks by place

    def _learn(self, listed: list[str]) -> None:
        seen = self.pair.seen
        new = [chunk for chunk in listed if chunk not in seen]
        fresh = dict(zip(new, self.pair.encode(new), strict=True))
        for chunk in listed:
            found = fresh[chunk] if chunk in fresh else seen[chunk]
            self.at[chunk] = -1 if found is None else len(self.tokens)
            if found is not None:
                self.tokens.append(found)
        if len(seen) < self.pair.cached:  # the first ones, among which the common ones are
            seen.update((chunk, found) for chunk, found in fresh.items() if len(chunk) < 200)

    def add(self, rows: list, texts: list[str | None]) -> None:
        parts = [split(" " + t) if t else [] for t in texts]
        self._learn(list(set(chain.from_iterable(parts)).difference(self.at)))
        for row, text, own in zip(rows, texts, parts, strict=True):
            placed = array("i", map(self.at.__getitem__, own))
            if -1 in placed:  # perhaps the whole text gives its bytes back although a chunk doesn't
                if " " + text not in self.at:
                    self._learn([" " + text])
                whole = self.at[" " + text]
                placed = array("i", [] if whole < 0 else [whole])
            self.rows.append(row)
            self.sizes.append(len(placed))
            self.places.append(placed.tobytes())
            self.size += len(placed)

    def batch(self, block: int, kind: pa.DataType) -> pa.RecordBatch:
        places = np.frombuffer(b"".join(self.places), dtype="<i4")
        size = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(self.tokens)) // 4
        ids = np.frombuffer(b"".join(self.tokens), dtype="<u4").astype(np.int64)
        starts = np.cumsum(size) - size
        n_a = ids[starts]
        own = np.arange(len(ids)) - np.repeat(starts, size)  # 0 is the number
        of_a = own <= np.repeat(n_a, size)
        flat = [ids[of_a & (own > 0)], n_a, ids[~of_a], size - 1 - n_a]
        del ids, own, of_a
        self.at, self.tokens = {}, []
        aligned = self.pair.align(*flat, texts=False)
        pairs, met = np.unique(aligned.pairs, return_inverse=True)
        used = np.repeat(np.bincount(places, minlength=len(aligned.width)), aligned.width)
        counts = np.bincount(met, weights=aligned.times * used, minlength=len(pairs)).astype(np.int64)
        some = counts > 0  # a chunk of a text without tokens may be used nowhere
        one = lambda values, kind: pa.array([values], kind)
        arrays = [
            one(block, pa.int64()), one(self.rows, pa.list_(kind)), one(self.sizes, pa.list_(pa.int32())), *(one(packed(x), pa.binary()) for x in (places, *flat)),
            one(pairs[some], pa.list_(pa.int64())), one(counts[some], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(arrays, [x.split(" ")[0] for x in BLOCK.split(", ")])


def blocks_of(docs: DataFrame, a: str, b: str, block_chunks: int, block_places: int) -> DataFrame:
    """docs: row and text. Staged blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        number = TaskContext.get().partitionId() << 40  # another for every block, the same when a task runs again
        block, kind = _Block(pair), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                if len(block.at) >= block_chunks or block.size >= block_places:
                    yield block.batch(number, kind)
                    number += 1
                    block = _Block(pair)
                block.add(*(batch.column(c).slice(at, 256).to_pylist() for c in (0, 1)))
        if block.rows:
            yield block.batch(number, kind)

    return common.stage(docs.mapInArrow(common.tidy(run), BLOCK.format(kind=docs.schema["row"].dataType.simpleString())))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (links that hold it linked), and best: whether no pair with the same id of B has more."""
    listed = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    totals = listed.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    return totals.withColumn("best", F.col("n") == F.max("n").over(of_b))


def summed(a: str, b: str):
    """A block with the counts of its pairs -> its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        before = lambda values: np.concatenate([[0], np.cumsum(values)])
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                places, left, n_a, right, n_b = (unpacked(row[name].as_py()) for name in ("places", "a_ids", "a_sizes", "b_ids", "b_sizes"))
                aligned = pair.align(left, n_a, right, n_b)
                n, best = (np.zeros(len(aligned.pairs), dtype=np.int64) for _ in range(2))
                if row["known"].is_valid:
                    known = [row["known"].values.field(x).to_numpy(zero_copy_only=False) for x in ("pair", "n", "best")]
                    order = np.argsort(known[0])
                    pairs, counts, highest = (x[order] for x in known)
                    at = np.minimum(np.searchsorted(pairs, aligned.pairs), len(pairs) - 1)
                    n, best = np.where(pairs[at] == aligned.pairs, (counts[at], highest[at]), 0)  # none of a chunk that no text uses
                starts = before(aligned.width)
                facts = [n_a, n_b, aligned.n_groups, *(np.diff(before(aligned.times * x)[starts]) for x in (1, best, n))]
                ends = before(row["sizes"].values.to_numpy())
                sums = [np.diff(before(x[places])[ends]) for x in facts]
                texts = [";".join(map(aligned.groups.__getitem__, places[lo:hi].tolist())) for lo, hi in zip(ends, ends[1:], strict=False)]
                out = pa.RecordBatch.from_arrays([row["rows"].values, *map(pa.array, sums), pa.array(texts, pa.string())], ["row", *NUMBERS, "groups"])
                for at in range(0, out.num_rows, 512):
                    yield out.slice(at, 512)

    return run


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", block_chunks: int = 1 << 17, block_places: int = 1 << 20) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (text: ids of A, |, ids of B; groups apart by ;).

    a: file of a byte-level BPE tokenizer; b: file of a sentencepiece model. count_sum adds up, over the document's links, how often the pair of ids is linked in the
    corpus; n_best counts the links whose pair is linked most often of those with its id of B.
    """
    own = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    blocks = blocks_of(own, a, b, block_chunks, block_places)
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    known = asked.join(pair_counts(blocks), "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("known"))
    whole = blocks.drop("pairs", "counts").join(known, "block", "left")
    kind = own.schema["row"].dataType.simpleString()
    return whole.mapInArrow(common.tidy(summed(a, b)), f"row {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, groups string").toDF(id_col, *NUMBERS, "groups")
