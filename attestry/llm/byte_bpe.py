"""Byte-level BPE: encoding by ranked merges, decoding by concatenation.

1. Texts are cut by the tokenizer's pattern, a block of texts at a time. A block is its distinct words, and for each text the places of its words
   among them; it ends with the partition, or before it holds more than ``block_words`` words or ``block_places`` places.
2. The distinct words of a block are encoded in the JVM by higher-order functions: a word is an array of its bytes, and a fold merges, step by step,
   the leftmost neighbours of the lowest rank, and looks up the ranks of the two new neighbours. Ranks come from a literal: an array of small maps,
   addressed by a hash of the piece, so a look-up does not scan the vocabulary.
3. The texts of the block get the ids of their words by their places.

Words that many texts share would be folded in every block. So those that occur more than once in a bounded sample of the texts (about ``sample_rows`` of
them; the ``dictionary`` commonest at most) are folded first, by the same fold, and broadcast with their ids; a block holds the other words only. The
sample decides what is folded where, never a result.

The rest is narrow: a partition is encoded where it is read, nothing else is shuffled or written, and a lost task is run again. A word that
is in no sample and in several blocks is folded in each. The fold takes time in the square of a word's length, so a word of over ``longest`` bytes (which prose does not
have) is folded by the same rule with a heap, in n log n, in Python.

Bytes are carried as Latin-1 strings on the JVM side, one character a byte.

Defined results: a null or empty text has no ids. Repeated rows each get their row, ties of rank are merged from the left. A very long text is encoded
whole; it is a block of its own at worst. Empty table: empty result. Columns other than the id and the text are not read, so no name clashes, except that
the id column must not be called ids.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import chunks, common

BUCKETS = 1 << 16
NO_RANK = 2147483647


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def literal_ranks(ranks: dict[bytes, int]) -> Column:
    """An array of BUCKETS maps from pieces, as Latin-1 strings, to ranks; the optimizer folds it into one literal."""
    from xxhash import xxh64_intdigest

    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        maps[xxh64_intdigest(text.encode(), 42) % BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is worked out once."""
    return F.transform(F.array(value), body).getItem(0)


def fold(word: Column, table: Column) -> Column:
    """The ids of a word (Latin-1 bytes): ranked merges over its bytes. The state of the fold is where pieces start, and the rank of each with its next."""
    size = F.length(word)
    # two's complement: the low bits of the signed hash are those of the unsigned one
    rank = lambda piece: table[F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")][piece]
    pair = lambda start, stop: F.coalesce(rank(word.substr(start, stop - start)), F.lit(NO_RANK))

    def step(state: Column, _: Column) -> Column:
        cuts, ranks = state["cuts"], state["ranks"]

        def merged(at: Column) -> Column:  # the piece, from 0, that takes in its next
            def around(left: Column) -> Column:
                fresh = lambda r, j: F.when((j == at) | (j == at - 1), pair(left[j], left[j + 2])).otherwise(r)
                return F.struct(left.alias("cuts"), F.transform(F.filter(ranks, lambda _, j: j != at), fresh).alias("ranks"))

            return let(F.filter(cuts, lambda _, j: j != at + 1), around)

        least = F.coalesce(F.array_min(ranks), F.lit(NO_RANK))
        return let(least, lambda r: F.when(r == NO_RANK, state).otherwise(let(F.array_position(ranks, r).cast("int") - 1, merged)))

    first = F.struct(F.sequence(F.lit(1), size + 1).alias("cuts"), F.transform(F.sequence(F.lit(1), size - 1), lambda i: pair(i, i + 2)).alias("ranks"))
    ids = lambda state: F.transform(F.slice(state["cuts"], F.lit(1), F.size(state["cuts"]) - 1), lambda c, j: rank(word.substr(c, state["cuts"][j + 1] - c)))
    steps = F.aggregate(F.sequence(F.lit(2), size), first, step, ids)
    return let(rank(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).when(size > 1, steps).otherwise(F.array().cast("array<int>")))


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one very long word: a heap of candidate merges over a linked list."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Block:
    """Distinct words in order of first sight, and the places of the words of each text."""

    def __init__(self, find, longest: int, common_words: dict[str, int] | None = None):
        self.find, self.longest = find, longest
        self.common = common_words or {}  # the first places are those of the dictionary
        self.words: dict[str, int] = {}
        self.long: dict[str, int] = {}  # numbered -1, -2, ...
        self.known = chunks.Chunks(80_000)  # places of the words of a chunk
        self.known.work = self._chunk
        self.rows: list = []
        self.places: list[bytes] = []
        self.size = 0

    def _place(self, word: str) -> int:
        place = self.common.get(word)
        if place is None:
            place = self.words.get(word)
        if place is None:
            if len(word) * 4 > self.longest and len(word.encode()) > self.longest:
                return self.long.setdefault(word, -1 - len(self.long))
            self.words[word] = place = len(self.common) + len(self.words)
        return place

    def _chunk(self, chunk: str) -> bytes:
        body = chunk[1:]
        if chunk[0] == " " and (body.isascii() or body and max(body) < chunks.LATIN):
            if body.isalpha():
                return self._place(chunk).to_bytes(4, "little", signed=True)
            if body[-1:] in chunks.MARKS and body[:-1].isalpha():  # a word behind a space is a chunk of its own elsewhere
                return self.known[body[:-1]] + self._place(body[-1]).to_bytes(4, "little", signed=True)
            found = self.find(chunk)
        else:
            found = chunks.words(chunk, self.find) if max(chunk) < chunks.LATIN else self.find(chunk)
        return array("i", [self._place(w) for w in found]).tobytes()

    def add(self, row, text: str | None) -> None:
        if not text:
            placed = b""
        elif chunks.plain(text):
            first, *rest = text.replace("\n", " \n").split(" ")  # as chunks.split() does
            placed = (self._chunk(first) if first else b"") + b"".join(map(self.known.__getitem__, rest))
        else:
            placed = self._chunk(text)
        self.rows.append(row)
        self.places.append(placed)
        self.size += len(placed) // 4

    def batch(self, ranks: dict[bytes, int], kind: pa.DataType) -> pa.RecordBatch:
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        self.known = None  # it holds a method of this block, so both would stay
        sizes = [len(p) // 4 for p in self.places]
        words = [w.encode().decode("latin-1") for w in self.words]
        long_ids = [fold_long(w.encode(), ranks) for w in self.long]
        return pa.RecordBatch.from_arrays(
            [one(self.rows, kind), one(sizes, pa.int32()), pa.array([b"".join(self.places)], pa.binary()), one(words, pa.string()), one(long_ids, pa.list_(pa.int32()))], ["rows", "sizes", "places", "words", "long_ids"]
        )


def _ids_of(rows: pa.Array, sizes: np.ndarray, places: np.ndarray, lists: list[pa.ListArray], most: int) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """The ids of each text of a block, by the places of its words, in parts of about so many places."""
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False).astype(np.int32) for x in lists])
    offsets = [x.offsets.to_numpy().astype(np.int64) for x in lists]
    starts, shift = [], 0
    for own in offsets:
        starts.append(own[:-1] - own[0] + shift)
        shift += int(own[-1] - own[0])
    begin, length = np.concatenate(starts), np.concatenate([np.diff(own) for own in offsets])
    short = sum(len(own) - 1 for own in offsets[:-1])
    places = np.where(places < 0, short - 1 - places, places)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(edges // most)) + 1, [len(sizes)]]))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        own = places[edges[lo] : edges[hi]]
        each = length[own]
        stop = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(begin[own] - stop[:-1], each) + np.arange(stop[-1])]
        yield rows.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(stop[edges[lo : hi + 1] - edges[lo]].astype(np.int32)), pa.array(ids))


def _dictionary(texts: DataFrame, ranks: dict[bytes, int], pattern: str, longest: int, most: int, sample_rows: int) -> tuple[dict[str, int], pa.ListArray]:
    """The numbers of the words that occur more than once in a sample of the texts, and the ids of each: the most common ones, at most so many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, found = regex.compile(pattern).findall, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for chunk in [] if not text else chunks.split(text) if chunks.plain(text) else [text]:
                    found.update(chunks.words(chunk, find) if max(chunk) < chunks.LATIN else find(chunk))
                if len(found) > most:
                    yield told(found)
                    found.clear()
        yield told(found)

    def told(found: Counter) -> pa.RecordBatch:
        own = {w.encode().decode("latin-1"): n for w, n in found.items() if len(w) * 4 <= longest or len(w.encode()) <= longest}
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["word", "n"])

    rows = texts.count() if most else 0
    if not rows:
        return {}, pa.array([], pa.list_(pa.int32()))
    sample = texts.sample(min(1.0, sample_rows / rows), 7) if rows > sample_rows else texts
    counted = sample.mapInArrow(common.tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    chosen = counted.orderBy(F.desc("n"), "word").limit(most).select("word")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = chosen.repartition(parts).select("word", let(literal_ranks(ranks), lambda table: fold(F.col("word"), table)).alias("ids")).toArrow().combine_chunks()
    words = [w.encode("latin-1").decode() for w in folded.column(0).to_pylist()]
    lists = folded.column(1).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return {w: k for k, w in enumerate(words)}, lists.cast(pa.list_(pa.int32()))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, block_words: int = 1 << 18, block_places: int = 1 << 22, dictionary: int = 1 << 19, sample_rows: int = 1 << 14) -> DataFrame:
    """id and ids (array<int>) of every row. dictionary: the most words that are folded beforehand; 0 for none."""
    kind = docs.schema[id_col].dataType.simpleString()
    words, lists = _dictionary(docs.select(text_col), ranks, pattern, longest, dictionary, sample_rows)
    numbers = docs.sparkSession.sparkContext.broadcast(words)
    known = docs.sparkSession.sparkContext.broadcast(lists)
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary, for very long words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        block, id_kind = _Block(find, longest, numbers.value), None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):  # a part at a time is Python objects
                for row, text in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist(), strict=True):
                    if block.rows and (len(block.words) >= block_words or block.size + len(text or "") // 4 >= block_places):
                        yield block.batch(held.value, id_kind)
                        block = _Block(find, longest, numbers.value)
                    block.add(row, text)
        if block.rows:
            yield block.batch(held.value, id_kind)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, sizes, places, words, long_ids = (batch.column(c)[k] for c in range(5))
                own = np.frombuffer(places.as_py(), dtype="<i4")
                for part, ids in _ids_of(rows.values, sizes.values.to_numpy(), own, [known.value, words.values, long_ids.values], 1 << 18):
                    yield pa.RecordBatch.from_arrays([part, ids], [id_col, "ids"])

    blocks = docs.select(id_col, text_col).mapInArrow(common.tidy(cut), f"rows array<{kind}>, sizes array<int>, places binary, words array<string>, long_ids array<array<int>>")
    word_ids = let(literal_ranks(ranks), lambda table: F.transform("words", lambda w: fold(w, table)))  # one table, however often the fold names it
    folded = blocks.select("rows", "sizes", "places", word_ids.alias("word_ids"), "long_ids")
    return folded.mapInArrow(common.tidy(place), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """encoded with a binary column decoded beside its own: the pieces of the ids, concatenated. A null array gives null; an id without a piece fails.

    The pieces are a literal array of hexadecimal strings, addressed by id; no Python runs on the executors.
    """
    pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    hexed = F.transform(ids_col, lambda i: F.coalesce(table[i], F.raise_error(F.lit("an id has no piece")).cast("string")))
    return encoded.withColumn("decoded", F.unhex(F.array_join(hexed, "")))
