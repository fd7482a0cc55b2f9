"""BPE with word ends: encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A word is a row of symbols; every place holds the rank of the pair that starts there. A segment tree over the places keeps the least (rank, place) of
each stretch, so its root is the leftmost pair of the lowest rank. That pair is merged, which changes three places: the merged one, the one before it and
the one that went; each is a point update in logarithmic time. When the root holds no rank the word is done. A word of n symbols takes O(n log n),
however long it is. New words of about the same length are merged in step, a merge in each at a time, with numpy.

What stands before the merges (added tokens, normalisation, the pattern, bytes as characters) is read from the tokenizer's file and done by the
tokenizers library's own parts, for each distinct chunk of a text once (a chunk of Latin letters, perhaps with a mark, needs only lower case). A space or a line feed always ends a word in such a tokenizer, so texts are cut
there first; ``Words`` checks that the file is one of this kind.

All is narrow: a partition is encoded where it is read, nothing is shuffled, broadcast or written, and a lost task is run again. A worker keeps the
ids of at most ``cached`` chunks and words.

Defined results: a null or empty text, and one of white space only, has no ids (an empty binary). Repeated rows each get their row; ties of rank are merged
from the left. Strings of added tokens in a text are those tokens, as in the library by default. Very long texts are encoded whole. An empty table gives
an empty result. Columns other than the id and the text are not read, so no name clashes; if the id column is called ids, the new one is ids_.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import chunks, common

NONE = 1 << 62


def merged(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols of one word after all merges. pairs: (left, right) -> (rank, symbol)."""
    n = len(symbols)
    if n < 2:
        return list(symbols)
    width = 1 << (n - 2).bit_length()  # leaves: one for each pair, at least one
    bits = width.bit_length()
    place = (1 << bits) - 1
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        found = pairs.get((symbols[i], symbols[i + 1]))
        if found:
            tree[width + i] = found[0] << bits | i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(at: int, value: int) -> None:
        k = width + at
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                return
            tree[k] = least

    own = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank = lambda i, j: found[0] << bits | i if (found := pairs.get((own[i], own[j]))) else NONE
    while (least := tree[1]) != NONE:
        i = least & place
        j = after[i]
        own[i] = pairs[own[i], own[j]][1]
        k = after[i] = after[j]
        own[j] = -1
        if j < n - 1:
            put(j, NONE)
        put(i, rank(i, k) if k < n else NONE)
        if k < n:
            before[k] = i
        if before[i] >= 0:
            put(before[i], rank(before[i], i))
    return [s for s in own if s >= 0]


class Pairs:
    """The merges as arrays, and many words merged in step: one tree a word, all of one width, every step a merge in each."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.rank, self.symbol = (np.append(np.array([v[k] for v in pairs.values()], dtype=np.int64)[order], -1) for k in (0, 1))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where the two do not merge) and symbols of pairs of symbols."""
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        known = self.keys[at] == wanted
        return np.where(known, self.rank[at], NONE), self.symbol[at]

    def merged(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: words x places, -1 after the end. The same with what went as -1, too."""
        n, places = symbols.shape
        width = 1 << max(0, (places - 2).bit_length())
        bits = width.bit_length()
        own = symbols.copy()
        every = np.arange(n)
        end = (symbols >= 0).sum(axis=1)
        after = np.tile(np.arange(1, places + 1), (n, 1))
        before = np.tile(np.arange(-1, places - 1), (n, 1))
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        ranks, _ = self.look_up(symbols[:, :-1], symbols[:, 1:])
        tree[:, width : width + places - 1] = np.where((symbols[:, 1:] >= 0) & (ranks != NONE), ranks << bits | np.arange(places - 1), NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(words: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
            k = width + at
            tree[words, k] = values
            for _ in range(bits - 1):
                k = k >> 1
                tree[words, k] = np.minimum(tree[words, 2 * k], tree[words, 2 * k + 1])

        def rank(words: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            found, _ = self.look_up(own[words, left], own[words, right])
            return np.where(found != NONE, found << bits | left, NONE)

        active = every[tree[:, 1] != NONE]
        while len(active):
            i = tree[active, 1] & ((1 << bits) - 1)
            j = after[active, i]
            _, own[active, i] = self.look_up(own[active, i], own[active, j])
            own[active, j] = -1
            k = after[active, i] = after[active, j]
            inner = k < end[active]
            put(active, np.minimum(j, width - 1), np.where(j < end[active] - 1, NONE, tree[active, width + np.minimum(j, width - 1)]))
            put(active[~inner], i[~inner], np.full((~inner).sum(), NONE))
            put(active[inner], i[inner], rank(active[inner], i[inner], k[inner]))
            before[active[inner], k[inner]] = i[inner]
            left = before[active, i]
            some = left >= 0
            put(active[some], left[some], rank(active[some], left[some], i[some]))
            active = active[tree[active, 1] != NONE]
        return own

    def words(self, symbols: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """symbols of words, one after the other. The ids of each, as little-endian unsigned 32-bit integers."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out: list[bytes] = [b""] * len(sizes)
        powers = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        for power in np.unique(powers):
            own = np.flatnonzero(powers == power)
            if len(own) < 16:  # the same tree, a word at a time
                for w in own:
                    out[w] = np.array(merged(symbols[starts[w] : starts[w + 1]].tolist(), self.pairs), dtype="<u4").tobytes()
                continue
            for part in np.array_split(own, -(-len(own) * 2**power // (1 << 20))):
                table = np.full((len(part), 2**power), -1, dtype=np.int64)
                filled = np.arange(2**power) < sizes[part][:, None]
                table[filled] = symbols[np.repeat(starts[part] - np.concatenate([[0], np.cumsum(sizes[part])[:-1]]), sizes[part]) + np.arange(sizes[part].sum())]
                done = self.merged(table)
                ends = np.cumsum((done >= 0).sum(axis=1)) * 4
                flat = done[done >= 0].astype("<u4").tobytes()
                for w, lo, hi in zip(part.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[w] = flat[lo:hi]
        return out


class Words:
    """Texts -> little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, cached: int = 500_000):
        chunks.os_environ_off()
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        model = read["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE model of ranked merges with word ends is needed")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or set(t["content"]) & {" ", "\n"} for t in read["added_tokens"]):
            raise ValueError("added tokens must stand for themselves")
        added = {t["content"]: t["id"] for t in read["added_tokens"]}
        vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.pairs = Pairs({(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)})
        shown = chunks.byte_alphabet()
        self.byte_of = {c: n for n, c in shown.items()}
        self.inner, self.last = (np.array([vocabulary[shown[n] + e] for n in range(256)], dtype=np.int64) for e in ("", end))
        tokenizer = Tokenizer.from_file(path)
        self.normal, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        if self._cut("a b\nc, É") != [b"a", b"b", b"c", b",", "é".encode()] or self._cut("ab, éb") != [b"ab", b",", "éb".encode()]:
            raise ValueError("a space and a line feed must end a word, and letters and marks be words apart in lower case")
        self.added = {content: array("I", [number]).tobytes() for content, number in added.items()}
        self.apart = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.known: dict[bytes, bytes] = {}  # words
        self.cache: dict[str, bytes] = {"": b""}  # chunks
        self.cached = cached

    def _cut(self, part: str) -> list[bytes]:
        """The words of a part of a text, as UTF-8."""
        return [bytes([self.byte_of[c] for c in w]) for w, _ in self.cut(self.normal(part))]

    def _split(self, chunk: str) -> list[bytes | str]:
        """The words of a chunk, and added tokens as they are."""
        lowered = chunk.lower()
        if max(lowered) < chunks.LATIN:  # below it, there is nothing to compose
            if lowered.isalpha():
                return [lowered.encode()]
            if lowered[:-1].isalpha() and lowered[-1] in ",.!?;:":
                return [lowered[:-1].encode(), lowered[-1].encode()]
        out: list[bytes | str] = []
        for part in self.apart.split(chunk) if self.apart else [chunk]:
            out += [part] if part in self.added else self._cut(part) if part else []
        return out

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        read = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[read]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[read[ends]]
        return dict(zip(words, self.pairs.words(symbols, sizes), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; words that are new are merged together."""
        parts = [text.replace("\n", " ").split(" ") if text else [] for text in texts]
        if len(self.cache) > self.cached:
            self.cache = {"": b""}
        if len(self.known) > self.cached:
            self.known = {}
        cache, known = self.cache, self.known
        fresh = {chunk: self._split(chunk) for chunk in set(chain.from_iterable(parts)).difference(cache)}
        known |= self._learn(list(set(chain.from_iterable(fresh.values())).difference(known, self.added)))
        for chunk, words in fresh.items():
            cache[chunk] = known[words[0]] if len(words) == 1 and words[0] in known else b"".join([known[w] if isinstance(w, bytes) else self.added[w] for w in words])
        out = [b"".join(map(cache.__getitem__, p)) for p in parts]
        for chunk in fresh:
            if len(chunk) > 200:
                del cache[chunk]
        return out


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", cached: int = 500_000) -> DataFrame:
    """id and ids of every row: ids as little-endian unsigned 32-bit integers, one after the other, in a binary (see ``listed``)."""
    name = "ids_" if id_col == "ids" else "ids"
    own = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Words(tokenizer, cached)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # a part at a time is Python objects
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(of(part.column(1).to_pylist()), pa.binary())], ["row", "ids"])

    return own.mapInArrow(common.tidy(run), f"row {own.schema['row'].dataType.simpleString()}, ids binary").toDF(id_col, name)


def listed(ids: Column) -> Column:
    """A binary of ids as array<bigint>."""
    byte = lambda i, k: F.conv(F.hex(ids.substr(i * 4 + 1 + k, F.lit(1))), 16, 10).cast("bigint") * (1 << 8 * k)
    many = F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1)
    return F.when(F.octet_length(ids) > 0, F.transform(many, lambda i: byte(i, 0) + byte(i, 1) + byte(i, 2) + byte(i, 3))).otherwise(F.array().cast("array<bigint>"))


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids beside its columns: tokens with a space between them, as the library does for a tokenizer without a decoder.

    Added tokens are shown. Null ids give null; an id that the tokenizer does not have fails.
    """
    own, names = common.numbered(encoded)
    at, columns = names.index(ids_col), [*own.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(tokenizer, encoding="utf-8") as file:
            read = json.load(file)
        if read["decoder"] is not None:
            raise ValueError("the tokenizer has a decoder of its own")
        tokens = {number: token for token, number in read["model"]["vocab"].items()} | {t["id"]: t["content"] for t in read["added_tokens"]}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [None if b is None else " ".join(map(tokens.__getitem__, np.frombuffer(b, dtype="<u4").tolist())) for b in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], columns)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(common.tidy(run), f"{schema}, decoded string").toDF(*names, out_col)
