"""Phrases that hang together: frequent word sequences found level by level (Apriori), each scored by its weakest cut.

1. Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Blocks of texts become rows: the distinct words of a block
   with their counts, and the places of all words among them, pieces apart. They are staged, so texts are read once.
2. Level 1 counts words. For level k the frequent (k-1)-grams are broadcast as a Bloom filter of at most ``max_bits`` bits, whatever their number; a
   position is counted only if both (k-1)-grams that overlap there are in it. A false positive costs a counted phrase, which its exact count then drops.
   Phrases are counted in a block by dense numbers made from the level before (exact, not hashed), and then over all blocks by an aggregation.
3. A candidate's cuts look up both parts in the level tables; the lowest score counts. What stands in a longer candidate that is nearly as frequent is dropped. The best
   of each language are ranked in two steps, first within slices of the phrases, so no language meets in one task.

Parts that many cuts share (a common word is the first part of many phrases) meet by a broadcast of at most 1000 of them, the others in a shuffle. All arithmetic is
in whole numbers, products as decimals of 38 digits.

Defined results: a null text is an empty one, a null language is ``und``, together with a language of that name. Repeated rows count as often as they occur. Ties go to the
smaller cut, and of phrases to the higher count and then the first in order of UTF-8 bytes. Very long texts are counted whole. An empty table gives an empty result.
Columns other than the text and the language are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm import common

#: Between pieces. What is left between words is spaces and tabs.
PIECES = re.compile("[.,;:!?\n\x0b\x0c\r]+")
GAP = "\n"
SEGMENT = 16
BITS_A_GRAM = 16
HASHES = 2
LANGUAGE = "und"


class _Places(dict):
    """Words in order of first sight; 0 is a gap between pieces, 1 nothing."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class _Block:
    def __init__(self):
        self.at = _Places({GAP: 0, "": 1})
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        lowered = text.encode().lower().decode()  # of bytes, only A-Z
        words = PIECES.sub(" \n ", lowered).replace("\t", " ").split(" ")
        found = np.fromiter(map(self.at.__getitem__, words), dtype=np.int32, count=len(words))
        found = found[found != 1]
        self.places += [found, np.zeros(1, dtype=np.int32)]
        self.size += len(found) + 1

    def row(self, language: str) -> dict:
        places = np.concatenate(self.places)
        words = list(self.at)
        return {"lang": language, "words": words[2:], "counts": np.bincount(places, minlength=len(words))[2:].tolist(), "places": places.astype(np.min_scalar_type(len(words))).tobytes()}


BLOCK = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("places", pa.binary())])


def blocks_of(docs: DataFrame, text_col: str, lang_col: str, block_words: int) -> DataFrame:
    """Staged blocks: lang, words, counts, places. A worker holds at most about block_words words at a time, in one block for each language that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Block] = {}
        size = 0

        def written() -> Iterator[pa.RecordBatch]:
            for language, block in held.items():
                yield pa.RecordBatch.from_pylist([block.row(language)], BLOCK)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for language, text in zip(*(batch.column(c).slice(at, 256).to_pylist() for c in (0, 1)), strict=True):
                    if not text:
                        continue
                    block = held.setdefault(language, _Block())
                    before = block.size
                    block.add(text)
                    size += block.size - before
                    if size >= block_words:
                        yield from written()
                        held, size = {}, 0
        yield from written()

    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(LANGUAGE)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return common.stage(own.mapInArrow(common.tidy(run), "lang string, words array<string>, counts array<long>, places binary"))


def word_hashes(words: list[str], language: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(language.encode())
    return np.fromiter((xxh64_intdigest(w.encode(), seed) for w in words), dtype=np.uint64, count=len(words))


def longer(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all but its last word and that of its last word."""
    x = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def bit_places(hashes: np.ndarray, log_bits: int) -> np.ndarray:
    """HASHES x n places in a filter."""
    step = hashes * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([((hashes + np.uint64(k) * step) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - log_bits) for k in range(1, HASHES + 1)]).astype(np.int64)


def filter_of(grams: DataFrame, number: int, max_bits: int) -> tuple[np.ndarray, int]:
    """grams: lang, phrase. A Bloom filter of them all (packed bits, the last of which stands alone so that none is empty) and the logarithm of its size."""
    log_bits = int(min(max(SEGMENT, np.ceil(np.log2(max(1, number * BITS_A_GRAM)))), np.floor(np.log2(max_bits))))
    log_bits = max(SEGMENT, log_bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [reduce(longer, (np.array([h]) for h in word_hashes(p.split(" "), lang)))[0] for lang, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            at = np.unique(bit_places(np.array(hashes, dtype=np.uint64), log_bits))
            parts = np.split(at, np.flatnonzero(np.diff(at >> SEGMENT)) + 1) if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(p[0] >> SEGMENT) for p in parts], pa.int64()), pa.array([(p & 0xFFFF).astype("<u2").tobytes() for p in parts], pa.binary())], ["segment", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << SEGMENT, dtype=bool)
        for value in table.column("bits"):
            own[np.frombuffer(value.as_py(), dtype="<u2")] = True
        return pa.table({"segment": pa.array([table.column("segment")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    marked = grams.mapInArrow(common.tidy(mark), "segment long, bits binary").groupBy("segment").applyInArrow(merge, "segment long, bits binary")
    bits = np.zeros(1 << log_bits - 3, dtype=np.uint8)
    step = 1 << SEGMENT - 3
    found = marked.toArrow()  # at most max_bits
    for segment, value in zip(found.column("segment").to_pylist(), found.column("bits").to_pylist(), strict=True):
        bits[segment * step : (segment + 1) * step] = np.frombuffer(value, dtype=np.uint8)
    return bits, log_bits


def has(bits: np.ndarray, log_bits: int, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for at in bit_places(hashes, log_bits):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def counted(words: list[str], places: np.ndarray, hashes: np.ndarray, size: int, bits: np.ndarray, log_bits: int) -> tuple[list[str], np.ndarray]:
    """The phrases of so many words of a block whose two overlapping shorter phrases the filter has, and how often each occurs.

    places: of words, from 1, with 0 between pieces; hashes: of the words.
    """
    own = np.concatenate([[np.uint64(0)], hashes])[places]
    n = len(places) - size + 1
    if n < 1:
        return [], np.zeros(0, dtype=np.int64)
    shorter = own[: n + 1]
    for k in range(1, size - 1):
        shorter = longer(shorter, own[k : n + 1 + k])
    whole = places[:n] > 0
    for k in range(1, size):
        whole &= places[k : n + k] > 0
    at = np.flatnonzero(whole)
    at = at[has(bits, log_bits, shorter[at])]
    at = at[has(bits, log_bits, shorter[at + 1])]
    number = places[at].astype(np.int64)
    for k in range(1, size):  # dense numbers of the phrases of k words, so the next product stays small
        _, number = np.unique(number * (len(words) + 1) + places[at + k], return_inverse=True)
    _, first, n_each = np.unique(number, return_index=True, return_counts=True)
    named = [words[i - 1] for k in range(size) for i in places[at[first] + k].tolist()]
    return list(map(" ".join, zip(*(named[k * len(first) : (k + 1) * len(first)] for k in range(size)), strict=True))), n_each


def grams_of(blocks: DataFrame, size: int, held) -> DataFrame:
    """lang, phrase, n: the phrases of a level, with their counts by block. held: broadcast filter of the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, log_bits = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                language, words = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                places = np.frombuffer(batch.column(2)[k].as_py(), dtype=np.min_scalar_type(len(words) + 2)).astype(np.int32)
                places = np.where(places > 0, places - 1, 0)  # words from 1
                phrases, n = counted(words, places, word_hashes(words, language), size, bits, log_bits)
                for at in range(0, len(phrases), 20_000):
                    part = phrases[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(n[at : at + 20_000], pa.int64())], ["lang", "phrase", "n"])

    return blocks.select("lang", "words", "places").mapInArrow(common.tidy(run), "lang string, phrase string, n long")


def levels(blocks: DataFrame, most_words: int, least: int, max_bits: int) -> list[DataFrame]:
    """For each number of words lang, phrase and f of the phrases with f >= least, staged."""
    context = blocks.sparkSession.sparkContext
    out = []
    for size in range(1, most_words + 1):
        if size == 1:
            raw = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
        else:
            held = context.broadcast(filter_of(out[-1].select("lang", "phrase"), out[-1].count(), max_bits))
            raw = grams_of(blocks, size, held)
        out.append(common.stage(raw.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)))
        if size > 1:
            held.unpersist()
    return out


def gram(lang: Column, phrase: Column) -> Column:
    """One key for a phrase of a language; no phrase holds a line feed."""
    return F.concat(lang, F.lit("\n"), phrase)


def scored(found: list[DataFrame], scale: int) -> DataFrame:
    """lang, phrase, size, a, l, r, score of every phrase of two words or more: its lowest-scoring cut. Staged."""
    union = reduce(DataFrame.unionByName, [t.withColumn("size", F.lit(k + 1)) for k, t in enumerate(found)])
    words = F.split("phrase", " ", -1)
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    cuts = union.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), cut)
    sides = cuts.withColumns({"left": gram(F.col("lang"), part(F.lit(1), F.col("cut"))), "right": gram(F.col("lang"), part(F.col("cut") + 1, F.col("size") - F.col("cut")))})
    known = union.where(F.col("size") < len(found)).select(gram(F.col("lang"), F.col("phrase")).alias("part"), "f")
    total = sides.count()
    for side, name in (("left", "l"), ("right", "r")):
        uses = sides.groupBy(F.col(side).alias("part")).agg(F.count("*").alias("uses"))
        facts = common.stage(known.join(uses, "part").select(F.col("part").alias(side), F.col("f").alias(name), "uses"))
        sides = common.attach(sides, facts, side, "uses", total).drop("uses", side)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    lowest = sides.withColumns({"product": F.lit(scale).cast("decimal(19,0)") * wide("a"), "sum": wide("l") + wide("r")}).withColumn("score", F.expr("product DIV sum"))
    best = lowest.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "size", "a", "l", "r")).alias("b"))
    return common.stage(best.select("lang", "phrase", "b.size", "b.a", "b.l", "b.r", "b.score"))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 4, least: int = 30, first: int = 2000, inside: int = 80, scale: int = 2_000_000, block_words: int = 1 << 20, max_bits: int = 1 << 28) -> DataFrame:
    """The first so many phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase has 2 to most_words words and a >= least occurrences; l and r are those of the parts of its weakest cut and score is scale * a / (l + r), rounded down.
    Phrases inside a longer one with inside per cent of their occurrences are dropped. n: words of the language. max_bits bounds each broadcast filter.
    """
    blocks = blocks_of(docs, text_col, lang_col, block_words)
    found = levels(blocks, most_words, least, max_bits)
    candidates = scored(found, scale)
    words = F.split("phrase", " ", -1)
    starts = lambda size: F.transform(F.sequence(F.lit(1), F.col("size") - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    held = candidates.where("size > 2").select("lang", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), starts))).alias("phrase"), "a")
    around = held.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    wide = lambda c, n: F.col(c).cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)")
    kept = candidates.join(around, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (wide("longest", 100) < wide("a", inside)))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "slice"], ["lang"]):
        sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= first)
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    return sliced.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
