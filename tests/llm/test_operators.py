"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import byte_bpe, chunks, common, exact_dedup, gray_index, language, licences, nearest, packing, preferences, queries, similar, simhash, suffixes, url_filter
from tests.llm import brute

DOCS = "doc_id long, text string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) + rng.choice(["", "", ",", ".\n"]) for _ in range(words))


@pytest.fixture(scope="module")
def texts():
    base = [prose(k, 120) for k in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0].replace(" ", "\t ")), (22, base[1].upper()), (23, None), (24, ""), (25, "  \n"), (26, "one"), (27, "one two"), (28, base[2] + " " + base[3]), (29, base[2] + " tail"), (30, prose(99, 6000)), (30, "same id"), (30, "same id")]
    return rows + [(40 + k, base[4]) for k in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    common.ship(spark)
    return spark.createDataFrame(texts, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 -----------------------------------------------------------------------------------------------------------------------


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def pack(df, size):
    import public_tokenizers

    return packing.pack(df, queries.tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=size, bucket_rows=7)


def test_packing(docs, texts):
    size = 128
    rows = pack(docs.withColumn("length", F.lit("x")), size).collect()
    want = []
    for doc, text in texts:
        ids = np.array([*ids_of(text), 2], dtype="<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), size)):
            want.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    assert len(sequences) <= 1.05 * -(-sum(r.length for r in rows) // size) + 1


def test_packing_empty(empty):
    assert pack(empty, 64).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(4, 1.5, 3000 if seed else 5).astype(int), 1, 256)
    histogram = np.bincount(lengths, minlength=257)
    planned = packing.plan(histogram, 256)
    used = np.zeros(257, dtype=int)
    for parts, n in planned:
        assert sum(parts) <= 256 and n > 0
        for x in parts:
            used[x] += n
    assert (used == histogram).all()
    assert sum(n for _, n in planned) <= sum(n for _, n in packing.best_fit(histogram, 256)) * 1.01 + 1


def test_chunk_encoder():
    import public_tokenizers

    encoder = chunks.Encoder(queries.tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "\n\n\n", "\t", "a", "Été", "'s", "'", "1", "½", "_", ".", ",", "漢", "😀", "\xa0", "\u2003", "\x1c", "don't", " x", "\r\n", "ǅ", "Ⅷ", "<|endoftext|>"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for text, got in zip(made, encoder(made), strict=True):
        assert list(np.frombuffer(got, "<u4")) == ids_of(text), repr(text)


def test_language_holds_the_words_of_a_part_of_a_batch_only():
    model = language.Model(["a", "b"], np.random.default_rng(0).normal(size=(language.BUCKETS, 2)), np.zeros(2), 1.0, 0.4)
    texts = [" ".join(f"word{chr(97 + (k + j) % 26)}" for j in range(300)) for k in range(3000)]
    predictor = language.Predictor(model)
    some = predictor(texts[:300])
    tracemalloc.start()
    whole = predictor(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6 and whole[0][:300] == some[0] and np.array_equal(whole[1][:300], some[1])


def test_language_trains_on_packed_counts_as_they_come():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(language.BUCKETS, 1000, replace=False)), rng.integers(1, 300 if k % 9 == 0 else 9, 1000), "ab"[k % 2]) for k in range(600)]
    packed = [language.packed(at, n) for at, n, _ in rows]
    assert sum(len(a) + len(n) for a, n in packed) < 3.4 * 1000 * len(rows)  # 8 bytes a bucket before
    narrow = [(*language.unpacked(*p), y) for p, (_, _, y) in zip(packed, rows, strict=True)]
    assert all(np.array_equal(x, y) for one, two in zip(narrow, rows, strict=True) for x, y in zip(one[:2], two[:2], strict=True))
    assert [len(x) for x in language.unpacked(*language.packed(*language.counted(None)))] == [0, 0]
    want = language.train(rows, epochs=1)
    tracemalloc.start()
    model = language.train(narrow, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9e6 and np.array_equal(model.sums, want.sums) and (model.scale, model.threshold) == (want.scale, want.threshold)


def test_attach_plans_no_broadcast_of_heavy_keys_where_there_are_none(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), "id")
    rows = rows.unionByName(spark.range(3000).select(F.lit(9).cast("long").alias("k"), "id"))
    facts = common.stage(rows.groupBy("k").agg(F.count("*").alias("n")))
    plain = common.attach(rows.where("k < 9"), facts.where("k < 5"), "k", "n", 8000, staged=True)
    heavy = common.attach(rows, facts, "k", "n", 8000, staged=True)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(plain).count("Join") == 1 and plan(heavy).count("Join") > 1
    for df, own, known in ((plain, rows.where("k < 9"), "k < 5"), (heavy, rows, "true")):
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, own.join(facts.where(known), "k", "left").collect()), key=str)


def test_encoder_works_out_what_is_asked_for_again_only_once():
    import public_tokenizers

    encoder = chunks.Encoder(queries.tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN, 70)
    asked, model = Counter(), encoder.model

    class Counting:
        def tokenize(self, word):
            asked[word] += 1
            return model.tokenize(word)

    encoder.model = Counting()
    name = lambda k: "w" + "".join(chr(97 + int(d)) for d in str(k))
    often = [name(k) for k in range(30)]
    encoder(["x " + " ".join(name(1000 + k) for k in range(60))])
    for round_ in range(10):
        encoder(["x " + " ".join(often + [name(2000 + 30 * round_ + k) for k in range(30)])])
    assert [asked[chr(0x120) + w] for w in often] == [1] * 30


# --- 2 -----------------------------------------------------------------------------------------------------------------------


def test_exact_duplicates(docs, texts):
    groups: dict[str, list] = {}
    for doc, text in texts:
        groups.setdefault(brute.normalised(text), []).append(doc)
    for options in ({}, {"max_bits": 512}):  # the second cuts the hash space into slices
        rows = exact_dedup.duplicates(docs, **options).collect()
        assert sorted((r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in rows) == sorted((d, h, min(g), len(g)) for h, g in groups.items() for d in g)
        kept = [r for r in rows if r.kept]
        assert sorted(r.text_sha256 for r in kept) == sorted(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_columns(docs, texts, empty):
    wide = docs.withColumns({"kept": F.lit("mine"), "text_sha256": F.lit(7)})
    got = exact_dedup.dedup(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert len(rows) == len({brute.normalised(t) for _, t in texts}) and {r.kept for r in rows} == {"mine"}
    assert exact_dedup.dedup(empty).collect() == exact_dedup.duplicates(empty).collect() == []


# --- 3 -----------------------------------------------------------------------------------------------------------------------

TURNS = "pair_id long, turn long, role string, text string"


def test_preferences(spark):
    start = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi?")]
    chosen = spark.createDataFrame([*start, (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (2, None, None, None), (3, 0, "user", "same"), (4, 0, "user", "only chosen"), (None, 0, "user", "lost")], TURNS)
    rejected = spark.createDataFrame([*start, (1, 2, "assistant", "What."), (1, 3, "user", "Rude."), (2, None, "", ""), (3, 0, "user", "same")], TURNS)
    got = {r.pair_id: r for r in preferences.format_pairs(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert one.prompt == "<|system|>\nBe brief.<|end|>\n<|user|>\nHi?<|end|>\n" and one.prompt_turns == 2
    assert one.chosen == "<|assistant|>\nHello.<|end|>\n" and [one.chosen[m.start : m.end] for m in one.chosen_mask] == ["Hello.<|end|>"]
    assert [one.rejected[m.start : m.end] for m in one.rejected_mask] == ["What.<|end|>"] and one.rejected.endswith("<|user|>\nRude.<|end|>\n")
    assert (got[2].prompt, got[2].chosen, got[3].chosen, got[3].rejected) == ("<||>\n<|end|>\n", "", "", "")
    assert got[4].prompt == "" and got[4].rejected == "" and got[4].chosen_mask == []
    none = spark.createDataFrame([], TURNS)
    assert preferences.format_pairs(none, none).collect() == []


def test_preferences_in_blocks(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(10)]
    other = [*turns[:7], (1, 7, "assistant", "else")]
    rows = sorted(preferences.format_pairs(spark.createDataFrame(turns, TURNS), spark.createDataFrame(other, TURNS), block_turns=4).collect(), key=lambda r: r.block)
    whole = preferences.format_pairs(spark.createDataFrame(turns, TURNS), spark.createDataFrame(other, TURNS)).first()
    for column in ("prompt", "chosen", "rejected"):
        assert "".join(r[column] for r in rows) == whole[column]
    assert len(rows) == 3


# --- 4 -----------------------------------------------------------------------------------------------------------------------


def test_simhash(docs, texts, empty):
    rows = simhash.near_duplicates(docs).collect()
    prints = {k: brute.simhash(t) for k, (_, t) in enumerate(texts)}
    assert sorted((r.doc_id, r.fingerprint) for r in rows) == sorted((texts[k][0], f"{p:016x}") for k, p in prints.items())
    by_id: dict[int, int] = {}
    for k, root in brute.components(prints).items():
        by_id.setdefault(root, min(texts[j][0] for j, r in brute.components(prints).items() if r == root))
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted((texts[k][0], by_id[root]) for k, root in brute.components(prints).items())
    assert simhash.near_duplicates(empty).collect() == []


def test_links_of_a_crowd(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    df = common.stage(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long"))
    want = brute.components({v: v for v in values})
    for options in ({}, {"cell_rows": 20, "per_cell": 16}):  # the second takes cells apart, again and again
        parent = {v: v for v in values}

        def find(a, parent=parent):
            while parent[a] != a:
                a = parent[a]
            return a

        edges = simhash.links(df, 2, **options).collect()
        for r in edges:
            a, b = (x % (1 << 64) for x in (r.a, r.b))
            assert (a ^ b).bit_count() <= 2
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        assert {v: find(v) for v in values} == want


def test_gray_index():
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 63, 400, dtype=np.uint64), np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 63, 60, dtype=np.uint64))]))
    found = {(int(a), int(b)) for q, m in gray_index.GrayIndex(values).search(values, 3) for a, b in zip(q, m, strict=True)}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if np.bitwise_count(values[i] ^ values[j]) <= 3}
    assert list(gray_index.GrayIndex(values[:0]).search(values, 2)) == []
    assert [int(x) for x in gray_index.gray_rank(np.array([0, 1, 3, 2, 6, 7], dtype=np.uint64))] == [0, 1, 2, 3, 4, 5]


def test_similar(spark, empty):
    base = prose(7, 400).split(" ")
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (10, 100, 200, 300)]
    rows = [(10, " ".join(base)), *((20 + k, t) for k, t in enumerate(near)), (5, prose(8, 400)), (6, None), (7, ""), (8, "a b"), (8, "a c d e f g h"), (9, near[0])]
    got = sorted((r.doc_id, r.text) for r in similar.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert [d for d, _ in got][:3] == [5, 6, 8] and len(got) == 5 and len([d for d, _ in got if d in (9, 10, 20, 21, 22, 23)]) == 1
    assert similar.keep_one(empty).collect() == []


def with_jaccard(seed, similarity, union=180):
    """Two texts of equally large sets of five-word shingles; how similar the sets are."""
    words = [f"w{seed}x{k}" for k in range(union)]
    n = round((1 - similarity) / (1 + similarity) * (union - 4))
    return " ".join(words), " ".join(words[:-n] + [f"v{seed}x{k}" for k in range(n)]), (union - 4 - n) / (union - 4 + n)


def test_similar_decides_by_the_sets(spark):
    cases = {0.75: False, 0.79: False, 0.805: True, 0.85: True}
    pairs = [(similarity, *with_jaccard(f"{similarity}k{k}", similarity)) for similarity in cases for k in range(60)]
    assert all((exact >= 0.8) == cases[similarity] for similarity, _, _, exact in pairs)
    rows = [(2 * k + side, pair[1 + side]) for k, pair in enumerate(pairs) for side in (0, 1)]
    root = {r._row: r.root for r in similar.groups(spark.createDataFrame(rows, "_row long, text string"), "_row", "text", per_cell=1 << 7).collect()}
    linked = {similarity: sum(root[2 * k + 1] == 2 * k for k, pair in enumerate(pairs) if pair[0] == similarity) for similarity in cases}
    assert linked == {similarity: 60 * yes for similarity, yes in cases.items()}


def candidates(values, labels, prints, every):
    """Of one cell of members, in one task; the most memory that it took in MB."""
    n = len(values)
    columns = [pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(values), pa.array(np.arange(n)), pa.array(labels), pa.array([p.tobytes() for p in prints], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["cell", "role", "value", "key", "label", "print"])
    tracemalloc.start()
    got = [(a, b) for out in similar._candidates(similar.most_bits(0.8), every)(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return got, peak


def test_similar_with_many_of_one_slice_value():
    n, rng = 4000, np.random.default_rng(3)
    flips = rng.integers(0, 504, (n, 20))
    bits = np.zeros((n, 512), dtype=np.uint8)
    bits[np.arange(n)[:, None], flips] = 1
    prints = np.packbits(bits, axis=1).view(np.uint64)
    one = np.zeros(n, dtype=np.int64)
    got, peak = candidates(one, np.arange(n), prints, False)
    assert {a for a, _ in got} == set(range(n)) and len(got) <= 4 * n and peak < 100
    got, peak = candidates(one, np.where(np.arange(n) < n - 3, 0, np.arange(n)), prints, True)
    assert len(got) == len(set(got)) == 3 * (n - 3) + 3 and peak < 100
    apart = rng.integers(0, 1 << 63, (60, 8), dtype=np.uint64)  # none near another, but for copies of one that differ in a bit
    apart[1::2] = apart[::2] ^ np.uint64(1)
    for every in (False, True):
        got, _ = candidates(one[:60], np.arange(60), apart, every)
        assert {(min(p), max(p)) for p in got} == {(k, k + 1) for k in range(0, 60, 2)}


def test_candidates_of_near_copies_grow_with_their_number():
    """However many slice values near copies have, and however often each is met, it is with its smallest and its nearest once a cell."""
    rng = np.random.default_rng(6)
    rows = []
    for n in (1000, 4000):
        bits = np.zeros((n, 512), dtype=np.uint8)
        bits[np.arange(n)[:, None], rng.integers(0, 504, (n, 12))] = 1
        values = (1 << rng.integers(0, 24, (n, 2))).sum(axis=1) * rng.integers(0, 2, n)
        got, _ = candidates(values, np.arange(n), np.packbits(bits, axis=1).view(np.uint64), False)
        often = Counter(a for a, _ in got)
        assert set(often) == set(range(n)) and max(often.values()) <= 2 and len(got) == len(set(got))
        rows.append(len(got))
    assert rows[1] <= 4.5 * rows[0]


def test_similar_looks_up_each_candidate_once(spark, monkeypatch):
    """Near copies are candidates in most of the 21 slices; only rows that differ go on, and no more than two of each document are compared at first."""
    base = prose(9, 400).split(" ")
    rows = [(k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(0, 400, 4)]
    sizes, confirmed = [], similar._confirmed

    def watched(pairs, sets, similarity):
        sizes.append(pairs.count())
        return confirmed(pairs, sets, similarity)

    released, release = [], common.release
    monkeypatch.setattr(similar, "_confirmed", watched)
    monkeypatch.setattr(common, "release", lambda df: (df.columns == ["a", "b", "d"] and released.append((df.count(), df.distinct().count()))) or release(df))
    got = similar.groups(spark.createDataFrame(rows, "_row long, text string"), "_row", "text").collect()
    assert {r.root for r in got} == {0} and sizes[0] <= 2 * len(rows)
    (found, distinct), = released
    assert distinct < found <= 21 * 2 * len(rows)


def test_sizes_and_bitmaps_rule_out_no_similar_pair():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 40, 150, 900, 6000):
        for share in (0.0, 0.3, 0.6, 0.8, 0.85, 0.888, 0.889, 0.9, 1.0):
            pool = rng.integers(0, 1 << 63, 3 * n + 2, dtype=np.uint64)
            x, y = np.unique(pool[:n]), np.unique(np.concatenate([pool[: round(share * n)], pool[n : n + rng.integers(0, n - round(share * n) + 2)]]))
            both = len(np.intersect1d(x, y))
            close = both >= 0.8 * (len(x) + len(y) - both) - 1e-9
            bounds = [similar.size_and_bitmap(h)[None, :] for h in (x, y)]
            ways = [similar.may_reach(0.8, *pair)[0] for pair in (bounds, bounds[::-1])]
            assert ways[0] == ways[1] and (ways[0] or not close)
            assert share > 0.7 or n not in (40, 150, 900) or not ways[0]


def test_near_misses_leave_no_rows():
    n, rng = 600, np.random.default_rng(4)
    flips = rng.integers(0, 504, (n, 20))
    bits = np.zeros((n, 512), dtype=np.uint8)
    bits[np.arange(n)[:, None], flips] = 1
    shared = rng.integers(0, 1 << 63, 140, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(shared)[:112], rng.integers(0, 1 << 63, 28, dtype=np.uint64)])) for _ in range(n)]
    sets[1] = np.append(sets[0][1:], np.uint64(7))
    prints = np.hstack([np.packbits(bits, axis=1).view(np.uint64), np.stack([similar.size_and_bitmap(h) for h in sets])])
    columns = [pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array([p.tobytes() for p in prints], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["cell", "role", "value", "key", "label", "print"])
    got = [(a, b) for out in similar._candidates(similar.most_bits(0.8), True, 0.8)(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    assert [tuple(sorted(p)) for p in got] == [(0, 1)]


def test_similar_against_all_pairs_of_a_table(spark):
    """Groups of every text of the table, from the exact similarity of all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    holders, sizes, root = {}, {}, {}
    for r in docs.orderBy("doc_id").collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if w]
        own = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {()}
        sizes[r.doc_id], root[r.doc_id] = len(own), r.doc_id
        for shingle in own:
            holders.setdefault(shingle, []).append(r.doc_id)
    common_ = Counter(pair for ids in holders.values() for pair in itertools.combinations(ids, 2))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), both in common_.items():
        if both >= 0.8 * (sizes[a] + sizes[b] - both) - 1e-9:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.doc_id: r.root for r in similar.groups(docs, "doc_id", "text").collect()}
    assert got == {k: find(k) for k in root} and len(set(got.values())) < len(got)


# --- 5 -----------------------------------------------------------------------------------------------------------------------


def test_licences(spark, empty):
    mit = licences.TEMPLATES["mit"][1]
    rows = [(1, "Some prose.\nReleased under the  MIT license!\nMore."), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "nothing here"), (6, "before\n\n" + mit.replace(", ", ",\n") + "\n\nafter"), (6, "word " * 5000), (7, "Released under the MIT License.\nLicensed under CC BY 4.0.")]
    got = {}
    for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, []).append((r.licence, r.score, r.n_units))
    assert got[1] == [("mit", 1.0, 1)] and got[2] == [("cc-by-nc-4.0", 1.0, 1)] and got[3] == got[4] == got[5] == [(None, None, 0)]
    assert sorted(x[0] or "" for x in got[6]) == ["", "mit"] and got[7] == [("cc-by-4.0", 1.0, 2)]
    assert licences.scan(empty).collect() == []


# --- 6 -----------------------------------------------------------------------------------------------------------------------


def test_language(spark):
    common.ship(spark)
    rng = random.Random(2)
    words = {"xx": ["the", "and", "thing", "with"], "yy": ["der", "und", "nicht", "für"], "zz": ["les", "une", "très", "dans"]}
    rows = [(k, " ".join(rng.choice(words[y]) for _ in range(rng.randint(3, 30))), y) for k in range(400) for y in [rng.choice(sorted(words))]]
    rows += [(1001, None, "xx"), (1002, "123 !!", "xx"), (1003, "the and thing", None), (1004, "und", None)]
    df = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("score", F.lit("mine"))
    model = language.fit(df)
    got = {r.doc_id: r for r in language.predict(df, model).withColumn("held", language.held_out(F.col("doc_id"))).collect()}
    held = [r for r in got.values() if r.held and r.doc_id < 1000]
    assert len(held) > 80 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert got[1001].lang_pred == got[1002].lang_pred == "und" and got[1001].rejected and got[1003].lang_pred == "xx" and got[1004].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language.predict(df, language.fit(df.where("lang = 'no'"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]


# --- 7 -----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken"))
    return ranks, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_folds_shared_words_once(spark, bpe):
    import regex

    ranks, pattern, own = bpe
    common.ship(spark)
    rows = [(k, f"the thing élan日本 {prose(k, 60)} only{chr(97 + k % 26)}{chr(97 + k // 26)}x " + "z" * 1100) for k in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    numbers, lists = byte_bpe._dictionary(df.select("text"), ranks, pattern, 1024, 1 << 19, 100)
    assert " thing" in numbers and " onlyaax" not in numbers and " " + "z" * 1100 not in numbers
    assert [lists[k].as_py() for k in numbers.values()] == [own._encode_single_piece(w.encode()) for w in numbers]
    block = byte_bpe._Block(regex.compile(pattern).findall, 1024, numbers)
    for row, text in rows:
        block.add(row, text)
    often = Counter(w for _, t in rows for w in regex.findall(pattern, t or ""))
    assert set(block.words) == {w for w, n in often.items() if n == 1}  # only these are folded again, in each block
    few = byte_bpe._dictionary(df.select("text"), ranks, pattern, 1024, 5, 20)[0]
    assert len(few) == 5 and byte_bpe._dictionary(df.select("text"), ranks, pattern, 1024, 0, 20)[0] == {}
    want = {i: own.encode_ordinary(t or "") for i, t in rows}
    for options in ({}, {"dictionary": 5, "block_words": 10}, {"dictionary": 0}, {"sample_rows": 5}):
        assert {r.doc_id: list(r.ids) for r in byte_bpe.encode(df, ranks, pattern, **options).collect()} == want


def test_byte_bpe_takes_chunks_over_that_are_asked_for_again(bpe):
    import regex

    ranks, pattern, own = bpe
    block, worked = byte_bpe._Block(regex.compile(pattern).findall, 1024, {" often": 0}), Counter()
    block.known.most, work = 40, block.known.work
    block.known.work = lambda chunk: worked.update([chunk]) or work(chunk)
    texts = [f"Often often again, x{k}y élan{chr(97 + k % 26)}{chr(97 + k // 26)}! 日本{k} don't\nafter, now {k}." for k in range(300)]
    for k, text in enumerate([*texts, "", None, " odd  text", "\n", "often"]):
        block.add(k, text)
    assert {worked[w] for w in (" often", " again,", " again", " don't", "\nafter,", " now")} == {1} and len(worked) > 900
    words = {0: " often"} | {k: w for w, k in block.words.items()}
    got = [[words[k] for k in np.frombuffer(p, dtype="<i4").tolist()] for p in block.places]
    assert got == [regex.findall(pattern, t or "") for t in [*texts, "", None, " odd  text", "\n", "often"]]
    assert block.batch(ranks, pa.int64()).num_rows == 1 and block.known is None


def test_byte_bpe(spark, docs, texts, bpe, empty):
    ranks, pattern, own = bpe
    odd = [(200, "漢字かな 😀😀 naïve\u00a0\u2003x  \n\n\n y\t<|endoftext|>"), (201, "a" * 3000), (202, "\x00\x01 \x1c"), (203, " ")]
    df = docs.unionByName(spark.createDataFrame(odd, DOCS))
    for options in ({}, {"block_words": 7, "block_places": 20}, {"longest": 4}):  # large and small blocks; nearly all words by the heap
        rows = byte_bpe.decode(byte_bpe.encode(df, ranks, pattern, **options), ranks).collect()
        assert sorted((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == sorted((d, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for d, t in texts + odd)
    assert byte_bpe.encode(empty, ranks, pattern).collect() == []
    clash = df.selectExpr("doc_id AS words", "text", "1 AS rows", "2 AS ids", "3 AS places")
    assert byte_bpe.encode(clash, ranks, pattern, id_col="words").columns == ["words", "ids"]
    assert byte_bpe.encode(clash, ranks, pattern, id_col="words").count() == df.count()


def test_fold(spark, bpe):
    ranks, _, own = bpe
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst thX1é漢") for _ in range(rng.randint(1, 30))).strip() or "a" for _ in range(300)] + ["", "a" * 200]
    df = spark.createDataFrame([(w.encode().decode("latin-1"),) for w in words], "word string").coalesce(1)
    got = [r[0] for r in df.select(byte_bpe.fold(F.col("word"), byte_bpe.literal_ranks(ranks))).collect()]
    assert got == [own._encode_single_piece(w.encode()) if w else [] for w in words]
    for word in words[:-2]:
        assert byte_bpe.fold_long(word.encode(), ranks) == own._encode_single_piece(word.encode())


# --- 8 -----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"group_places": 1}])
def test_suffix_dedup(docs, texts, options):
    rows = suffixes.remove_repeats(docs.withColumn("kept", F.lit(1)), length=60, gram=20, **options).collect()
    raw = [(t or "").encode() for _, t in texts]
    want = sorted((d, len(t), int(g.sum()), brute.runs(g), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()) for (d, _), t, g in zip(texts, raw, brute.removed(raw, 60), strict=True))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows) == want


def test_suffix_dedup_of_runs_and_boundaries(spark, empty):
    passage = prose(50, 30)
    rows = [(k, f"{prose(60 + k, 40)} {passage[: 150 + k]}{prose(90 + k, 20)}") for k in range(25)] + [(100, "ab" * 300), (101, "x" * 500), (102, "é" * 100)]
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(spark.createDataFrame(rows, DOCS), length=80, gram=24).collect()}
    raw = [t.encode() for _, t in rows]
    for (d, _), t, g in zip(rows, raw, brute.removed(raw, 80), strict=True):
        assert got[d] == (int(g.sum()), np.frombuffer(t, np.uint8)[~g].tobytes())
    assert suffixes.remove_repeats(empty).collect() == []


def test_places_of_long_texts():
    rng = random.Random(6)
    small, large = suffixes.Sampler(40, 8, most=150), suffixes.Sampler(40, 8)
    for _ in range(60):
        text = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 900)))
        for sampler in (small, large):
            _, _, first, windows, offset = sampler(text)
            assert windows.sum() == max(0, len(text) - 39)
            assert (np.concatenate([f + np.arange(w) for f, w in zip(first, windows, strict=True)] or [[]]) == np.arange(windows.sum())).all()
            assert (offset >= windows - 1).all() and (offset < 33 + windows).all()


def test_sorting():
    rng = random.Random(7)
    for _ in range(40):
        made = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(60)})
        rng.shuffle(made)
        groups = suffixes.shallow_sort(made, list(range(len(made))), 0, 16)
        order = [i for g in groups for i in (suffixes.blind_trie(made, g)[0] if len(g) > 1 else g)]
        assert [made[i] for i in order] == sorted(made)


# --- 9 -----------------------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    common.ship(spark)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 16)) * 4
    points = [(k, [float(x) for x in centres[k % 5] + rng.standard_normal(16)]) for k in range(600)]
    points += [(1000 + k, points[7][1]) for k in range(40)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, [float("inf")] * 16), (2100, [1.0, 2.0])]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    rows = nearest.search(df, df.where("vec_id % 20 = 0 OR vec_id = 7"), k=10, block_rows=150, query_rows=20).collect()
    vectors = {i: np.array(v) for i, v in points if i < 2000}
    hit = total = 0
    for q in {r.query_id for r in rows}:
        want = sorted((float(np.linalg.norm(vectors[i] - vectors[q])), i) for i in vectors if i != q)[:10]
        got = [(r.score, r.vec_id) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q]
        assert got == sorted(got) and len(got) == 10
        assert all(abs(s - np.linalg.norm(vectors[i] - vectors[q])) < 1e-12 for s, i in got)
        hit += len({i for _, i in want} & {i for _, i in got})
        total += 10
    assert hit >= 0.9 * total and {r.query_id for r in rows} == {i for i in vectors if i % 20 == 0 or i == 7}
    assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 7] == list(range(1000, 1010))
    assert nearest.search(df.limit(0), df.limit(0)).collect() == []
    few = nearest.search(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert len(few) == 3


def test_chi_square():
    assert abs(nearest.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3 and abs(nearest.chi_square_quantile(0.5, 2) - 1.38629) < 1e-4


def test_nearest_of_vectors_without_structure_takes_few_rounds_and_is_exact():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(6000, 64))
    block = nearest.Block(vectors, [np.array([i]) for i in range(len(vectors))], 10)
    query = rng.normal(size=64)
    got = list(block.tree.increments(query @ block.axes, lambda lo, hi: np.arange(lo, hi)))
    far, places, opened = (np.concatenate(x) for x in zip(*got, strict=True))
    assert len(got) <= 7 and (np.diff(far) >= 0).all() and (places == opened).all() and sorted(places.tolist()) == list(range(6000))
    for own, q in ((-1, query), (17, vectors[17]), (-1, query * 1e170)):
        exact = sorted((float(d), i) for i, d in enumerate(np.sqrt(np.einsum("ij,ij->i", vectors - q, vectors - q))) if i != own)[:10]
        assert block.top(q, own, 10, np.inf) == ([d for d, _ in exact], [i for _, i in exact])


# --- 10 ----------------------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/sec", "block"), ("example.com", "/de/", "block"), ("org", "", "block"), ("a.org", "/x", "allow"), ("", "/", "block"), (None, "/", "block")]
    urls = ["http://www.Example.NET/en/a?x#y", "http://example.net/en/secret", "https://net/", "http://net", "http://a.net?x", "http://xnet/", "http://b.example.com/de/1/2", "http://example.com/de", "ftp://u@a.org/x/y://z", "http://deep.a.org/xy", "http://a.b.c.org#q", "example.net/en/", None, "", "://", "http:///p", "http://a\nb.net/\n", "http://example.net/" + "d/" * 500]
    rows = [(k, u) for k, u in enumerate(urls)] + [(0, urls[0]), (0, urls[2]), (None, urls[0])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("mine"), "verdict": F.lit(0)})
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    real = [r for r in rules if r[0]]
    for options in ({}, {"broadcast_rules": 0}):
        got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, table, **options).collect()]
        assert sorted(got, key=repr) == sorted([(p, *brute.url_verdict(u, real)) for p, u in rows], key=repr)
    none = url_filter.filter_urls(df, table.limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), table).collect() == []
