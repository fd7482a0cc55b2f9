"""Segment-tree BPE, alignment of tokenizers and phrases, each against a plain version or the library."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import align, common, phrases, queries, tree_bpe
from tests.llm.brute_tokens import brute
from tests.llm.test_operators import prose
from tests.test_catalog import DIR

DOCS = "doc_id long, text string"
ODD = [
    None, "", " ", "\n\t ", "one", " lead", "trail ", "a  b", "a\n\nb", "a \n b", "x▁y z", "<|endoftext|>a<|startoftext|> b", "<s> </s><unk><0x41>", "İstanbul ΣΑΣ Ωσς", "don't I'LL '''s 12 345", "日本語 と 漢字" * 30, "é̀ ́b Ａ ﬁ", "a\0b c\x1cd\x85e",
    "　x y", "😀😀 👍🏽", "word." * 500, "z" * 5000,
]


@functools.cache
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    mixed = ["".join(rng.choice("aAbB'st 1  \n\t<|endoftext|>éΣİ日本\x1c😀▁.,") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = list(enumerate(ODD + mixed + [prose(k, 200) for k in range(40)] + [prose(77, 20_000)]))
    return rows + [(5, "same id"), (5, "same id"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    common.ship(spark)
    return spark.createDataFrame(texts, DOCS).repartition(3).cache()


# --- 11 ----------------------------------------------------------------------------------------------------------------------


def expected_ids(text):
    ids = word_bpe().encode(text or "", add_special_tokens=False).ids
    return ids, word_bpe().decode(ids, skip_special_tokens=False)


def test_tree_matches_library(spark, docs, texts):
    path = queries.tokenizer_file("word_bpe_49k.json")
    got = tree_bpe.decode(tree_bpe.encode(docs, path, cached=2000), path).withColumn("listed", tree_bpe.listed(F.col("ids"))).collect()
    assert Counter((r.doc_id, tuple(r.listed), r.decoded) for r in got) == Counter((i, tuple(expected_ids(t)[0]), expected_ids(t)[1]) for i, t in texts)


def test_tree_step_by_step_and_together():
    """Many words in step, one word alone, and a plain search for the leftmost lowest rank agree; long words, too."""
    rng = random.Random(2)
    pairs, symbol = {}, 5
    for rank in range(60):
        pairs[rng.randrange(symbol), rng.randrange(symbol)] = (rank, symbol)
        symbol += 1

    def plain(word):
        word = list(word)
        while found := [(pairs[p][0], k) for k, p in enumerate(zip(word, word[1:], strict=False)) if p in pairs]:
            _, k = min(found)
            word[k : k + 2] = [pairs[word[k], word[k + 1]][1]]
        return word

    words = [[rng.randrange(5) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 17, 33]))] for _ in range(600)] + [[rng.randrange(5) for _ in range(700)], [0]]
    want = [plain(w) for w in words]
    assert [tree_bpe.merged(w, pairs) for w in words] == want
    together = tree_bpe.Pairs(pairs).words(np.array([s for w in words for s in w]), np.array([len(w) for w in words]))
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in together] == want


def test_tree_names_and_empty(spark):
    path = queries.tokenizer_file("word_bpe_49k.json")
    rows = spark.createDataFrame([("k", "a b", 1)], "ids string, text string, row int")
    out = tree_bpe.encode(rows, path, id_col="ids")
    assert out.columns == ["ids", "ids_"] and out.first()[0] == "k"
    clash = tree_bpe.encode(rows.withColumnRenamed("ids", "decoded"), path, id_col="decoded")
    assert tree_bpe.decode(clash, path, out_col="shown").first()["shown"] == "a</w> b</w>"
    assert tree_bpe.encode(rows.limit(0), path, id_col="row").count() == 0
    null = tree_bpe.encode(rows, path, id_col="row").withColumn("ids", F.lit(None).cast("binary"))
    assert tree_bpe.decode(null, path).first()["decoded"] is None


def test_op11_query(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall())
    got = queries.op11_tree_bpe(spark, DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        ids, text = expected_ids(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# --- 12 ----------------------------------------------------------------------------------------------------------------------

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def shown(rows):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else r.groups) for r in rows)


@pytest.mark.parametrize("limits", [{}, {"block_chunks": 50, "block_places": 100}])
def test_alignment(spark, docs, texts, limits):
    got = align.align(docs, *map(queries.tokenizer_file, FILES), **limits).collect()
    assert shown(got) == Counter((i, *rest) for i, rest in brute(texts))


def test_alignment_of_intervals():
    """Against every pair of intervals."""
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 30)
        a, b = (np.array(sorted({*rng.sample(range(1, n), rng.randint(0, n - 1)), n})) for _ in range(2))
        low, high, ends = align.overlaps(a, b)
        spans = [list(zip([0, *x.tolist()], x.tolist(), strict=False)) for x in (a, b)]
        assert [list(range(lo, hi)) for lo, hi in zip(low, high, strict=True)] == [[j for j, (s, e) in enumerate(spans[1]) if s < y and x < e] for x, y in spans[0]]
        assert set(b[ends].tolist()) == set(a.tolist()) & set(b.tolist())


def test_alignment_names_and_empty(spark):
    files = [queries.tokenizer_file(f) for f in FILES]
    rows = spark.createDataFrame([("x", "a b", 1, "g"), ("y", None, 2, "g")], "pair string, text string, block int, groups string")
    got = {r.pair: r for r in align.align(rows, *files, id_col="pair").collect()}
    assert got["x"].n_a > 0 and got["x"].groups.count("|") == got["x"].n_groups and tuple(got["y"])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert align.align(rows.limit(0), *files, id_col="pair").count() == 0
    assert {r.n_a for r in align.align(rows.where("text IS NULL"), *files, id_col="pair").collect()} == {0}


def test_op12_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    got = [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in queries.op12_align(spark, DIR).collect()]
    assert sorted(got) == sorted(brute(docs))


# --- 13 ----------------------------------------------------------------------------------------------------------------------


def plain_phrases(docs, most_words=4, least=30, first=2000, inside=80):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    out = {}
    candidates = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    longest = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, w[i : i + k]] = max(longest[lang, w[i : i + k]], a)
    for (lang, w), a in candidates.items():
        if 100 * longest[lang, w] >= inside * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank + 1, p.decode(), -a, l, r, n[lang], -score) for lang, rows in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:first]))


@pytest.fixture(scope="module")
def said():
    rng = random.Random(9)
    stock = ["new york city", "of the", "in the middle of", "ab cd", "a b a b a", "ÉTÉ là", "x\ty", "the the the the the", "日本 語"]
    words = ["alpha", "Beta", "gamma", "the", "of", "a", "é", " ", "it's", "-"]
    rows = [(" ".join(rng.choice(stock if rng.random() < 0.4 else words) + rng.choice(["", "", "", ",", ".\n", "  "]) for _ in range(150)), rng.choice(["en", "fr", None, "und"])) for _ in range(120)]
    return rows + [(None, "en"), ("", None), ("...", "de"), ("only once here", "de"), (rows[0][0] * 40, "en"), *[rows[1]] * 40]


@pytest.mark.parametrize("limits", [{}, {"block_words": 300, "max_bits": 1 << 16}, {"least": 3, "first": 25}])
def test_phrases(spark, said, limits):
    common.ship(spark)
    docs = spark.createDataFrame([(t, lang, "clash", 1) for t, lang in said], "text string, lang string, phrase string, n int").repartition(4)
    got = sorted(tuple(r) for r in phrases.mine(docs, **limits).collect())
    want = plain_phrases(said, **{k: v for k, v in limits.items() if k in ("least", "first")})
    assert want and got == want


def test_phrases_empty(spark):
    common.ship(spark)
    assert phrases.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_phrases_exact_beyond_64_bits(spark):
    """Counts whose products pass 64 bits; and equal scores go to the smaller cut."""
    big = 3_000_000_000_000_000_000
    level = lambda rows: spark.createDataFrame([("en", p, f) for p, f in rows], "lang string, phrase string, f long")
    found = [level([("a", big), ("b", big), ("c", big)]), level([("a b", big - 1), ("b c", big - 1)]), level([("a b c", big - 1)])]
    got = {r.phrase: r for r in phrases.scored(found, 2_000_000).collect()}
    want = 2_000_000 * (big - 1) // (2 * big)
    assert (got["a b"].score, got["a b"].l, got["a b"].r) == (want, big, big)
    assert (got["a b c"].l, got["a b c"].r) == (big, big - 1)
