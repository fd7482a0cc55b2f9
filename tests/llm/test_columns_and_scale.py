"""Columns with the names that operators use, hubs, slices, and the queries on a driver table against plain versions."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import byte_bpe, common, exact_dedup, graph, language, licences, packing, preferences, queries, simhash, similar, suffixes
from tests.llm import brute
from tests.llm.test_operators import prose
from tests.test_catalog import DIR

NAMES = ["_h", "_row", "_maybe", "_first", "_hot", "doc", "_doc", "_runs", "row", "runs", "c0", "n", "key", "kept", "n_bytes", "n_removed", "n_spans", "lang_pred", "score", "rejected", "_p", "p", "ids", "keep_id", "group_size", "text_sha256", "_text", "root", "a b"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, None), (4, ""), (5, prose(1, 40)), (6, prose(2, 40) + prose(1, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return common.ship(spark) and df.select("*", *[F.concat(F.lit(f"{name} "), "doc_id").alias(name) for name in NAMES])


def own_values(rows, names):
    return all(r[name] == f"{name} {r['doc_id']}" for r in rows for name in names)


def test_dedup_keeps_any_column(clashing):
    for options in ({}, {"max_bits": 64}):
        got = exact_dedup.dedup(clashing, **options)
        rows = got.collect()
        assert got.columns == clashing.columns and own_values(rows, NAMES)
        assert sorted(r.doc_id for r in rows) == [1, 3, 5, 6]


def test_keep_one_keeps_any_column(clashing):
    got = similar.keep_one(clashing)
    rows = got.collect()
    assert got.columns == clashing.columns and own_values(rows, NAMES) and sorted(r.doc_id for r in rows) == [1, 3, 5, 6]


def test_remove_repeats_keeps_any_column(clashing):
    replaced = {"kept", "n_bytes", "n_removed", "n_spans"}
    got = suffixes.remove_repeats(clashing, length=60, gram=20)
    rows = got.collect()
    assert own_values(rows, [n for n in NAMES if n not in replaced]) and {r.doc_id: r.n_removed > 0 for r in rows} == {1: False, 2: False, 3: False, 4: False, 5: True, 6: True}


def test_predict_keeps_any_column(clashing):
    model = language.train([(np.array([1]), np.array([1]), "aa"), (np.array([2]), np.array([1]), "bb")])
    rows = language.predict(clashing, model).collect()
    assert len(rows) == 6 and own_values(rows, [n for n in NAMES if n not in ("lang_pred", "score", "rejected")]) and {r.lang_pred for r in rows if not r.text} == {"und"}


def test_others_take_any_column(spark, clashing):
    assert simhash.near_duplicates(clashing).count() == licences.scan(clashing).count() == 6
    import public_tokenizers

    ranks = byte_bpe.read_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken"))
    assert byte_bpe.encode(clashing, ranks, public_tokenizers.PATTERN).count() == 6
    assert {r.doc_id for r in packing.pack(clashing, queries.tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()} == {1, 2, 3, 4, 5, 6}
    side = clashing.selectExpr("doc_id AS pair_id", "doc_id AS turn", "'user' AS role", "*")
    assert preferences.format_pairs(side, side).count() == 6


def test_a_hub_is_one_component(spark):
    edges = [(0, k) for k in range(1, 6000)] + [(9000, 9001), (5, 9001), (20000, 20001), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(6000), 9000, 9001], 0), 20000: 20000, 20001: 20000}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shared_dir_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_long_pairs_and_sparse_turns(spark):
    sparse = [(1, t, "user", "x") for t in (0, 600)]
    long = [(2, t, "user", f"m{t}") for t in range(700)]
    other = [(1, 0, "user", "x"), (1, 600, "user", "y")] + [r if r[1] < 650 else (*r[:3], "z") for r in long]
    frame = lambda rows: spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")
    rows = preferences.format_pairs(frame(sparse + long), frame(other)).orderBy("pair_id", "block").collect()
    assert [(r.pair_id, r.block, r.prompt_turns) for r in rows] == [(1, 0, 1), (2, 0, 512), (2, 1, 138)]
    assert rows[0].prompt.count("x") == 1 and "y" in rows[0].rejected and rows[2].rejected.count("z") == 50


def test_whole_licences(spark):
    mit = [t for t in licences.TEMPLATES["mit"] if t.startswith("Permission")][-1]
    rows = [(1, "Copyright 2020 Somebody\n\n" + mit.replace(" to deal ", "\nto deal ")), (2, licences.TEMPLATES["isc"][-1]), (3, prose(3, 200)), (4, "word " * 200_000)]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "isc", 3: None, 4: None}


def test_language_as_said(spark):
    """Scores recomputed plainly: the mean of the sums of all subwords' buckets, biases, a scaled softmax."""
    model = language.train([(np.array([k % 40, 40 + k % 7]), np.array([1, 2]), "ab"[k % 2] * 2) for k in range(300)])
    texts = [(1, prose(1, 30)), (2, "Éa, b2c d_e"), (3, "word " * 3000 + "x"), (4, "123"), (5, None), (6, ""), (7, "é")]
    rows = language.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    for r in rows:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if not words:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        total, n = np.zeros(len(model.names)), 0
        for word, times in Counter(words).items():
            buckets = language.subwords([word])[0]
            total += times * model.sums[buckets].sum(axis=0)
            n += times * len(buckets)
        z = (total / n + model.bias) * model.scale
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.names[p.argmax()] and abs(r.score - p.max()) < 1e-9


# --- the queries on a whole driver table -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def documents():
    import pyarrow.parquet as pq

    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    t = pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def test_op8_query(spark, documents):
    raw = [(t or "").encode() for t in documents.values()]
    gone, passages = brute.removed(raw, 400), brute.removed(raw, 240)
    rows = {r.doc_id: r for r in queries.op8_suffix_dedup(spark, DIR).collect()}
    assert len(rows) == len(documents)
    for d, t, g, p in zip(documents, raw, gone, passages, strict=True):
        r = rows[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(g.sum()), brute.runs(g), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], p.astype(int), [0]])))
        assert r.repeats == any(len(t[a:b].split()) > 50 for a, b in edges.reshape(-1, 2))


def test_op7_query(spark, documents):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in documents.items():
        ids = own.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_byte_bpe(spark, DIR).collect()} == want


def test_op4_query(spark, documents):
    prints = {d: simhash.majority(simhash.shingle_hashes((t or "").encode(), 3)) for d, t in documents.items()}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    values = np.array([prints[d] for d in ids], dtype=np.uint64)
    for k, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ values[k]) <= 2):
            a, b = sorted((find(d), find(ids[j])))
            root[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, DIR).collect()}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in ids}
