from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from attestry.operators import engine, tabular
from attestry.sources import documents, schemas
from attestry.streaming import ledger
from tests import ledgers as L


def drained(query_df, name, spark, mode="append"):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


BASE = datetime(2027, 1, 1)
ORDER = "key string, received timestamp, sequence long, at timestamp"
RETAINED = "key string, subject string, at timestamp, state string"


def cuts(spark, tmp_path, rows, schema, time, jitter):
    """The rows as a stream in one, three and eight batches, each another mixture within the lateness, and two rows of another key, late enough that all others have passed."""
    rng = random.Random(4)
    for n in (1, 3, 8):
        mixed = sorted(rows, key=lambda r: r[time].timestamp() + rng.random() * jitter)
        size = -(-len(mixed) // n)
        parts = [mixed[k : k + size] for k in range(0, len(mixed), size)] + [[("end", *(BASE + timedelta(days=5000 + k) if c == time else (None if schema is ORDER else "x") for c in range(1, 4)))] for k in range(2)]
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{n}/{k}")
            for file in (tmp_path / str(n) / str(k)).glob("part-*"):
                os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # the source takes files by time
        yield n, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{n}")


def test_order_does_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), BASE + timedelta(seconds=7 * k, microseconds=rng.randrange(10**6)), rng.choice([None, *range(40)]), rng.choice([None, *(BASE + timedelta(seconds=s) for s in range(90))])) for k in range(150)]
    want = sorted(tuple(r) for r in ledger.order_issues(spark.createDataFrame(rows, ORDER)).collect())
    last, plain = {}, []
    for key, received, sequence, at in sorted(rows, key=lambda r: r[1]):
        before, before_at = last.get(key, (-1, None))
        plain += [(key, received, sequence, "event_order")] if sequence is not None and sequence <= before else []
        plain += [(key, received, sequence, "event_time_order")] if at and before_at and at < before_at else []
        last[key] = (before if sequence is None else sequence, at or before_at)
    assert want == sorted(plain, key=str) or sorted(want, key=str) == sorted(plain, key=str)
    for n, stream in cuts(spark, tmp_path, rows, ORDER, 1, 60):
        assert sorted(drained(ledger.order_issues(stream, "2 minutes"), f"order_{n}", spark), key=str) == sorted(plain, key=str)


def test_retention_does_not_depend_on_batches(spark, tmp_path):
    day = lambda n: BASE + timedelta(days=n)
    rows = [
        ("p", "provider", day(1), "status_unavailable"), ("p", "provider", day(2), "deletion_requested"), ("p", "provider", day(3), "provider_reported_deleted"), ("p", "provider", day(4), "deletion_requested"),
        ("p", "browser", day(1), "not_stored"), ("q", "provider", day(1), "deletion_requested"), ("q", "provider", day(20), "deletion_requested"), ("q", "provider", day(40), "provider_reported_deleted"),
        ("r", "provider", day(5), "deletion_requested"), ("r", "provider", day(2000), "deletion_requested"),
    ]
    want = {
        ("p", "provider", day(1), "status_unavailable", None, "changed"), ("p", "provider", day(2), "deletion_requested", "status_unavailable", "changed"),
        ("p", "provider", day(3), "provider_reported_deleted", "deletion_requested", "changed"), ("p", "provider", day(4), "deletion_requested", "provider_reported_deleted", "not_allowed"),
        ("p", "browser", day(1), "not_stored", None, "changed"), ("q", "provider", day(1), "deletion_requested", None, "changed"), ("q", "provider", day(31), "deletion_requested", "deletion_requested", "unanswered"),
        ("q", "provider", day(40), "provider_reported_deleted", "deletion_requested", "changed"), ("r", "provider", day(5), "deletion_requested", None, "changed"),
        ("r", "provider", day(35), "deletion_requested", "deletion_requested", "unanswered"), ("r", "provider", day(2000), "deletion_requested", None, "changed"),  # forgotten in between
        ("r", "provider", day(2030), "deletion_requested", "deletion_requested", "unanswered"), ("end", "x", BASE + timedelta(days=5000), "x", None, "changed"),
    }
    for n, stream in cuts(spark, tmp_path, rows, RETAINED, 2, 0):
        got = drained(ledger.retention_states(stream), f"retention_{n}", spark)
        assert len(got) == len(set(got)) and set(got) == want


def test_issues_once_although_a_run_is_killed(spark, tmp_path):
    """A run that fails after it has written half of its second batch, and is started again."""
    bad = L.pack() | {"packId": "9"}
    for k in range(3):
        spark.createDataFrame([(f"{k}.good", json.dumps(L.pack())), (f"{k}.bad", json.dumps(bad))], "key string, raw string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("key string, raw string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    calls = []

    def fails_once(docs):
        calls.append(1)
        issues = engine.validate_pack(docs)
        if len(calls) == 2:
            issues.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/out/issues/batch=1")
            raise RuntimeError("killed")
        return issues

    run = lambda: documents.write_checked(stream, f"{tmp_path}/out", f"{tmp_path}/state", fails_once, availableNow=True)
    with pytest.raises(StreamingQueryException):
        run().awaitTermination()
    run().awaitTermination()
    issues = spark.read.parquet(f"{tmp_path}/out/issues")
    assert sorted((r.key, r.path, r.code) for r in issues.collect()) == [(f"{k}.bad", "$.packId", "invalid_id") for k in range(3)]
    assert sorted((r.key, r.success) for r in spark.read.parquet(f"{tmp_path}/out/verdicts").collect()) == sorted((f"{k}.{x}", x == "good") for k in range(3) for x in ("good", "bad"))


def test_first_seen(spark, tmp_path):
    rows = [("a", "x", "2027-01-01 00:00:00"), ("a", "x", "2027-01-01 00:00:05"), ("a", "y", "2027-01-01 00:00:09")]
    spark.createDataFrame(rows, "key string, id string, at string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, id string, at string").parquet(str(tmp_path / "in")).withColumn("at", F.to_timestamp("at"))
    assert sorted((k, i) for k, i, _ in drained(ledger.first_seen(stream), "first_seen", spark)) == [("a", "x"), ("a", "y")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": 1}, indent=1))
    got = documents.read_json_files(spark, str(tmp_path / "a.json")).collect()
    assert len(got) == 1 and json.loads(got[0]["raw"]) == {"x": 1}
    assert documents.file_facts(spark, str(tmp_path / "a.json")).first()["name"] == "a.json"
    (tmp_path / "lines.jsonl").write_text('{"x": 1}\n\n{"x": 1}\n{"x": 2}\n')
    assert documents.read_json_lines(spark, str(tmp_path / "lines.jsonl")).select("key").distinct().count() == 3
    assert documents.from_objects(spark, {"k": {"x": 1}}).first()["raw"] == '{"x": 1}'


def test_samples_and_schemas(spark):
    for name, schema in (("pack", schemas.PACK), ("draft", schemas.ANALYSIS), ("context", schemas.CONTEXT)):
        row = schemas.typed(documents.sample(spark, name), schema).first()
        without = lambda x: {k: without(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [without(v) for v in x] if isinstance(x, list) else str(x)
        assert without(row["doc"].asDict(recursive=True)) == without(json.loads(row["raw"]))


@pytest.mark.parametrize("limit", [16 << 20, 300, 70])
def test_quotes(spark, limit):
    """In one automaton, and parted: short quotes in several, longer ones by anchors."""
    texts = [(1, "one two three four five six seven"), (2, ""), (3, None), (4, "xone two three four five sixy"), (5, "aaaa"), (6, "été 😀 two two two"), (6, "two again")]
    quotes = [(1, "one two three four five six"), (2, "two"), (3, ""), (4, None), (5, "aa"), (6, "two"), (7, "two three"), (8, " "), (9, "😀"), (10, "two two two"), (11, "four five six"), (12, "not there at all")]
    want = sorted((t, q, text.index(quote), text.index(quote) + len(quote)) for t, text in texts for q, quote in quotes if text and quote and quote in text)
    found = tabular.quote_matches(spark.createDataFrame(texts, "t long, text string").repartition(2), spark.createDataFrame(quotes, "q long, text string"), "t", "q", broadcast_bytes=limit)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_no_quotes(spark):
    texts = spark.createDataFrame([("a", "text")], "start string, text string")
    assert tabular.quote_matches(texts, spark.createDataFrame([], "q string, text string"), "start", "q").collect() == []


def test_labels(spark):
    df = spark.createDataFrame([(100,), (1536,), (3 * 1048576,)], "n long").select(tabular.size_label(F.col("n")))
    assert [r[0] for r in df.collect()] == ["1 KB", "2 KB", "3.0 MB"]
    assert spark.range(1).select(tabular.url_label(F.lit("  HTTPS://a.org/b "))).first()[0] == "a.org/b"
