"""The ledger's rules on streams of events: order, retention, duplicates, pairing, counts.

Order and retention work by ``ordered``: the same is found for any cut of the input into batches. They need Spark's RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import staging
from attestry.streaming import ordered

DAY = 24 * 3600 * ordered.SECOND


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """Sets the session's state store, and sends the rules to the executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.PROVIDER)
    return staging.ship(spark)


class Order(ordered.Rule):
    event = "sequence long, at long"
    state = "sequence long, at long, seen long"
    result = "received timestamp, sequence long, code string"

    def __init__(self, kept: int):
        self.kept = kept

    def take(self, state, time, event):
        (last, last_at), (sequence, at) = (state[:2] if state else (-1, None)), event
        wrong = sequence is not None and sequence <= last, at is not None and last_at is not None and at < last_at
        found = [(_timestamp(time), sequence, code) for code, is_wrong in zip(("event_order", "event_time_order"), wrong, strict=True) if is_wrong]
        return (last if sequence is None else sequence, last_at if at is None else at, time), found

    def deadline(self, state):
        return state[2] + self.kept


def _timestamp(time: int) -> datetime:
    return datetime.fromtimestamp(0, UTC) + timedelta(microseconds=time)


def order_issues(events: DataFrame, lateness: str = "1 hour", kept_days: int = 7) -> DataFrame:
    """events: key, received, sequence, at. The events whose sequence is not over the last one's, or whose time is before it: key, received, sequence, code.

    Events of a ledger are taken in the order in which they were received (ties by sequence, then by time), and each is the next one's last, even if it is wrong. A sequence or a time
    that is null is no last one. For a stream, and for a table with the same result, but that a stream forgets a ledger kept_days after its last event; an event without
    received has no place and is left out. Events more than the lateness behind are left out of a stream.
    """
    typed = events.select(F.col("key").cast("string").alias("key"), F.col("received").cast("timestamp").alias("received"), F.col("sequence").cast("long").alias("sequence"), F.unix_micros(F.col("at").cast("timestamp")).alias("at")).where("received IS NOT NULL")
    if events.isStreaming:
        use_rocksdb(events.sparkSession)
        return ordered.in_order(typed, Order(kept_days * DAY), ["key"], "received", lateness)
    before = Window.partitionBy("key").orderBy("received", "sequence", "at").rowsBetween(Window.unboundedPreceding, -1)
    last, last_at = (F.last(c, ignorenulls=True).over(before) for c in ("sequence", "at"))
    wrong = typed.withColumns({"event_order": F.col("sequence") <= F.coalesce(last, F.lit(-1)), "event_time_order": F.col("at") < last_at})
    codes = F.array(*[F.when(F.col(c), F.lit(c)) for c in ("event_order", "event_time_order")])
    return wrong.select("key", "received", "sequence", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


#: The states of retention are fixed values of the format. Which may follow which is this library's choice: what is deleted or was never stored stays so.
FOLLOWS = {
    "not_stored": (), "deletion_requested": ("provider_reported_deleted", "locally_cleared", "status_unavailable"), "provider_reported_deleted": (), "locally_cleared": (),
    "status_unavailable": ("deletion_requested", "provider_reported_deleted", "locally_cleared"),
}


class Retention(ordered.Rule):
    event = "state string"
    state = "state string, since long, seen long, told boolean"
    result = "at timestamp, state string, previous string, code string"

    def __init__(self, answer: int, kept: int):
        self.answer, self.kept = answer, kept

    def take(self, state, time, event):
        (to,) = event
        now, since, _, told = state or (None, time, time, False)
        if to == now:
            return (now, since, time, told), []
        allowed = now is None or to in FOLLOWS.get(now, ())
        after = (to, time, time, False) if allowed else (now, since, time, told)
        return after, [(_timestamp(time), to, now, "changed" if allowed else "not_allowed")]

    def deadline(self, state):
        now, since, seen, told = state
        forgotten = max(seen, since + self.answer) + self.kept
        return since + self.answer if now == "deletion_requested" and not told else forgotten

    def expired(self, state, time):
        now, since, seen, told = state
        if now == "deletion_requested" and not told:
            return (now, since, seen, True), [(_timestamp(time), now, now, "unanswered")]
        return None, []


def retention_states(records: DataFrame, lateness: str = "1 hour", answer_days: int = 30, kept_days: int = 365) -> DataFrame:
    """records (streaming): key, subject, at, state. Each change of a subject's state, and each request for deletion that has no answer: key, subject, at, state, previous, code.

    Records are taken in order of time. A change is ``changed``, or ``not_allowed`` if the state may not be followed by it; then the state stays as it was. A request that nothing follows
    for answer_days is ``unanswered``, once, at the time when that was clear. A subject is forgotten kept_days after its last record (and after its answer was due), so state is bounded
    by the subjects that have records. Records without a time or a state, or more than the lateness behind, are left out.
    """
    use_rocksdb(records.sparkSession)
    typed = records.select(*[F.col(c).cast("string").alias(c) for c in ("key", "subject", "state")], F.col("at").cast("timestamp").alias("at")).where("at IS NOT NULL AND state IS NOT NULL")
    return ordered.in_order(typed, Retention(answer_days * DAY, kept_days * DAY), ["key", "subject"], "at", lateness)


def first_seen(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """events (streaming): key, id, at. Each id of a ledger once; a repeat within the lateness is dropped."""
    return events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["key", "id"])


def unfinished_transfers(started: DataFrame, completed: DataFrame, within: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Streams of (id, at). Starts whose completion does not follow within the time; they come out when the watermark has passed it."""
    s = started.select(F.col("id"), F.col("at").alias("started_at")).withWatermark("started_at", lateness)
    c = completed.select(F.col("id").alias("done_id"), F.col("at").alias("completed_at")).withWatermark("completed_at", lateness)
    paired = s.join(c, F.expr(f"id = done_id AND completed_at >= started_at AND completed_at <= started_at + INTERVAL {within}"), "left_outer")
    return paired.where("done_id IS NULL").select("id", "started_at")


def counts_by_window(events: DataFrame, length: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """events (streaming): key, type, at. Events by type and window of time."""
    return events.withWatermark("at", lateness).groupBy(F.window("at", length), "type").agg(F.count("*").alias("n")).select("window.start", "window.end", "type", "n")
