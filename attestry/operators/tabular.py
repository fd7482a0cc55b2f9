"""The ledger's operators over any tables: what the rules use inside documents, for data that is relational to begin with.

All are DataFrame expressions. Keys go into equi-joins, aggregations that combine before they shuffle, or windows partitioned by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quote_matches(texts: DataFrame, quotes: DataFrame, text_id: str, quote_id: str, anchor_words: int = 4, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Which quotes stand in which texts, letter for letter, and where first: text id, quote id, start, end (characters).

    texts, quotes: an id and a column text. Quotes of broadcast_bytes in all, which is looked at first, go to every task as one automaton (Aho-Corasick), and each text is gone through
    once: nothing is shuffled or joined. More quotes are parted. Those of three words or more meet their texts by the hash of the run of words that follows the first one: as many
    words as the quote has between its ends, at most anchor_words. Only hashes and ids are dealt out to meet, each run of a text once; the texts and the quotes of the pairs join them
    afterwards. Shorter quotes have no place where they could meet a text: they go through the texts in automata of broadcast_bytes each, one after the other.

    Defined results: null and empty quotes and null texts match nothing. Rows that repeat an id or a text match for themselves.
    """
    asked = quotes.select(F.col(quote_id).alias("q"), F.col("text").alias("quote")).where(F.length("quote") > 0)
    said = texts.select(F.col(text_id).alias("t"), F.col("text"))
    size = F.octet_length("quote") + 64
    if (asked.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes:
        return _spotted(said, asked, text_id, quote_id)

    asked = asked.withColumn("w", F.split("quote", r"\s+", -1))
    short = asked.where(F.size("w") < 3).select("q", "quote")
    number = short.withColumn("part", F.pmod(F.xxhash64("quote", "q"), F.lit(max(1, -(-(short.agg(F.sum(size)).first()[0] or 0) * 2 // broadcast_bytes)))))
    parts = [r["part"] for r in number.select("part").distinct().orderBy("part").collect()]  # bounded by their bytes
    found = [_spotted(said, number.where(F.col("part") == part).select("q", "quote"), text_id, quote_id) for part in parts]
    return reduce(DataFrame.unionByName, [*found, _anchored(said, asked.where(F.size("w") >= 3), text_id, quote_id, anchor_words)])


def _spotted(said: DataFrame, asked: DataFrame, text_id: str, quote_id: str) -> DataFrame:
    """said: t and text. asked: q and quote, few enough to be broadcast. Every text is gone through once by an automaton of all quotes."""
    listed = asked.toArrow()
    held = said.sparkSession.sparkContext.broadcast((listed.column("q").combine_chunks(), listed.column("quote").to_pylist()))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((said, "t"), (asked, "q"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids, quotes = held.value
        of: dict[str, list[int]] = {}
        for k, quote in enumerate(quotes):
            of.setdefault(quote, []).append(k)
        automaton = ahocorasick.Automaton()
        for quote, rows in of.items():
            automaton.add_word(quote, (len(quote), rows))
        automaton.make_automaton()
        for batch in batches:
            for at in range(0, batch.num_rows if of else 0, 1024):
                out: list[tuple[int, int, int, int]] = []
                for row, text in enumerate(batch.column(1).slice(at, 1024).to_pylist(), at):
                    seen: set[int] = set()
                    for last, (length, rows) in automaton.iter(text) if text else ():
                        if rows[0] not in seen:  # matches come by their ends, so a quote's first one comes first
                            seen.add(rows[0])
                            out += [(row, k, last + 1 - length, last + 1) for k in rows]
                row, k, start, end = zip(*out, strict=True) if out else ((),) * 4
                whole = lambda values: pa.array(values, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(whole(row)), ids.take(whole(k)), whole(start), whole(end)], ["t", "q", "start", "end"])

    return said.mapInArrow(run, f"t {kinds[0]}, q {kinds[1]}, start long, end long").toDF(text_id, quote_id, "start", "end")


def _anchored(said: DataFrame, asked: DataFrame, text_id: str, quote_id: str, anchor_words: int) -> DataFrame:
    """said: t and text. asked: q, quote and w, its words, three at least."""
    size = F.least(F.size("w") - 2, F.lit(anchor_words))
    anchored = asked.select("q", size.alias("size"), F.xxhash64(size, F.slice("w", F.lit(2), size)).alias("anchor"))
    sizes = [r["size"] for r in anchored.select("size").distinct().orderBy("size").collect()]  # at most anchor_words
    if not sizes:
        return _spotted(said, asked.select("q", "quote"), text_id, quote_id)
    split = said.withColumn("w", F.split("text", r"\s+", -1))
    runs = lambda n: F.when(F.size("w") >= n + 2, F.transform(F.sequence(F.lit(2), F.size("w") - n), lambda i: F.xxhash64(F.lit(n), F.slice("w", i, n)))).otherwise(F.array().cast("array<bigint>"))
    met = split.select("t", F.explode(F.array_distinct(F.concat(*[runs(n) for n in sizes]))).alias("anchor"))
    pairs = met.join(anchored.select("q", "anchor"), "anchor").select("t", "q").distinct()
    both = pairs.join(asked.select("q", "quote"), "q").join(said, "t")
    start = F.instr("text", F.col("quote")) - 1
    return both.where(F.contains("text", "quote")).select(F.col("t").alias(text_id), F.col("q").alias(quote_id), start.cast("long").alias("start"), (start + F.length("quote")).cast("long").alias("end"))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def later_duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows of a key but its first."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth > 1").drop("nth")


def dangling(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Rows whose reference is not known; a null reference dangles."""
    return rows.join(known.select(on).distinct(), on, "left_anti")


def order_violations(rows: DataFrame, key: str, order: str, value: str, valid: str = "TRUE", strict: bool = False) -> DataFrame:
    """Rows whose value is below (or, strict, not above) the last valid one before them; a violating row is the next one's last all the same."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.expr(valid), F.col(value)), ignorenulls=True).over(before)
    kept = rows.withColumn("previous", last)
    return kept.where(F.col(value) <= F.col("previous") if strict else F.col(value) < F.col("previous"))


def first_match(rows: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """The columns of each key's first row."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("f")).select(key, *(F.col(f"f.{c}").alias(c) for c in columns))


def last_match(rows: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """The columns of each key's last row."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("l")).select(key, *(F.col(f"l.{c}").alias(c) for c in columns))


def multisets(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Each value of a key with how often it occurs, so that multisets compare row by row, without lists in memory."""
    return rows.groupBy(key, value).agg(F.count("*").alias(name))


def equal_multisets(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key and same: whether both sides have the same values equally often."""
    both = multisets(left, key, value, "a").join(multisets(right, key, value, "b"), [key, value], "full")
    return both.groupBy(key).agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, declared, found (as text) of each field in which the sides differ; nulls equal nulls."""
    text = lambda side, f: F.col(f"{side}.{f}").cast("string")
    both = left.alias("l").join(right.alias("r"), key)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), text("l", f).alias("declared"), text("r", f).alias("found")) for f in fields])
    return both.select(key, F.explode(F.filter(pairs, lambda p: ~p["declared"].eqNullSafe(p["found"]))).alias("m")).select(key, "m.*")


def lacking(rows: DataFrame, key: str, condition: Column) -> DataFrame:
    """Keys of which no row meets the condition."""
    return rows.groupBy(key).agg(F.bool_or(F.coalesce(condition, F.lit(False))).alias("has")).where(~F.col("has")).select(key)


def stages_reversed(rows: DataFrame, key: str, at: str, kind: str, first: str, second: str) -> DataFrame:
    """Keys whose first row of the second kind does not come after their first row of the first kind."""
    when = lambda k: F.min(F.when(F.col(kind) == k, F.col(at)))
    return rows.groupBy(key).agg(when(first).alias("first_at"), when(second).alias("second_at")).where("second_at <= first_at")


def without_pair(rows: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose combination of values is none of those allowed."""
    return rows.join(allowed.select(*on).distinct(), on, "left_anti")


def cycle_nodes(edges: DataFrame, in_one_task: int = 100_000) -> DataFrame:
    """edges: key, a, b. Nodes (key, node) on a cycle of their key's graph or leading to one.

    What leads only to ends is peeled off. A graph of at most in_one_task edges is peeled by one task; larger ones in rounds of a semi-join by
    (key, node), each checkpointed, until nothing goes any more or they are small enough. Rounds are as many as the longest way to an end is long.
    An edge with a null leads nowhere. Repeated edges count once.
    """
    from attestry.functions.staging import checkpointed, ship

    ship(edges.sparkSession)  # workers import _peeled by name
    left = checkpointed(edges.select("key", "a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    done, kind = [], edges.schema["a"].dataType.simpleString()
    schema = f"key {edges.schema['key'].dataType.simpleString()}, node {kind}"
    before = -1
    while True:
        sizes = left.groupBy("key").agg(F.count("*").alias("n"))
        small = sizes.where(F.col("n") <= in_one_task).select(F.col("key").alias("k"))
        own = lambda how: left.join(small, left["key"].eqNullSafe(small["k"]), how)
        done.append(own("left_semi").groupBy("key").applyInPandas(_peeled, schema))
        large = checkpointed(own("left_anti"))
        total = large.count()
        if total in (0, before):
            return reduce(DataFrame.unionByName, [*done, large.select("key", F.col("a").alias("node")).distinct()])
        before = total
        starts = large.select(F.col("key").alias("k"), F.col("a").alias("start")).distinct()
        left = checkpointed(large.join(starts, large["key"].eqNullSafe(starts["k"]) & (large["b"] == starts["start"]), "left_semi"))


def _peeled(graph: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one graph that are left when those that lead only to ends have gone."""
    out = graph.groupby("a")["b"].agg(set).to_dict()
    back: dict = {}
    for a, b in zip(graph["a"], graph["b"], strict=True):
        back.setdefault(b, set()).add(a)
    ends = [n for n in back if n not in out]
    while ends:
        gone = ends.pop()
        for a in back.get(gone, ()):
            if a in out:
                out[a].discard(gone)
                if not out[a]:
                    del out[a]
                    ends.append(a)
    return pd.DataFrame({"key": pd.Series([graph["key"].iloc[0]] * len(out), dtype=graph["key"].dtype if len(out) else object), "node": pd.Series(list(out), dtype=object)})


def issue_union(*streams: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, streams)


def toggled(done: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """The keys done after each touched one has changed sides: a key in one table only. Each counts once in either table."""
    either = done.select(*keys, F.lit(1).alias("side")).unionByName(touched.select(*keys, F.lit(2).alias("side"))).distinct()
    return either.groupBy(*keys).agg(F.count("*").alias("sides")).where("sides = 1").select(*keys)


def added(done: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The keys done with more of them; adding a key again changes nothing."""
    return done.select(*keys).unionByName(more.select(*keys)).distinct()


def upserted(state: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """state with, for each key, its last change by order in place of what it was. Columns of state; order columns are those of changes only."""
    values = [c for c in state.columns if c not in keys]
    was = state.select(*keys, F.struct(F.lit(0).alias("new"), F.struct(*[F.lit(None).cast(changes.schema[o].dataType).alias(o) for o in order]).alias("at"), F.struct(*values).alias("values")).alias("row"))
    now = changes.select(*keys, F.struct(F.lit(1).alias("new"), F.struct(*order).alias("at"), F.struct(*values).alias("values")).alias("row"))
    last = was.unionByName(now).groupBy(*keys).agg(F.max_by("row", F.struct("row.new", "row.at")).alias("row"))
    return last.select(*keys, "row.values.*").select(*state.columns)


def size_label(n: Column) -> Column:
    """Bytes for people: MB with one decimal above 1 MiB, else whole KB, one at least."""
    return F.when(n > 1048576, F.concat(F.format_number(n / 1048576, 1), F.lit(" MB"))).otherwise(F.concat(F.greatest(F.lit(1), F.floor(n / 1024 + 0.5)).cast("string"), F.lit(" KB")))


def url_label(url: Column, most: int = 62) -> Column:
    """A URL for people: trimmed, without its scheme, and not too long."""
    return F.substring(F.regexp_replace(F.trim(url), "(?i)^https?://", ""), 1, most)
