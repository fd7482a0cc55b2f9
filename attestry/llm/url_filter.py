"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is a host, a path and a verdict. It fits a URL whose host is the rule's or a subdomain of it and whose path starts with
the rule's; of the rules that fit, the longest (host and path together) wins. Each URL is expanded into the expressions that a
rule could have: every host suffix of a label count that some rule has, joined with every path prefix that ends at a slash (up
to the depth of the deepest rule) or has the length of a rule that does not end at one. Expressions meet rules in an equi-join
on a four-byte prefix of their SHA-256; then the full digests are compared.

The rules are broadcast only if there are at most ``broadcast_rules`` of them; beyond that the join is a shuffle on the prefix.
No Python runs on the executors.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule. A rule with a null or empty host
fits nothing; a null path is the empty path. Of rules with the same host and path, the verdict that sorts last stays. Repeated
rows, also those with the same id, each get their row. Extra columns are not read; columns named host, path, rule or verdict do
no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW = "allow"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column, counts: list[int]) -> Column:
    """The host's last n labels, for each n in counts that it has."""
    labels = F.split(host, r"\.", -1)
    found = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.least(F.size(labels), F.lit(n))), ".")) for n in counts]
    return F.array_compact(F.array(*found))


def _prefixes(path: Column, depth: int, lengths: list[int]) -> Column:
    """The empty path, prefixes that end at the first ``depth`` slashes, and those with one of the given lengths."""
    upto = F.sequence(F.lit(1), F.lit(max(depth, 1)))
    ends = F.transform(upto, lambda n: F.when(F.size(F.split(path, "/", -1)) > n, F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/"))))
    cuts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    slashes = ends if depth else F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(F.array(F.lit("")), slashes, cuts)))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, broadcast_rules: int = 100_000) -> DataFrame:
    """rules: host, path, verdict. Returns id, host, path, rule, verdict for every row of pages."""
    clean = rules.select(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    clean = clean.where(F.coalesce(F.col("rule_host"), F.lit("")) != "").groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    slashed = F.col("rule_path").endswith("/")
    shape = clean.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.", -1)))).alias("labels"),
        F.coalesce(F.max(F.when(slashed, F.size(F.split("rule_path", "/", -1)) - 1)), F.lit(0)).alias("depth"),
        F.sort_array(F.collect_set(F.when(~slashed & (F.col("rule_path") != ""), F.length("rule_path")))).alias("lengths"),
    ).first()

    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    digest = lambda host, path: F.sha2(F.concat(host, path), 256)
    keyed = clean.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_digest", 1, 8))
    keyed = F.broadcast(keyed) if shape["n"] <= broadcast_rules else keyed

    judged = urls.where((F.col("host") != "") & F.lit(shape["n"] > 0)).select("page_id", "url", "host", "path").distinct()
    expanded = judged.select("page_id", "url", F.explode(_suffixes(F.col("host"), shape["labels"] or [1])).alias("suffix"), "path")
    expanded = expanded.select("page_id", "url", "suffix", F.explode(_prefixes(F.col("path"), shape["depth"], shape["lengths"])).alias("prefix"))
    expanded = expanded.withColumn("digest", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, 8))
    hits = expanded.join(keyed, "short").where(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), "rule_host", "rule_path")
    best = hits.groupBy("page_id", "url").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), rank).alias("best"))

    left, right = urls.alias("u"), best.alias("b")
    same = F.col("u.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("u.url") == F.col("b.url"))
    return left.join(right, same, "left").select(F.col("u.page_id").alias(id_col), F.col("u.host").alias("host"), F.col("u.path").alias("path"), F.col("b.best.rule").alias("rule"), F.coalesce("b.best.rule_verdict", F.lit(default)).alias("verdict"))
