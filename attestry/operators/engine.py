"""Entry points: whole documents in, issues and verdicts out.

The issues of a call are computed before it returns, and checkpointed: the documents are parsed and dealt out by key once, the tables of their parts
are cached dealt out so, and rules are looked at, a few tables of issues a job, without another shuffle. A null key is a key like any other.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import staging
from attestry.functions import values as V
from attestry.operators import parts, relations
from attestry.operators.messages import MESSAGES
from attestry.operators.relations import structural
from attestry.operators.structure import UNKNOWN, At, Check, places

#: So many tables of issues are looked at in one job: a task carries the expressions of them all.
TOGETHER = 6
ISSUES = "key string, path string, code string, message string, ord array<int>"


class LedgerError(ValueError):
    """Documents that break rules, with the formatted issues of each."""


def messages(product: str) -> dict[str, str]:
    """What each issue code means; one code has the product's name."""
    return {(f"{product}_version_missing" if code == "product_version_missing" else code): text for code, text in MESSAGES.items()}


def _named(product: str) -> str:
    if not re.fullmatch("[a-z][a-z0-9_]*", product):
        raise ValueError("a product's name is a lower-case word")
    return product


def _parsed(docs: DataFrame, rules: relations.Rules, columns: dict[str, str], **of: str) -> DataFrame:
    """key and, by their names here, columns as VARIANT, null where they are no JSON, with SQL over those; dealt out by key, and kept."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.selectExpr("CAST(key AS STRING) AS key", *columns.values()).repartition(partitions, "key")
    read = dealt.selectExpr("key", *(f"try_parse_json({c}) AS {name}" for name, c in columns.items()))
    return rules.keep(read.selectExpr("*", *(f"{sql} AS {name}" for name, sql in of.items())))


def _elements(rows: DataFrame, v: str, path: str, checks: dict[str, Check], ranks: dict[str, int], above: tuple = ()) -> list[DataFrame]:
    """The structural issues of the elements of a document's arrays, which have these ranks below those above."""
    found = []
    for name, check in checks.items():
        listed = rows.selectExpr("key", f"posexplode({V.items(V.get(v, name))}) AS (at, item)").selectExpr("key", "at", "item", f"concat('{path}.{name}[', at, ']') AS path")
        found.append(structural(listed, check(At("item", "path", (*above, ranks[name], "at")))))
    return found


def _unreadable(rows: DataFrame, column: str) -> DataFrame:
    """A document that is no JSON at all has this one issue."""
    return rows.where(f"{column} IS NULL").selectExpr("key", "'$' AS path", "'parser_exception' AS code", f"{places()} AS ord")


def computed(docs: DataFrame, rules_of, product: str, raw: dict[str, str]) -> DataFrame:
    """The issues of all tables that rules_of(rules) returns: key, path, code, message, ord. Tables dealt out by key meet by (key, id) as they are, which Spark has a setting for.

    raw: the columns of docs with JSON text, by the paths that they are called by.
    """
    spark = docs.sparkSession
    rules = relations.Rules(spark)
    own = {"spark_sql_variant_allowDuplicateKeys": "true", "spark_sql_requireAllClusterKeysForCoPartition": "false", "spark_sql_optimizer_canChangeCachedPlanOutputPartitioning": "false", "spark_sql_autoBroadcastJoinThreshold": "-1"}
    with staging.settings(spark, **own):
        try:
            tables = [*rules_of(rules), *rules.tables]
            groups = [reduce(DataFrame.unionByName, tables[k : k + TOGETHER]) for k in range(0, len(tables), TOGETHER)]
            issues = reduce(DataFrame.unionByName, [staging.checkpointed(g) for g in groups])
        finally:
            rules.release()
    issues = in_document_order(issues, docs, raw)
    text = F.create_map(*[F.lit(x) for pair in messages(product).items() for x in pair])
    return issues.select("key", "path", "code", F.try_element_at(text, F.col("code")).alias("message"), "ord")


def in_document_order(issues: DataFrame, docs: DataFrame, raw: dict[str, str]) -> DataFrame:
    """Issues whose unknown members are ranked as they are written, which a VARIANT, whose members are sorted, does not say: the JSON text of documents that have such members is read for it."""
    unknown = issues.where("code = 'unknown_field'")
    if unknown.isEmpty():
        return issues
    staging.ship(docs.sparkSession)
    asked = unknown.groupBy("key").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    texts = docs.select(F.col("key").cast("string").alias("k"), *raw.values())
    met = asked.join(texts, F.col("key").eqNullSafe(F.col("k")))
    found = met.select("key", F.explode(_written(*raw)("paths", *raw.values())).alias("w")).select("key", "w.path", "w.place")
    written = found.groupBy(F.col("key").alias("k"), F.col("path").alias("p")).agg(F.min("place").alias("place"))
    ranked = unknown.join(written, F.col("key").eqNullSafe(F.col("k")) & (F.col("path") == F.col("p")), "left")
    ord_ = F.transform("ord", lambda x: F.when(x == UNKNOWN, F.coalesce("place", F.lit(UNKNOWN))).otherwise(x))
    return issues.where("code <> 'unknown_field'").unionByName(ranked.select("key", "path", "code", ord_.alias("ord")))


def _written(*names: str):
    """A function of paths and JSON texts called by names: (path, place) of each path that is a member of an object, the place among its members."""

    @F.pandas_udf("array<struct<path:string,place:int>>")
    def places_of(*columns):
        import pandas as pd

        from attestry.functions.members import places

        paths, *texts = columns
        return pd.Series([places(set(wanted), dict(zip(names, own, strict=True))) for wanted, *own in zip(paths, *texts, strict=True)])

    return places_of


def validate_context(docs: DataFrame, product: str = parts.PRODUCT) -> DataFrame:
    """docs: key, raw (a canonical source context as JSON text). Returns issues: key, path, code, message, ord; sorted by ord, those of a document are in the order of a walk through it."""

    def rules_of(rules: relations.Rules) -> list[DataFrame]:
        rows = _parsed(docs, rules, {"raw": "raw"})
        read = rows.where("raw IS NOT NULL")
        relations.canonical(read, "raw", "$", (), rules)
        return [_unreadable(rows, "raw"), structural(read, parts.context(At("raw", "'$'")))]

    return computed(docs, rules_of, _named(product), {"$": "raw"})


def validate_draft(docs: DataFrame, product: str = parts.PRODUCT) -> DataFrame:
    """docs: key, raw (a model draft), context (its canonical sources). Without a context that is an object only that is reported."""

    def rules_of(rules: relations.Rules) -> list[DataFrame]:
        rows = _parsed(docs, rules, {"raw": "raw", "context": "context"}, usable=f"raw IS NOT NULL AND {V.is_object('context')}")
        bad = rows.where("raw IS NULL OR context IS NULL").selectExpr("key", "'$' AS path", "'parser_exception' AS code", f"{places()} AS ord")
        read, usable = rows.where("raw IS NOT NULL AND context IS NOT NULL"), rows.where("usable")
        known = relations.canonical(usable, "context", "$context", (0,), rules)
        relations.analysis(usable.selectExpr("key", "raw AS a"), "a", "$", (1,), known, False, product, rules)
        shapes = [structural(read, parts.context(At("context", "'$context'", (0,)))), structural(usable, parts.analysis(False, product)(At("raw", "'$'", (1,))))]
        return [bad, *shapes, *_elements(usable, "raw", "$", {"questions": parts.question}, _next(parts.ANALYSIS_RANKS), (1,))]

    return computed(docs, rules_of, _named(product), {"$": "raw", "$context": "context"})


def _next(ranks: dict[str, int]) -> dict[str, int]:
    """The elements of an array come after it."""
    return {name: rank + 1 for name, rank in ranks.items()}


def validate_pack(docs: DataFrame, product: str = parts.PRODUCT) -> DataFrame:
    """docs: key, raw (an action pack as JSON text). Returns issues: key, path, code, message, ord; sorted by ord, those of a document are in the order of a walk through it."""

    def rules_of(rules: relations.Rules) -> list[DataFrame]:
        members = {n: V.get("doc", k) for k, n in (("canonicalSources", "context"), ("analysis", "analysis"), ("receipt", "receipt"), ("corrections", "corrections"))}
        rows = _parsed(docs, rules, {"doc": "raw"}, **members, usable=f"{V.is_object('doc')} AND {V.is_object(members['context'])}")
        at = parts.PACK_RANKS
        above = {k: (at[k],) for k in at}
        usable = rows.where("usable")
        known = relations.canonical(usable, "context", "$.canonicalSources", above["canonicalSources"], rules)
        found = relations.analysis(usable.select("key", "analysis"), "analysis", "$.analysis", above["analysis"], known, True, product, rules)
        ledger = relations.receipt(usable.select("key", "analysis", "receipt"), above["receipt"], known, found, product, rules)
        relations.corrections(usable, known, found, ledger["events"], rules)
        return [
            _unreadable(rows, "doc"), structural(rows.where("doc IS NOT NULL"), parts.pack(At("doc", "'$'"), product)),
            *_elements(usable, "analysis", "$.analysis", {"questions": parts.question}, _next(parts.ANALYSIS_RANKS), above["analysis"]),
            *_elements(usable, "receipt", "$.receipt", {k: v for k, v in parts.receipt_elements(product).items() if k in ("components", "externalReferences")}, _next(parts.RECEIPT_RANKS), above["receipt"]),
            *_elements(usable, "doc", "$", {"corrections": parts.correction}, _next(at)),
        ]

    return computed(docs, rules_of, _named(product), {"$": "raw"})


def verdicts(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """key, n_issues, success, trust: structural at best, since nothing here can establish more."""
    counted = issues.groupBy("key").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return docs.select("key").join(counted, "key", "left").select("key", n.alias("n_issues"), (n == 0).alias("success"), F.when(n == 0, "structural").otherwise("rejected").alias("trust"))


def format_issues(issues: DataFrame) -> DataFrame:
    """key and text: one line per issue, in the order in which a walk through the document meets them."""
    line = F.format_string("%s [%s] %s", "path", "code", "message")
    return issues.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "path", "code", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def assert_valid(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """docs, or a LedgerError that shows the first broken documents."""
    shown = format_issues(issues).orderBy("key").limit(5).collect()
    if shown:
        raise LedgerError("\n".join(f"{r['key']}:\n{r['text']}" for r in shown))
    return docs


def is_trusted(verdict: DataFrame) -> DataFrame:
    """key, trusted: always false. Documents attest themselves; trust would need a ledger that was assembled independently."""
    return verdict.select("key", F.lit(False).alias("trusted"))


def assert_trusted(docs: DataFrame) -> DataFrame:
    raise LedgerError("No document is trusted without an independently assembled ledger.")
