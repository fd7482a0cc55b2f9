"""The driver's queries on the library's own operators, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import values as V
from attestry.operators import components, structure, tabular
from attestry.plans import cloud, ledgers, streams

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return read.select(*columns) if columns else read


def query(sql: str):
    """Registers a function of read(name, *columns) under its name."""

    def register(f: Callable) -> Callable:
        _queries[f.__name__] = lambda spark, sf_dir: f(lambda name, *columns: table(spark, sf_dir, name, *columns))
        _sql[f.__name__] = sql
        return f

    return register


@query("""
SELECT doc_id, item_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS start, CAST(instr(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS "end"
FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''
""")
def quote_match(read):
    """Which benchmark passages stand in which documents, letter for letter."""
    return tabular.quote_matches(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"), "doc_id", "item_id")


@query("""
SELECT doc_id, item_id, substr(d.text, instr(d.text, b.text), length(b.text)) = b.text AS matches,
  length(b.text) AS units
FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''
""")
def quote_slice(read):
    """J07 slice equality: the UTF-16 slice at the found span is the quote."""
    docs, items = read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")
    spans = tabular.quote_matches(docs, items, "doc_id", "item_id")
    both = spans.join(docs, "doc_id").join(items.withColumnRenamed("text", "quote"), "item_id")
    return both.selectExpr("doc_id", "item_id", f"{V.utf16_slice('text', 'start', 'end')} = {V.utf16('quote')} AS matches", f"CAST({V.utf16_length('quote')} AS BIGINT) AS units")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_key(read):
    """Composite keys that occur more than once."""
    return tabular.repeated_keys(read("lineitem", "l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS nth FROM lineitem)
WHERE nth > 1 GROUP BY 1, 2, 3, 4
""")
def duplicate_rows(read):
    """The rows after the first of their key, as an index of first rows leaves them out."""
    rows = read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    later = tabular.later_duplicates(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"])
    return later.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def dangling_anti(read):
    """References that lead nowhere."""
    return tabular.dangling(read("documents", "doc_id", "lang"), read("labels", "doc_id"), "doc_id")


@query("""
SELECT event_id, user_id, value, previous FROM (
  SELECT *, last_value(CASE WHEN value < 500 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events)
WHERE value < previous
""")
def value_order_window(read):
    """Values below the last valid one before them."""
    found = tabular.order_violations(read("events", "event_id", "user_id", "value"), "user_id", "event_id", "value", "value < 500")
    return found.select("event_id", "user_id", "value", "previous")


@query("""
SELECT conv_id, turn, n_chars, previous FROM (
  SELECT *, lag(n_chars) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_chars FROM conversations))
WHERE n_chars <= previous
""")
def sequence_order(read):
    """Turns that are not longer than the one before."""
    turns = read("conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))
    return tabular.order_violations(turns, "conv_id", "turn", "n_chars", strict=True).select("conv_id", "turn", "n_chars", "previous")


@query("""
SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(ts, event_id) AS at FROM events WHERE value IS NOT NULL GROUP BY user_id
""")
def last_valid_event(read):
    """Each ledger's last valid entry, which need not be its latest."""
    valid = read("events", "event_id", "user_id", "ts", "value").where("value IS NOT NULL").withColumnRenamed("ts", "at")
    return tabular.last_match(valid, "user_id", ["event_id"], "event_id", "at")


@query(r"""
SELECT page_id, CAST(length(html) AS BIGINT) AS units FROM pages WHERE regexp_matches(html, '(?i)<\s*/?\s*[a-z!][^>]*>|javascript\s*:|\bon[a-z]+\s*=')
""")
def active_markup(read):
    """Active content."""
    return read("pages", "page_id", "html").selectExpr("page_id", f"CAST({V.utf16_length('html')} AS BIGINT) AS units", f"html RLIKE '{V.ACTIVE}' AS active").where("active").drop("active")


@query("SELECT k AS name, CAST(count(*) AS BIGINT) AS n, k NOT IN ('k', 'v') AS unknown FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_keys(read):
    """Members of JSON objects, and which a closed schema would not know."""
    keys = read("events", "props").selectExpr(f"explode({V.keys('try_parse_json(props)')}) AS name")
    return keys.groupBy("name").agg(F.count("*").alias("n")).withColumn("unknown", ~F.col("name").isin("k", "v"))


@query("""
SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 90 THEN 'integer_out_of_range' END AS code FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90
""")
def json_integer_range(read):
    """The integer rule of the structural checks, on a member of a JSON column."""
    check = structure.integer(0, 90)(structure.At(V.get("try_parse_json(props)", "k"), "'$.k'"))
    return read("events", "event_id", "props").selectExpr("event_id", f"explode({check}) AS i").select("event_id", "i.code")


@query("""
SELECT a.l_orderkey AS l_orderkey, a.s = b.s AS same FROM
 (SELECT l_orderkey, list_sort(list(l_suppkey)) AS s FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, list_sort(list(l_partkey % 100 + 1)) AS s FROM lineitem GROUP BY 1) b ON a.l_orderkey = b.l_orderkey
""")
def multiset_equal(read):
    """Whether two sides have the same values equally often."""
    lines = read("lineitem", "l_orderkey", "l_suppkey", "l_partkey")
    return tabular.equal_multisets(lines.selectExpr("l_orderkey", "l_suppkey AS v"), lines.selectExpr("l_orderkey", "l_partkey % 100 + 1 AS v"), "l_orderkey", "v")


@query("SELECT sha256(text) AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def fingerprint_dup(read):
    """Digest comparison: texts with one SHA-256."""
    return tabular.repeated_keys(read("documents", "text").where("text IS NOT NULL").select(F.sha2("text", 256).alias("fingerprint")), "fingerprint")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def first_match(read):
    """The first event of a type."""
    return tabular.first_match(read("events", "event_id", "user_id", "value", "event_type").where("event_type = 'purchase'"), "user_id", ["event_id"], "event_id", "value")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def last_wins(read):
    """The last row of a key, ties broken."""
    return tabular.last_match(read("orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", "o_orderstatus")


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS total, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS f, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS o, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS p FROM orders GROUP BY 1")
def state_summary(read):
    """Totals by state."""
    by = [F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"]
    return read("orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority").agg(F.count("*").alias("total"), *by)


@query("SELECT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1")
def url_scheme(read):
    """URL rules: pages by scheme."""
    return read("pages", "url").groupBy(F.lower(F.try_parse_url("url", F.lit("PROTOCOL"))).alias("scheme")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def renderable_semi(read):
    """Renderable references: rows whose referent is in a state that may be shown."""
    return read("documents", "doc_id", "source").join(read("labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY 1, 2")
def cross_field(read):
    """P10 and the ordering rules after joins (J25-J27): lines that ship before their order."""
    lines, orders = read("lineitem", "l_orderkey", "l_linenumber", "l_shipdate"), read("orders", "o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') OR event_type IS NULL GROUP BY 1")
def enum_violation(read):
    """Values outside a closed set."""
    return read("events", "event_type").where(~F.coalesce(F.col("event_type").isin("click", "view", "purchase"), F.lit(False))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS units, CASE WHEN length(text) > 8000 THEN 'string_too_long' ELSE 'string_too_short' END AS code FROM documents WHERE length(text) > 8000 OR length(text) < 40")
def length_bounds(read):
    """String bounds, in UTF-16 units."""
    units = read("documents", "doc_id", "text").selectExpr("doc_id", f"CAST({V.utf16_length('text')} AS BIGINT) AS units")
    return units.where("units > 8000 OR units < 40").withColumn("code", F.when(F.col("units") > 8000, "string_too_long").otherwise("string_too_short"))


@query("""
WITH a AS (SELECT event_id AS id, event_type AS kind, CASE WHEN value < 100 THEN user_id END AS who FROM events),
b AS (SELECT event_id + 1 AS id, event_type AS kind, CASE WHEN value < 100 THEN user_id END AS who FROM events)
SELECT id, 'kind' AS field, a.kind AS declared, b.kind AS found FROM a JOIN b USING (id) WHERE a.kind IS DISTINCT FROM b.kind
UNION ALL SELECT id, 'who', CAST(a.who AS VARCHAR), CAST(b.who AS VARCHAR) FROM a JOIN b USING (id) WHERE a.who IS DISTINCT FROM b.who
""")
def null_safe_mismatch(read):
    """Fields in which a record differs from the one it should repeat."""
    events = read("events", "event_id", "event_type", "user_id", "value")
    a = events.selectExpr("event_id AS id", "event_type AS kind", "if(value < 100, user_id, NULL) AS who")
    return tabular.mismatches(a, a.withColumn("id", F.col("id") + 1), "id", ["kind", "who"])


@query("""
WITH found AS (SELECT l_orderkey AS id, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY 1),
declared AS (SELECT o_orderkey AS id, CAST(4 AS BIGINT) AS lines, CAST(o_orderkey % 5 AS BIGINT) AS suppliers FROM orders)
SELECT id, 'lines' AS field, CAST(d.lines AS VARCHAR) AS declared, CAST(f.lines AS VARCHAR) AS found FROM declared d JOIN found f USING (id) WHERE d.lines <> f.lines
UNION ALL SELECT id, 'suppliers', CAST(d.suppliers AS VARCHAR), CAST(f.suppliers AS VARCHAR) FROM declared d JOIN found f USING (id) WHERE d.suppliers <> f.suppliers
""")
def declared_vs_derived(read):
    """Declared totals against counted ones."""
    found = read("lineitem", "l_orderkey", "l_suppkey").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"))
    declared = read("orders", "o_orderkey").select(F.col("o_orderkey").alias("id"), F.lit(4).cast("long").alias("lines"), (F.col("o_orderkey") % 5).alias("suppliers"))
    return tabular.mismatches(declared, found, "id", ["lines", "suppliers"])


@query("SELECT l_orderkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) < 2")
def distinct_min(read):
    """Fewer distinct referents than needed."""
    return read("lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("suppliers")).where("suppliers < 2")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING NOT bool_or(o_orderstatus = 'P')")
def coverage(read):
    """Keys without a row of a required kind."""
    return tabular.lacking(read("orders", "o_custkey", "o_orderstatus"), "o_custkey", F.col("o_orderstatus") == "P")


@query("""
SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS first_at, min(event_id) FILTER (event_type = 'purchase') AS second_at FROM events GROUP BY 1
HAVING min(event_id) FILTER (event_type = 'purchase') <= min(event_id) FILTER (event_type = 'signup')
""")
def stage_order(read):
    """J21 with J22, J26 with J27: a later stage that comes first."""
    return tabular.stages_reversed(read("events", "event_id", "user_id", "event_type"), "user_id", "event_id", "event_type", "signup", "purchase")


@query("""
SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE NOT EXISTS (
  SELECT 1 FROM lineitem a WHERE a.l_returnflag = 'A' AND a.l_partkey = lineitem.l_partkey AND a.l_suppkey = lineitem.l_suppkey) GROUP BY 1, 2
""")
def existential_pair(read):
    """Rows whose pair of values no allowed row has."""
    lines = read("lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    return tabular.without_pair(lines, lines.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"]).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


_ISSUES = """
SELECT doc_id, 'string_too_long' AS code FROM documents WHERE length(text) > 8000
UNION ALL SELECT doc_id, 'dangling_label' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1
"""


def _issues(read) -> DataFrame:
    docs, labels = read("documents", "doc_id", "text"), read("labels", "doc_id", "toxic")
    long = docs.where(F.length("text") > 8000).select("doc_id", F.lit("string_too_long").alias("code"))
    loose = tabular.dangling(docs.select("doc_id"), labels, "doc_id").select("doc_id", F.lit("dangling_label").alias("code"))
    return tabular.issue_union(long, loose, labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("code")))


@query(f"SELECT code, CAST(count(*) AS BIGINT) AS n FROM ({_ISSUES}) GROUP BY 1")
def union_issues(read):
    """Union of issue streams."""
    return _issues(read).groupBy("code").agg(F.count("*").alias("n"))


@query(f"SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_issues, coalesce(n, 0) = 0 AS success FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_ISSUES}) GROUP BY 1) i ON d.doc_id = i.doc_id")
def verdicts(read):
    """A verdict per record."""
    from attestry.operators import engine

    issues = _issues(read).select(F.col("doc_id").alias("key"), "code")
    return engine.verdicts(read("documents", "doc_id").withColumnRenamed("doc_id", "key"), issues).select(F.col("key").alias("doc_id"), "n_issues", "success")


@query(f"SELECT doc_id, string_agg(line, chr(10) ORDER BY code) AS text FROM (SELECT doc_id, code, '$ [' || code || '] ' || code AS line FROM ({_ISSUES})) GROUP BY 1")
def formatted_issues(read):
    """Issues of a record as ordered lines."""
    from attestry.operators import engine

    issues = _issues(read).select(F.col("doc_id").alias("key"), F.lit("$").alias("path"), "code", F.col("code").alias("message"), F.array(F.lit(0)).alias("ord"))  # of one place: told apart by code
    return engine.format_issues(issues).withColumnRenamed("key", "doc_id")


@query("SELECT o_custkey, round(100.0 * count_if(o_orderstatus = 'F') / count(*), 4) AS percent FROM orders GROUP BY 1")
def progress_ratio(read):
    """The share that is done."""
    done = F.count_if(F.col("o_orderstatus") == "F")
    return read("orders", "o_custkey", "o_orderstatus").groupBy("o_custkey").agg(F.round(done * F.lit(100.0) / F.count("*"), 4).alias("percent"))


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'not connected') AS answer FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def default_lookup(read):
    """A look-up with a default."""
    return read("documents", "doc_id").join(read("labels", "doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("not connected")).alias("answer"))


@query("SELECT doc_id, CASE WHEN n_chars * 400 > 1048576 THEN format('{:,.1f} MB', n_chars * 400 / 1048576.0) ELSE greatest(1, CAST(floor(n_chars * 400 / 1024.0 + 0.5) AS BIGINT)) || ' KB' END AS label FROM documents")
def size_label(read):
    """Sizes for people."""
    return read("documents", "doc_id", "n_chars").select("doc_id", tabular.size_label(F.col("n_chars") * 400).alias("label"))


@query("SELECT page_id, substr(regexp_replace(trim(url), '(?i)^https?://', ''), 1, 62) AS label FROM pages")
def url_display(read):
    """URLs for people."""
    return read("pages", "page_id", "url").select("page_id", tabular.url_label(F.col("url")).alias("label"))


_CYCLES = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT {key} AS key, user_id AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS b FROM events),
reach AS (SELECT key, a, b FROM edges UNION SELECT r.key, r.a, e.b FROM reach r JOIN edges e ON r.key = e.key AND r.b = e.a),
looped AS (SELECT DISTINCT key, a FROM reach WHERE a = b)
SELECT DISTINCT r.key, r.a AS node FROM reach r JOIN looped l ON r.key = l.key AND r.b = l.a
"""


def _edges(read, key: str) -> DataFrame:
    return read("events", "event_type", "user_id", "props").selectExpr(f"{key} AS key", "user_id AS a", "CAST(get_json_object(props, '$.k') AS BIGINT) AS b")


@query(_CYCLES.format(key="event_type"))
def cycle_nodes(read):
    """Nodes on a cycle or leading to one, in the graph of each type of event."""
    return tabular.cycle_nodes(_edges(read, "event_type"))


@query(_CYCLES.format(key="'all'"))
def cycle_nodes_all(read):
    """As cycle_nodes, in one graph of all events."""
    return tabular.cycle_nodes(_edges(read, "'all'"))


@query("""
WITH RECURSIVE edges AS (
  SELECT DISTINCT event_type AS key, user_id AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS b FROM events),
reach AS (SELECT key, a, b FROM edges UNION SELECT r.key, r.a, e.b FROM reach r JOIN edges e ON r.key = e.key AND r.b = e.a)
SELECT r.key AS key, r.a AS node, min(r.b) AS component FROM reach r JOIN reach s ON s.key = r.key AND s.a = r.b AND s.b = r.a GROUP BY r.key, r.a
""")
def strong_components(read):
    """Nodes on a cycle, and the smallest node of those on the same ones, in the graph of each type of event."""
    return components.strong_components(_edges(read, "event_type"))


@query("""
SELECT o.o_orderkey AS o_orderkey, coalesce(p.o_orderkey, -1) AS prior, p.o_custkey IS DISTINCT FROM o.o_custkey AS other_owner FROM orders o LEFT JOIN orders p ON p.o_orderkey = o.o_orderkey - 7 WHERE p.o_custkey IS NULL OR p.o_custkey <> o.o_custkey
""")
def prior_self_join(read):
    """A record and the one it supersedes."""
    orders = read("orders", "o_orderkey", "o_custkey")
    prior = orders.select((F.col("o_orderkey") + 7).alias("next"), F.col("o_orderkey").alias("prior"), F.col("o_custkey").alias("owner"))
    both = orders.join(prior, F.col("o_orderkey") == F.col("next"), "left")
    return both.where(~F.col("owner").eqNullSafe(F.col("o_custkey"))).select("o_orderkey", F.coalesce("prior", F.lit(-1)).alias("prior"), (~F.col("owner").eqNullSafe(F.col("o_custkey"))).alias("other_owner"))


@query("""
SELECT c_custkey, field, n.n_name AS found FROM (
  SELECT c_custkey, 'home' AS field, c_nationkey AS ref FROM customer UNION ALL SELECT c_custkey, 'next', c_nationkey + 1 FROM customer) p LEFT JOIN nation n ON n.n_nationkey = p.ref
""")
def unpivoted_pointers(read):
    """Several pointers of a record, unpivoted and looked up in a small table."""
    pointers = read("customer", "c_custkey", "c_nationkey").selectExpr("c_custkey", "stack(2, 'home', c_nationkey, 'next', c_nationkey + 1) AS (field, ref)")
    names = read("nation", "n_nationkey", "n_name").selectExpr("n_nationkey AS ref", "n_name AS found")
    return pointers.join(names, "ref", "left").select("c_custkey", "field", "found")


@query("""
WITH done AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), touched AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT user_id FROM (SELECT * FROM done UNION ALL SELECT * FROM touched) GROUP BY 1 HAVING count(*) = 1
""")
def toggled_set(read):
    """A set of what is done, of which each touched member changes sides."""
    of = lambda kind: read("events", "user_id", "event_type").where(F.col("event_type") == kind)
    return tabular.toggled(of("purchase"), of("error"), ["user_id"])


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('purchase', 'error')")
def added_set(read):
    """Members added to a set, once each."""
    of = lambda kind: read("events", "user_id", "event_type").where(F.col("event_type") == kind)
    return tabular.added(of("purchase"), of("error"), ["user_id"])


@query("""
SELECT c_custkey, coalesce(o.s, 'none') AS status, coalesce(o.p, c_acctbal) AS amount FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1) o ON o_custkey = c_custkey
UNION ALL SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)), arg_max(o_totalprice, (o_orderdate, o_orderkey)) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) GROUP BY 1
""")
def upserted_state(read):
    """A table of states, in which the last change of a key replaces what it was."""
    state = read("customer", "c_custkey", "c_acctbal").select("c_custkey", F.lit("none").alias("status"), F.col("c_acctbal").alias("amount"))
    orders = read("orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return tabular.upserted(state, orders.selectExpr("o_custkey AS c_custkey", "o_orderstatus AS status", "o_totalprice AS amount", "o_orderdate", "o_orderkey"), ["c_custkey"], ["o_orderdate", "o_orderkey"])


for _f, _text in [*ledgers.QUERIES.values(), *cloud.QUERIES.values()]:
    query(_text)(_f)
for _name, (_f, _text) in streams.QUERIES.items():
    _queries[_name], _sql[_name] = _f, _text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
