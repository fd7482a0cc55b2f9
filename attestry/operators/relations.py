"""Relational rules: what the parts of a document must be to each other, as SQL over tables with one row per part.

Every table has the document's key, so every join is an equi-join on (key, id): nothing is joined across documents, and no document is
collected. The tables are cut from the parsed documents by posexplode, once for the checks of the parts (structure) and the rules here; each keeps the part as a VARIANT and the few
columns that joins need.

Every issue has an ord, an array of integers: its place in a walk through the document (see structure). The ranks of these rules follow on those of the checks of the same parts.

Documents are dealt out by key once. The tables of parts are cached, still dealt out so, and joins, windows and totals by (key, id) find their rows where
they are (see engine.computed).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import values as V
from attestry.operators import parts as P
from attestry.operators.structure import At, Check, Found, none, places

st = lambda name, v="v": V.string(V.get(v, name))


def _exploded(base: DataFrame, array: str, path: str, *columns: str, carried: tuple[str, ...] = ("key",), at: str = "idx") -> DataFrame:
    """One row per object of a VARIANT array: carried columns, idx (its place among the objects), raw (among all elements), v, path and the given SQL columns over v.

    at: which of the two places its path has.
    """
    objects = f"filter(transform({V.items(array)}, (e, i) -> named_struct('raw', i, 'v', e)), x -> {V.is_object('x.v')})"
    rows = base.selectExpr(*carried, f"posexplode({objects}) AS (idx, x)").selectExpr(*carried, "idx", "x.raw AS raw", "x.v AS v")
    return rows.selectExpr(*carried, "idx", "raw", "v", f"concat({path}, '[', {at}, ']') AS path", *columns)


def _members(parts: DataFrame, name: str, where: str = "TRUE", strings: bool = False) -> DataFrame:
    """One row per string in an array member: key, idx, raw, at, ref, path, and the part as v. Their places are those among all elements, or (strings) among the strings."""
    array = V.get("v", name)
    listed = parts.where(where).selectExpr("key", "idx", "raw", "v", "path", f"posexplode({V.strings(array) if strings else V.items(array)}) AS (at, item)")
    return listed.selectExpr("key", "idx", "raw", "at", "v", f"concat(path, '.{name}[', at, ']') AS path", f"{'item' if strings else V.string('item')} AS ref").where("ref IS NOT NULL")


def _first(parts: DataFrame) -> DataFrame:
    """The first part with each well-formed id."""
    return parts.where(f"nth = 1 AND id RLIKE '{V.ID}'").drop("nth")


def _last(parts: DataFrame) -> DataFrame:
    """The last part with each id."""
    return parts.where("id IS NOT NULL").drop("nth").selectExpr("*", "row_number() OVER (PARTITION BY key, id ORDER BY idx DESC) AS nth").where("nth = 1").drop("nth")


def _again(parts: DataFrame, *at: int) -> DataFrame:
    """Parts whose well-formed id a former part of the document has."""
    return parts.where(f"nth > 1 AND id RLIKE '{V.ID}'").selectExpr("key", "concat(path, '.id') AS path", "'duplicate_id' AS code", f"{places(*at, 'idx')} AS ord")


class Rules:
    """Collects issue tables (key, path, code), and the cached tables that they are computed from."""

    def __init__(self, spark):
        self.spark, self.tables, self.cached = spark, [], []

    def keep(self, parts: DataFrame) -> DataFrame:
        """Computed once, and kept dealt out by key until the issues are there; what is lost is computed again."""
        self.cached.append(parts.persist())
        return self.cached[-1]

    def numbered(self, base: DataFrame, array: str, path: str, check: Check, ranks: tuple, *columns: str) -> DataFrame:
        """The objects of a VARIANT array with the given columns, as _exploded has them, and with how many of the document have had their id so far (nth). All elements are kept, and checked with these ranks above."""
        odd = f"filter(transform({V.read_as(array, 'array<struct<>>')}, (e, i) -> if(e IS NULL, i, NULL)), i -> i IS NOT NULL)"
        rows = base.selectExpr("key", f"coalesce({odd}, CAST(array() AS array<int>)) AS odd", f"posexplode({V.items(array)}) AS (raw, v)")
        placed = rows.selectExpr("key", "raw", "v", f"{V.is_object('v')} AS whole", "if(size(odd) = 0, raw, raw - size(filter(odd, i -> i < raw))) AS idx")
        own = placed.selectExpr("*", f"concat({path}, '[', idx, ']') AS path", *columns)
        kept = self.keep(own.selectExpr("*", "row_number() OVER (PARTITION BY key, id ORDER BY idx) AS nth"))
        self.tables.append(structural(kept.selectExpr("key", "raw", "v", f"concat({path}, '[', raw, ']') AS path"), check(At("v", "path", (*ranks, "raw")))))
        return kept.where("whole").drop("whole")

    def release(self) -> None:
        for table in self.cached:
            table.unpersist()

    def add(self, query: str, **tables: DataFrame) -> None:
        self.tables.append(self.spark.sql(query, **tables).select("key", "path", "code", "ord"))

    def raised(self, rows: DataFrame, at: tuple, *rules: tuple[str, str, str] | None) -> None:
        """(condition, path SQL, code): several issues from one pass over the rows. at: the ranks (numbers or SQL) above a rule's own, which is its number; None leaves one out."""
        listed = ", ".join(f"CASE WHEN {rule[0]} THEN named_struct('path', {rule[1]}, 'code', '{rule[2]}', 'ord', {places(*at, n)}) END" for n, rule in enumerate(rules) if rule)
        wrong = " OR ".join(f"({rule[0]})" for rule in rules if rule)
        self.tables.append(rows.where(wrong).selectExpr("key", f"explode(filter(array({listed}), i -> i IS NOT NULL)) AS i").select("key", "i.path", "i.code", "i.ord"))


def structural(rows: DataFrame, check: Found) -> DataFrame:
    """The issues of the parts that may have any."""
    return rows.where(f"NOT {none(check)}").selectExpr("key", f"explode({check}) AS i").select("key", "i.path", "i.code", "i.ord")


def joined(left: DataFrame, right: DataFrame, ref: str, prefix: str, columns: dict[str, str], key: str = "id") -> DataFrame:
    """Left join of (key, ref) to a table of first parts: prefix_found and the given columns of the right."""
    picked = right.selectExpr("key AS _k", f"{key} AS _r", f"TRUE AS {prefix}_found", *(f"{sql} AS {prefix}_{name}" for name, sql in columns.items()))
    return left.join(picked, (left["key"] == picked["_k"]) & F.expr(ref).eqNullSafe(picked["_r"]), "left").drop("_k", "_r")


def canonical(base: DataFrame, v: str, path: str, above: tuple, rules: Rules) -> dict[str, DataFrame]:
    """Sources, revisions and segments of documents whose context is an object; first-wins tables of each."""
    base = base.where(V.is_object(v))
    listed = lambda name: (base, V.get(v, name), f"'{path}.{name}'", P.CONTEXT_ELEMENTS[name], (*above, P.CONTEXT_RANKS[name]))
    src = rules.numbered(*listed("sources"), f"{st('id')} AS id")
    rev = rules.numbered(*listed("sourceRevisions"), f"{st('id')} AS id", f"{st('sourceId')} AS source", f"{st('supersedesRevisionId')} AS prior", f"{st('status')} AS status", f"{V.string(V.get(V.get('v', 'fingerprint'), 'value'))} AS print")
    seg = rules.numbered(
        *listed("sourceSegments"), f"{st('id')} AS id", f"{st('sourceId')} AS source", f"{st('sourceRevisionId')} AS revision", f"{st('text')} AS text", f"to_json({V.get('v', 'index')}) AS place",
        f"{V.string(V.get(V.get('v', 'extraction'), 'method'))} AS method", f"{V.string(V.get(V.get('v', 'anchor'), 'kind'))} AS anchor", f"{V.number(V.get(V.get('v', 'anchor'), 'page'))} AS page",
    )
    rules.tables += [_again(x, *above, 7 + n) for n, x in enumerate((src, rev, seg))]
    sources, revisions, segments = _first(src), _first(rev), _first(seg)

    r = joined(joined(revisions, sources, "source", "s", {}), revisions, "prior", "p", {"source": "source"})
    at = f"'{path}.sourceRevisions'"
    rules.raised(
        r, (*above, 10, "idx"), ("s_found IS NULL", at, "dangling_source"), ("coalesce(prior, '') <> '' AND p_found IS NULL", at, "dangling_revision"),
        ("coalesce(prior, '') <> '' AND p_found AND NOT p_source <=> source", at, "revision_source_mismatch"), ("prior = id", at, "revision_cycle"),
    )
    g = joined(joined(segments, sources, "source", "s", {"pages": V.number(V.get("v", "pageCount"))}), revisions, "revision", "r", {"source": "source"})
    at = f"'{path}.sourceSegments'"
    rules.raised(
        g, (*above, 11, "idx"), ("s_found IS NULL", at, "dangling_source"), ("r_found IS NULL", at, "dangling_revision"), ("r_found AND NOT r_source <=> source", at, "segment_revision_mismatch"), None,
        ("anchor IN ('page_text', 'page_region') AND page > s_pages", at, "page_out_of_bounds"), ("method = 'ocr' AND NOT anchor <=> 'page_region'", at, "ocr_region_required"),
    )
    rules.add(f"SELECT key, {at} AS path, 'duplicate_segment_index' AS code, {places(*above, 11, 'idx', 3)} AS ord FROM (SELECT key, idx, row_number() OVER (PARTITION BY key, revision, place ORDER BY idx) AS nth FROM {{s}}) WHERE nth > 1", s=segments)
    return {"sources": sources, "revisions": revisions, "segments": segments}


RENDERABLE = f"coalesce({V.string(V.get(V.get('v', 'validation'), 'state'))} IN ('accepted', 'needs_review'), FALSE)"


def analysis(base: DataFrame, a: str, path: str, above: tuple, known: dict[str, DataFrame], validated: bool, product: str, rules: Rules) -> dict[str, DataFrame]:
    """base: key and the analysis. Claims, actions, questions, pointers and sections."""
    base = base.where(V.is_object(a))
    shown = RENDERABLE if validated else "TRUE"
    own = base.selectExpr("key", "0 AS idx", "0 AS raw", f"{a} AS v", f"'{path}' AS path")
    analyzed = rules.keep(_members(own, "sourceRevisionIds", strings=True))
    rules.raised(joined(analyzed, known["revisions"], "ref", "r", {"status": "status"}), (*above, 6, "at"), ("r_found IS NULL", "path", "dangling_revision"), ("r_found AND NOT r_status <=> 'active'", "path", "stale_revision"))
    allowed = analyzed.select("key", "ref").distinct()

    checks = P.analysis_elements(validated, product)
    ranks = lambda name: (*above, P.ANALYSIS_RANKS[name] + 1)  # noqa: E731  # elements come after their array
    clm, act = (rules.numbered(base, V.get(a, k), f"'{path}.{k}'", checks[k], ranks(k), f"{st('id')} AS id", f"{st('provenance')} AS provenance", f"{shown} AS shown") for k in ("claims", "actions"))
    rules.tables += [_again(clm, *above, 15), _again(act, *above, 16)]
    claims, actions = _first(clm), _first(act)
    claim_columns = {"provenance": "provenance", "shown": "shown", "v": "v"}

    # evidence, of claims and of the alternatives of conflicts: where it is, as the check of a claim comes by it
    listed = lambda kinds: clm.where(f"provenance IN ({kinds})").selectExpr("key", "v AS c", f"concat('{path}.claims[', raw, ']') AS of", "raw AS way")
    direct = _exploded(listed("'source_fact', 'inference', 'not_confirmed'"), V.get("c", "evidence"), "concat(of, '.evidence')", f"{places(*above, 9, 'way', 0, 1, 1, 'raw')} AS ord", carried=("key", "of", "way"), at="raw")
    others = _exploded(listed("'conflict'"), V.get("c", "alternatives"), "concat(of, '.alternatives')", carried=("key", "of", "way"), at="raw").selectExpr("key", "v AS c", "path AS of", "way", "raw AS side")
    indirect = _exploded(others, V.get("c", "evidence"), "concat(of, '.evidence')", f"{places(*above, 9, 'way', 0, 1, 1, 'side', 2, 1, 'raw')} AS ord", carried=("key", "of", "way", "side"), at="raw").drop("side")
    end = lambda k: V.safe_integer(V.get(V.get("v", "span"), k))
    cited = direct.unionByName(indirect).selectExpr("key", "path", "ord", f"{st('sourceId')} AS source", f"{st('sourceRevisionId')} AS revision", f"{st('segmentId')} AS segment", f"{st('quote')} AS quote", f"{end('start')} AS start", f"{end('end')} AS end").where("source IS NOT NULL AND revision IS NOT NULL AND segment IS NOT NULL")
    e = joined(cited, known["sources"], "source", "s", {})
    e = joined(e, known["revisions"], "revision", "r", {"status": "status"})
    e = joined(e, known["segments"], "segment", "g", {k: k for k in ("source", "revision", "method", "anchor")})
    e = joined(e, allowed, "revision", "a", {}, key="ref")
    rules.raised(
        e, ("*ord", 90), ("s_found IS NULL", "concat(path, '.sourceId')", "dangling_source"), ("r_found IS NULL", "concat(path, '.sourceRevisionId')", "dangling_revision"), ("a_found IS NULL", "concat(path, '.sourceRevisionId')", "revision_not_analyzed"),
        ("g_found IS NULL", "concat(path, '.segmentId')", "dangling_segment"), ("r_found AND NOT r_status <=> 'active'", "concat(path, '.sourceRevisionId')", "stale_revision"),
        ("g_found AND NOT (g_source <=> source AND g_revision <=> revision)", "path", "evidence_source_mismatch"), ("g_method = 'ocr' AND NOT g_anchor <=> 'page_region'", "path", "ocr_region_required"),
    )
    quoted = cited.where("quote IS NOT NULL").selectExpr("key", "segment", "path", "ord", "start", "end", "quote")
    rules.tables.append(_spans(quoted, known["segments"], (".span.end", "span_out_of_bounds", 7), (".quote", "quote_mismatch", 8)))

    def refer(refs: DataFrame, at: tuple, *more: tuple[str, str, str]) -> None:
        """References to claims: dangling, blocked, and rules on what they find."""
        rules.raised(joined(refs, claims, "ref", "c", claim_columns), (*above, *at), ("c_found IS NULL", "path", "dangling_claim"), ("c_found AND NOT c_shown", "path", "blocked_claim_reference"), *more)

    bases = _members(clm.where("provenance = 'inference'"), "basisClaimIds", strings=True)
    refer(bases, (17, "idx", "at"), ("c_found AND NOT coalesce(c_provenance IN ('source_fact', 'inference'), FALSE)", "path", "invalid_inference_basis"))
    refer(_members(clm.where("provenance = 'suggestion'"), "basisClaimIds", strings=True), (17, "idx", "at"), ("c_provenance = 'suggestion'", "path", "suggestion_chain"))
    rules.tables.append(_back_edges(clm).selectExpr("key", f"'{path}.claims' AS path", "'claim_cycle' AS code", f"{places(*above, 18, 'nth')} AS ord"))

    refer(_members(act, "basisClaimIds"), (19, "idx", 0, "at"), (f"c_found AND {st('provenance')} = 'document_requirement' AND NOT c_provenance <=> 'source_fact'", "path", "requirement_needs_source_fact"))
    timing = V.get("v", "timing")
    timed = act.selectExpr("key", "idx", "v", "path AS own", "concat(path, '.timing.basisClaimId') AS path", f"{V.string(V.get(timing, 'basisClaimId'))} AS ref", f"{V.string(V.get(timing, 'kind'))} AS kind", f"{V.string(V.get(timing, 'date'))} AS date").where("ref IS NOT NULL")
    dates = f"transform(filter({V.records(V.get('c_v', 'normalizedValues'))}, x -> {V.string(V.get('x', 'kind'))} = 'date'), x -> {V.string(V.get('x', 'value'))})"
    refer(
        timed, (19, "idx", 1), (f"NOT array_contains({V.strings(V.get('v', 'basisClaimIds'))}, ref)", "path", "timing_basis_missing"), ("kind = 'calendar_date' AND NOT c_provenance <=> 'source_fact'", "path", "date_needs_source_fact"),
        (f"kind = 'calendar_date' AND c_provenance = 'source_fact' AND date IS NOT NULL AND NOT coalesce(array_contains({dates}, date), FALSE)", "concat(own, '.timing.date')", "timing_value_mismatch"),
    )
    refer(_members(act.selectExpr("key", "idx", "raw", f"{V.get('v', 'consequence')} AS v", "concat(path, '.consequence') AS path"), "basisClaimIds"), (19, "idx", 2, "at"))
    refer(_members(_exploded(base, V.get(a, "questions"), f"'{path}.questions'"), "basisClaimIds"), (20, "idx", "at"))

    doc = V.get("v", "document")
    pointer = ", ".join(f"{n}, '{k}', {V.string(V.get(doc, k))}" for n, k in enumerate(("titleClaimId", "purposeClaimId", "actionRequiredClaimId", "nearestDeadlineClaimId")))
    pointers = own.selectExpr("key", "idx", "v", f"stack(4, {pointer}) AS (place, name, ref)").where("ref IS NOT NULL").selectExpr("key", "idx", "v", "place", "name", "ref", f"concat('{path}.document.', name) AS path")
    refer(
        pointers, (21, "place"), ("c_provenance = 'suggestion'", "path", "invalid_document_pointer"),
        ("name = 'nearestDeadlineClaimId' AND c_found AND NOT coalesce(c_provenance IN ('source_fact', 'inference'), FALSE)", "path", "invalid_deadline_pointer"),
    )

    section = own.selectExpr("key", "idx", "raw", f"{V.get('v', 'sections')} AS v", f"'{path}.sections' AS path")
    for n, (name, wanted) in enumerate((("briefClaimIds", None), ("factClaimIds", "'source_fact', 'inference'"), ("attentionClaimIds", None), ("missingInformationClaimIds", "'not_confirmed'"), ("conflictClaimIds", "'conflict'"))):
        more = [(f"c_found AND NOT coalesce(c_provenance IN ({wanted}), FALSE)", "path", "wrong_section_provenance")] if wanted else []
        refer(_members(section, name), (23, n, "at"), *more, *([("c_provenance = 'suggestion'", "path", "suggestion_in_brief")] if name == "briefClaimIds" else []))
    primary = own.selectExpr("key", f"'{path}.document.primaryActionId' AS path", f"{V.string(V.get(doc, 'primaryActionId'))} AS ref", "22 AS place", "0 AS at").where("ref IS NOT NULL")
    planned = _members(section, "planActionIds").selectExpr("key", "path", "ref", "24 AS place", "at").unionByName(primary)
    rules.raised(joined(planned, actions, "ref", "c", {"shown": "shown"}), (*above, "place", "at"), ("c_found IS NULL", "path", "dangling_action"), ("c_found AND NOT c_shown", "path", "blocked_action_reference"))
    return {"claims": clm, "actions": act, "analyzed": allowed}


def _spans(cited: DataFrame, segments: DataFrame, over: tuple, differs: tuple) -> DataFrame:
    """cited: key, segment, path, ord, start, end, quote. Issues of citations that end beyond their segment, or whose quote is not what stands there.

    The citations of a segment are gathered, each with a digest in place of its quote, and settled together: a segment's text meets them once, and is made into UTF-16 once, however often
    it is cited. over, differs: what an issue's path ends with, its code and its rank, after ord and 90.
    """
    span = f"struct(path, ord, start, end, sha2({V.utf16('quote')}, 256) AS digest)"
    gathered = cited.where("start IS NOT NULL AND end IS NOT NULL").selectExpr("key", "segment", f"{span} AS s").groupBy("key", "segment").agg(F.collect_list("s").alias("spans"))
    met = joined(gathered, segments, "segment", "g", {"text": "text"}).where("g_text IS NOT NULL")
    issue = lambda rule: f"named_struct('path', concat(s.path, '{rule[0]}'), 'code', '{rule[1]}', 'ord', {places('*s.ord', 90, rule[2])})"
    place = lambda x: f"if({x} < 0, greatest(0D, octet_length(u) / 2 + {x}), least({x}, octet_length(u) / 2))"  # noqa: E731  # from the end, if it is negative
    low = f"least({place('s.start')}, {place('s.end')})"
    stands = f"sha2(substring(u, CAST(2 * {low} + 1 AS INT), CAST(2 * ({place('s.end')} - {low}) AS INT)), 256)"
    settled = f"filter(transform(spans, s -> CASE WHEN 2 * s.end > octet_length(u) THEN {issue(over)} WHEN NOT {stands} <=> s.digest THEN {issue(differs)} END), i -> i IS NOT NULL)"
    return met.selectExpr("key", f"explode(transform(array({V.utf16('g_text')}), u -> {settled})[0]) AS i").select("key", "i.path", "i.code", "i.ord")


def _back_edges(claims: DataFrame) -> DataFrame:
    """key, node, nth: an inference that a depth-first walk over bases meets while it is still on the way down from it, once for every such meeting.

    Of inferences with one id the last one's bases count, at the place of the first. A walk is over one document's inferences, a part of one row.
    """
    inferences = claims.where("provenance = 'inference' AND id IS NOT NULL")
    place = inferences.groupBy("key", "id").agg(F.min("idx").alias("place"))
    last = _last(inferences).join(place, ["key", "id"])
    listed = last.selectExpr("key", "place", "id AS a", f"posexplode({V.items(V.get('v', 'basisClaimIds'))}) AS (at, item)").selectExpr("key", "place", "a", "at", f"{V.string('item')} AS b")
    among = listed.join(last.selectExpr("key", "id AS b"), ["key", "b"], "left_semi")

    def walk(graph: pd.DataFrame) -> pd.DataFrame:
        ordered = graph.sort_values(["place", "at"])
        after = {a: list(own) for a, own in ordered.groupby("a", sort=False)["b"]}
        met, done, down = [], set(), set()
        for start in after:
            way = [] if start in done else [(start, iter(after[start]))]
            down.update(node for node, _ in way)
            while way:
                node, rest = way[-1]
                to = next(rest, None)
                if to is None:
                    way.pop()
                    down.discard(node)
                    done.add(node)
                elif to in down:
                    met.append(to)
                elif to not in done and to in after:
                    way.append((to, iter(after[to])))
                    down.add(to)
        return pd.DataFrame({"key": pd.Series([graph["key"].iloc[0]] * len(met), dtype=object), "node": pd.Series(met, dtype=object), "nth": pd.Series(range(len(met)), dtype="int32")})

    return among.groupBy("key").applyInPandas(walk, "key string, node string, nth int")


def _completed(events: DataFrame, kind: str) -> DataFrame:
    """The first completed event of a type for each related id."""
    own = events.where(f"type = '{kind}' AND status = 'completed' AND related IS NOT NULL")
    return own.groupBy("key", "related").agg(F.min_by(F.struct("at", "sequence", "location", "actor"), "idx").alias("e")).select("key", "related", "e.*")


def receipt(base: DataFrame, above: tuple, known: dict[str, DataFrame], parts: dict[str, DataFrame], product: str, rules: Rules) -> dict[str, DataFrame]:
    """base: key, analysis and receipt. Events, consents, transfers, retention, components and totals."""
    base = base.where(V.is_object("receipt"))
    path = "$.receipt"
    r = lambda name: V.get("receipt", name)
    checks = P.receipt_elements(product)
    listed = lambda name: (base, r(name), f"'{path}.{name}'", checks[name], (*above, P.RECEIPT_RANKS[name] + 1))
    ev = rules.numbered(
        *listed("events"), f"{st('id')} AS id", f"{V.number(V.get('v', 'sequence'))} AS sequence", f"{st('occurredAt')} AS at", f"{V.instant(st('occurredAt'))} AS instant", f"{st('type')} AS type", f"{st('status')} AS status",
        f"{st('relatedId')} AS related", f"{V.string(V.get(V.get('v', 'actor'), 'location'))} AS location", f"{V.is_object(V.get('v', 'actor'))} AS actor",
    )
    rules.tables.append(_again(ev, *above, 6))
    before = "OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    seen = ev.selectExpr("*", f"coalesce(last(sequence, TRUE) {before}, -1) AS last_sequence", f"last(instant, TRUE) {before} AS last_instant")
    rules.raised(seen, (*above, 7, "idx"), ("sequence <= last_sequence", "concat(path, '.sequence')", "event_order"), ("instant < last_instant", "concat(path, '.occurredAt')", "event_time_order"))
    closing = ev.where("instant IS NOT NULL").groupBy("key").agg(F.max_by("instant", "idx").alias("latest"))
    head = base.selectExpr("key", f"{V.instant(V.string(r('createdAt')))} AS created", f"{V.string(r('processingMode'))} AS mode", f"{V.string(V.get('analysis', 'analysisId'))} AS analysis_id", f"{V.string(V.get('analysis', 'knowledgeMode'))} AS knowledge", f"size({V.items(r('externalReferences'))}) AS outside", f"size({V.records(r('transfers'))}) AS sent", f"transform({V.records(r('components'))}, c -> {V.string(V.get('c', 'component'))}) AS kinds")
    once = [
        (8, "created < latest", "createdAt", "receipt_time_order"), (22, "mode IN ('sample', 'browser_local', 'desktop_local') AND sent > 0", "transfers", "unexpected_external_transfer"),
        (23, "mode IN ('cloud_redacted', 'cloud_full') AND sent = 0", "transfers", "missing_external_transfer"), (31, f"NOT coalesce(array_contains(kinds, '{product}'), FALSE)", "components", f"{product}_version_missing"),
        (32, "NOT coalesce(array_contains(kinds, 'citation_validator'), FALSE)", "components", "validator_version_missing"), (36, "knowledge = 'source_only' AND outside > 0", "externalReferences", "external_reference_in_source_only_mode"),
    ]
    by_rank = {rank: (condition, f"'{path}.{member}'", code) for rank, condition, member, code in once}
    rules.raised(head.join(closing, "key", "left"), above, *(by_rank.get(rank) for rank in range(max(by_rank) + 1)))

    named = head.where("coalesce(analysis_id, '') <> ''")
    made, checked = _completed(ev, "analysis_completed"), _completed(ev, "validation_completed")
    columns = {"at": "at", "sequence": "sequence", "location": "location", "actor": "actor"}
    both = joined(joined(named, made, "analysis_id", "m", columns, key="related"), checked, "analysis_id", "c", columns, key="related")
    at = f"'{path}.events'"
    rules.raised(both, above, *[None] * 9, ("m_found IS NULL", at, "analysis_event_missing"), ("c_found IS NULL", at, "validation_event_missing"), ("c_location = 'provider'", at, "untrusted_validation_actor"), ("c_sequence <= m_sequence", at, "validation_before_analysis"))
    attested = parts["claims"].selectExpr("key", "v", "0 AS side", "idx").unionByName(parts["actions"].selectExpr("key", "v", "1 AS side", "idx")).where(V.is_object(V.get("v", "validation")))
    timed = attested.join(both.where("c_at IS NOT NULL").select("key", "c_at"), "key")
    rules.raised(timed, (*above, 13, "side", "idx"), (f"NOT {V.string(V.get(V.get('v', 'validation'), 'validatedAt'))} <=> c_at", at, "validation_time_mismatch"))

    con = rules.numbered(*listed("consentRecords"), f"{st('id')} AS id", f"{st('recordedAt')} AS recorded")
    rules.tables.append(_again(con, *above, 16))
    rules.raised(joined(con, _completed(ev, "consent_recorded"), "id", "e", {"at": "at"}, key="related"), (*above, 17, "idx"), ("e_found IS NULL", "path", "consent_event_missing"), ("e_found AND NOT e_at <=> recorded", "concat(path, '.recordedAt')", "consent_event_time_mismatch"))

    tra = rules.numbered(*listed("transfers"), f"{st('id')} AS id", f"{st('consentId')} AS consent", f"{st('startedAt')} AS started", f"{st('completedAt')} AS completed", f"{st('executionLocation')} AS place")
    rules.tables.append(_again(tra, *above, 20))
    t = joined(tra, _first(con), "consent", "k", {"v": "v", "recorded": "recorded"})
    t = joined(t, _completed(ev, "transfer_started"), "id", "b", columns, key="related")
    t = joined(t, _completed(ev, "transfer_completed"), "id", "d", columns, key="related")
    t = t.join(head.select("key", "mode"), "key")
    same = lambda k: f"to_json({V.get('v', k)}) <=> to_json({V.get('k_v', k)})"
    print_of = lambda v, k: f"if({V.string(V.get(V.get(v, k), 'algorithm'))} = 'sha-256', {V.string(V.get(V.get(v, k), 'value'))}, NULL)"
    whole = "array('full_file', 'page_images', 'extracted_text')"
    categories = V.strings(V.get("v", "contentCategories"))
    rules.raised(
        t, (*above, 21, "idx"), ("k_found IS NULL", "concat(path, '.consentId')", "transfer_without_consent"),
        *((f"k_found AND NOT {same(k)}", f"concat(path, '.{k}')", "consent_mismatch") for k in ("recipient", "provider", "model")),
        *((f"k_found AND NOT {V.same_multiset(V.get('v', k), V.get('k_v', k))}", f"concat(path, '.{k}')", "consent_mismatch") for k in ("sourceRevisionIds", "segmentIds", "contentCategories", "redactions")),
        (f"k_found AND NOT {print_of('v', 'payloadDigest')} <=> {print_of('k_v', 'previewDigest')}", "concat(path, '.payloadDigest')", "payload_digest_mismatch"),
        (f"{V.instant('started')} < {V.instant('k_recorded')}", "concat(path, '.startedAt')", "transfer_before_consent"),
        ("b_found IS NULL", "path", "transfer_event_missing"), ("b_found AND NOT b_at <=> started", "concat(path, '.startedAt')", "transfer_event_time_mismatch"),
        ("completed IS NULL", "concat(path, '.completedAt')", "transfer_completion_required"), (f"{V.instant('completed')} < {V.instant('started')}", "concat(path, '.completedAt')", "transfer_time_order"),
        ("completed IS NOT NULL AND d_found IS NULL", "path", "transfer_completion_event_missing"), ("completed IS NOT NULL AND d_found AND NOT d_at <=> completed", "concat(path, '.completedAt')", "transfer_event_time_mismatch"),
        ("completed IS NOT NULL AND d_actor AND NOT d_location <=> place", "path", "transfer_actor_mismatch"), ("completed IS NOT NULL AND d_sequence <= b_sequence", "path", "transfer_event_order"),
    )
    rules.raised(
        t, (*above, 24, "idx"), (f"mode = 'cloud_redacted' AND arrays_overlap({categories}, {whole})", "concat(path, '.contentCategories')", "redacted_mode_content_mismatch"),
        (f"mode = 'cloud_redacted' AND (NOT array_contains({categories}, 'redacted_text') OR size({V.items(V.get('v', 'redactions'))}) = 0)", "path", "redacted_mode_disclosure_missing"),
        (f"mode = 'cloud_full' AND NOT arrays_overlap({categories}, {whole})", "concat(path, '.contentCategories')", "full_mode_content_mismatch"),
    )

    ret = rules.numbered(*listed("retention"), f"{st('id')} AS id", f"{st('eventId')} AS event", f"{st('state')} AS state", f"{st('recordedAt')} AS recorded")
    rules.tables.append(_again(ret, *above, 27))
    n = joined(ret.where("event IS NOT NULL"), _first(ev), "event", "e", {k: k for k in ("type", "status", "at", "actor", "location", "related")})
    n = joined(joined(n, parts["analyzed"], "e_related", "a", {}, key="ref"), tra.where("id IS NOT NULL").select("key", "id").distinct(), "e_related", "t", {})
    expected = "element_at(map('deletion_requested', 'deletion_requested', 'provider_reported_deleted', 'deletion_reported', 'locally_cleared', 'local_cleanup_completed'), state)"
    at = "concat(path, '.eventId')"
    cleared, gone = "e_found AND state = 'locally_cleared'", "e_found AND state = 'provider_reported_deleted'"
    rules.raised(
        n, (*above, 28, "idx"), ("e_found IS NULL", at, "dangling_event"), (f"e_found AND {expected} IS NOT NULL AND NOT e_type <=> {expected}", at, "retention_event_mismatch"), ("e_found AND NOT e_status <=> 'completed'", at, "retention_event_not_completed"),
        ("e_found AND NOT e_at <=> recorded", "concat(path, '.recordedAt')", "retention_event_time_mismatch"), (f"{cleared} AND NOT coalesce(e_location IN ('browser', 'device'), FALSE)", at, "retention_actor_mismatch"), (f"{cleared} AND a_found IS NULL", at, "retention_subject_mismatch"),
        (f"{gone} AND NOT e_location <=> 'provider'", at, "retention_actor_mismatch"), (f"{gone} AND t_found IS NULL", at, "retention_subject_mismatch"),
    )

    state = V.string(V.get(V.get("v", "validation"), "state"))
    tally = lambda rows, names: rows.groupBy("key").agg(F.count("*").alias(names[0]), *(F.expr(f"count_if({state} = '{s}')").alias(k) for k, s in zip(names[1:], ("accepted", "needs_review", "blocked", "stale"), strict=True)))
    declared = base.where(V.is_object(r("validationSummary"))).selectExpr("key", *(f"{V.number(V.get(r('validationSummary'), k))} AS declared_{k}" for k in P.CLAIM_COUNTS + P.ACTION_COUNTS))
    counted = declared.join(tally(parts["claims"], P.CLAIM_COUNTS), "key", "left").join(tally(parts["actions"], P.ACTION_COUNTS), "key", "left")
    rules.raised(counted, (*above, 38), *((f"NOT declared_{k} <=> coalesce({k}, 0)", f"'{path}.validationSummary.{k}'", "summary_mismatch") for k in P.CLAIM_COUNTS + P.ACTION_COUNTS))

    # consents come before transfers; _members keeps which it was as raw
    records = con.selectExpr("key", "idx", "0 AS raw", "v", "path").unionByName(tra.selectExpr("key", "idx", "1 AS raw", "v", "path"))
    used = joined(joined(_members(records, "sourceRevisionIds"), known["revisions"], "ref", "r", {}), parts["analyzed"], "ref", "a", {}, key="ref")
    rules.raised(used, (*above, 39, "raw", "idx", 0, "at"), ("r_found IS NULL OR a_found IS NULL", f"'{path}'", "receipt_revision_mismatch"))
    shown = joined(_members(records, "segmentIds"), known["segments"], "ref", "g", {"revision": "revision"})
    rules.raised(
        shown, (*above, 39, "raw", "idx", 1, "at"), ("g_found IS NULL", f"'{path}'", "receipt_segment_mismatch"),
        (f"g_found AND NOT coalesce(array_contains({V.strings(V.get('v', 'sourceRevisionIds'))}, g_revision), FALSE)", f"'{path}'", "receipt_segment_revision_mismatch"),
    )
    return {"events": ev}


def corrections(base: DataFrame, known: dict[str, DataFrame], parts: dict[str, DataFrame], events: DataFrame, rules: Rules) -> None:
    """base: key, doc, analysis, receipt, corrections."""
    cor = _exploded(base, "corrections", "'$.corrections'", f"{st('id')} AS id", *(f"{st(k)} AS {n}" for k, n in (("sourceId", "source"), ("priorRevisionId", "prior"), ("resultingRevisionId", "resulting"), ("targetSegmentId", "segment"), ("originalText", "original"), ("createdAt", "created"))), at="raw")
    end = lambda k: V.safe_integer(V.get(V.get("v", "targetSpan"), k))
    columns = {k: k for k in ("source", "status", "prior", "print")}
    c = joined(joined(cor, known["sources"], "source", "s", {}), known["revisions"], "prior", "p", columns)
    c = joined(joined(c, known["revisions"], "resulting", "r", columns), known["segments"], "segment", "g", {"revision": "revision"})
    c = joined(c, _completed(events, "correction_recorded"), "id", "e", {"at": "at", "location": "location"}, key="related")
    at = lambda k: f"concat(path, '.{k}')"
    own = (10, "raw", 90)  # after the check of the correction itself
    rules.raised(
        c, own, ("s_found IS NULL", at("sourceId"), "dangling_source"), ("p_found IS NULL", at("priorRevisionId"), "dangling_revision"), ("p_found AND NOT p_status <=> 'superseded'", at("priorRevisionId"), "prior_revision_not_superseded"),
        ("r_found IS NULL", at("resultingRevisionId"), "dangling_revision"), ("r_found AND NOT r_status <=> 'active'", at("resultingRevisionId"), "resulting_revision_not_active"),
        ("p_found AND r_found AND NOT (p_source <=> r_source AND r_prior <=> prior)", "path", "correction_revision_mismatch"), ("p_found AND source IS NOT NULL AND NOT p_source <=> source", at("sourceId"), "correction_source_mismatch"),
        ("r_found AND source IS NOT NULL AND NOT r_source <=> source", at("sourceId"), "correction_source_mismatch"), ("p_found AND r_found AND p_print <=> r_print", "path", "unchanged_revision_fingerprint"),
        ("g_found IS NULL OR (p_found AND NOT g_revision <=> prior)", at("targetSegmentId"), "correction_segment_mismatch"),
        None, None, None, ("id IS NOT NULL AND e_found IS NULL", "path", "correction_event_missing"),
        ("e_found AND NOT e_at <=> created", at("createdAt"), "correction_event_time_mismatch"), ("e_found AND NOT coalesce(e_location IN ('browser', 'device'), FALSE)", "path", "correction_actor_mismatch"),
    )
    told = cor.selectExpr("key", "segment", "path", f"{places(10, 'raw')} AS ord", f"{end('start')} AS start", f"{end('end')} AS end", "original AS quote")
    rules.tables.append(_spans(told, known["segments"], (".targetSpan.end", "span_out_of_bounds", 10), (".originalText", "correction_text_mismatch", 11)))
    refs = f"if(provenance = 'conflict', flatten(transform({V.records(V.get('v', 'alternatives'))}, x -> {V.records(V.get('x', 'evidence'))})), {V.records(V.get('v', 'evidence'))})"
    latest = _last(parts["claims"]).selectExpr("key", "id", f"transform({refs}, x -> {V.string(V.get('x', 'sourceRevisionId'))}) AS cited")
    again = joined(_members(cor, "regeneratedClaimIds", strings=True), latest, "ref", "c", {"cited": "cited"})
    rules.raised(again, (*own, 12, "at"), ("c_found IS NULL", "path", "dangling_claim"), (f"c_found AND NOT exists(c_cited, x -> x <=> {st('resultingRevisionId')})", "path", "regenerated_claim_revision_mismatch"))

    from attestry.operators.structure import repeats

    ids = f"filter(transform({V.records('corrections')}, c -> {V.string(V.get('c', 'id'))}), s -> s IS NOT NULL)"
    rules.tables.append(base.selectExpr("key", f"explode({repeats(ids, At('corrections', chr(39) + '$.corrections' + chr(39), (11,)))}) AS i").select("key", "i.path", "i.code", "i.ord"))
    mode, run = V.string(V.get("receipt", "processingMode")), V.string(V.get("doc", "runMode"))
    listed = f"{V.is_array(V.get('receipt', 'correctionIds'))} AND array_sort({V.strings(V.get('receipt', 'correctionIds'))}) = array_sort({ids})"
    instant = lambda v: V.instant(V.string(V.get(v, "createdAt")))
    rules.raised(
        base, (), *[None] * 12, (f"{instant('doc')} < {instant('receipt')}", "'$.createdAt'", "pack_time_order"), (f"{V.is_object('receipt')} AND NOT coalesce({listed}, FALSE)", "'$.receipt.correctionIds'", "correction_receipt_mismatch"),
        (f"{run} = 'sample_fixture' AND NOT {mode} <=> 'sample'", "'$.receipt.processingMode'", "run_mode_mismatch"), (f"{run} = 'live' AND {mode} = 'sample'", "'$.receipt.processingMode'", "run_mode_mismatch"),
    )
