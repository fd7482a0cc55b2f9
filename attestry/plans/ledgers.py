"""Ledgers made of the driver's tables, checked by the engine, with SQL for the issues that they must have: key, path and code of each, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators import engine

_DIGEST = "named_struct('algorithm', 'sha-256', 'value', repeat('a', 64))"
_TIME = "'2024-01-01T00:00:00Z'"
_EXTRACTION = f"named_struct('method', 'manual', 'engine', 'table', 'version', '1', 'extractedAt', {_TIME})"


def _sources(pages: int) -> str:
    return f"array(named_struct('id', 'src.1', 'displayName', 'row', 'kind', 'file', 'mediaType', 'text/plain', 'pageCount', {pages}, 'origin', named_struct('kind', 'upload')))"


def _revisions(status: str) -> str:
    return f"array(named_struct('id', 'rev.1', 'sourceId', 'src.1', 'fingerprint', {_DIGEST}, 'createdAt', {_TIME}, 'status', {status}))"


def _segment(number: str, revision: str, index: str, text: str, page: str) -> str:
    return (
        f"named_struct('id', concat('seg.', {number}), 'sourceId', 'src.1', 'sourceRevisionId', {revision}, 'index', {index}, 'text', {text}, "
        f"'anchor', named_struct('kind', 'page_text', 'page', {page}, 'block', 0), 'extraction', {_EXTRACTION})"
    )


def order_contexts(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """key and raw: each order as a canonical context, with its lines as segments."""
    listed = lines.selectExpr("l_orderkey", "struct(l_linenumber, l_partkey, l_suppkey, l_quantity) AS l").groupBy("l_orderkey").agg({"l": "collect_list"}).toDF("l_orderkey", "ls")
    segment = _segment("l.l_linenumber", "if(l.l_suppkey % 10 = 0, 'rev.2', 'rev.1')", "l.l_linenumber DIV 2", "concat('Part ', l.l_partkey)", "CAST(l.l_quantity AS INT)")
    status = "CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'superseded' ELSE o_orderstatus END"
    both = orders.join(listed, orders["o_orderkey"] == listed["l_orderkey"], "left").selectExpr("o_orderkey", "o_orderstatus", "array_sort(ls) AS ls")
    segments = f"coalesce(transform(ls, l -> {segment}), array())"
    return both.selectExpr("CAST(o_orderkey AS STRING) AS key", f"to_json(named_struct('sources', {_sources(30)}, 'sourceRevisions', {_revisions(status)}, 'sourceSegments', {segments})) AS raw")


def ledger_contexts(read) -> DataFrame:
    """validate_context over every order: duplicates, dangling references, bounds, closed sets."""
    docs = order_contexts(read("orders", "o_orderkey", "o_orderstatus"), read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return engine.validate_context(docs).select("key", "path", "code")


CONTEXTS_SQL = """
WITH l AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS key, *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS idx
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY key, l_linenumber ORDER BY idx) AS nth FROM l),
first AS (SELECT *, row_number() OVER (PARTITION BY key, l_suppkey % 10 = 0, l_linenumber // 2 ORDER BY idx) AS same FROM n WHERE nth = 1)
SELECT CAST(o_orderkey AS VARCHAR) AS key, '$.sourceRevisions[0].status' AS path, 'invalid_enum' AS code FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '$.sourceSegments', 'too_few_items' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)
UNION ALL SELECT key, '$.sourceSegments[' || idx || '].id', 'duplicate_id' FROM n WHERE nth > 1
UNION ALL SELECT key, '$.sourceSegments', 'dangling_revision' FROM first WHERE l_suppkey % 10 = 0
UNION ALL SELECT key, '$.sourceSegments', 'page_out_of_bounds' FROM first WHERE l_quantity > 30
UNION ALL SELECT key, '$.sourceSegments', 'duplicate_segment_index' FROM first WHERE same > 1
"""

_CHECKED = "'materiality', 'material', 'normalizedValues', array()"


def document_drafts(docs: DataFrame) -> DataFrame:
    """key, raw and context: each document as a source of one segment, and five claims about it."""
    quoted = lambda text: f"array(named_struct('sourceId', 'src.1', 'sourceRevisionId', 'rev.1', 'segmentId', 'seg.1', 'quote', {text}, 'span', named_struct('start', 0, 'end', 20)))"
    claim = lambda n, provenance, more: f"to_json(named_struct('id', 'claim.{n}', 'provenance', '{provenance}', 'title', 'Claim', 'statement', 'A claim.', {_CHECKED}, {more}))"
    head, shifted = "substr(t, 1, 20)", "substr(t, 2, 20)"
    claims = [
        claim(1, "source_fact", f"'evidence', {quoted(head)}"),
        claim(2, "source_fact", f"'evidence', {quoted(shifted)}"),
        claim(3, "inference", f"'evidence', {quoted(head)}, 'basisClaimIds', array('claim.1', 'claim.4'), 'rationale', 'Both.'"),
        claim(4, "inference", f"'evidence', {quoted(head)}, 'basisClaimIds', array(CASE doc_id % 5 WHEN 0 THEN 'claim.3' WHEN 1 THEN 'claim.9' ELSE 'claim.2' END), 'rationale', 'One.'"),
        claim(5, "suggestion", "'basisClaimIds', array(if(doc_id % 7 = 0, 'claim.5', 'claim.1')), 'rationale', 'Why not.', 'sourceImposed', false, 'execution', 'manual_user_choice'"),
    ]
    document = "named_struct('documentType', 'notice', 'titleClaimId', if(doc_id % 4 = 0, 'claim.5', 'claim.1'), 'purposeClaimId', 'claim.2', 'actionRequiredClaimId', 'claim.1')"
    sections = "named_struct('briefClaimIds', array('claim.1'), 'factClaimIds', array('claim.1', 'claim.3'), 'attentionClaimIds', array(), 'missingInformationClaimIds', if(doc_id % 6 = 0, array('claim.2'), array()), 'conflictClaimIds', array(), 'planActionIds', if(doc_id % 8 = 0, array('action.1'), array()))"
    rest = f"to_json(named_struct('kind', 'ledger.model_draft', 'schemaVersion', '1.0.0', 'analysisId', 'analysis.1', 'knowledgeMode', 'source_only', 'sourceRevisionIds', array('rev.1'), 'document', {document}, 'actions', array(), 'questions', array(), 'sections', {sections}))"
    listed = ", ',', ".join(claims)
    raw = f"""concat(substr({rest}, 1, length({rest}) - 1), ',"claims":[', {listed}, ']}}')"""
    context = f"to_json(named_struct('sources', {_sources(1)}, 'sourceRevisions', {_revisions(chr(39) + 'active' + chr(39))}, 'sourceSegments', array({_segment('1', chr(39) + 'rev.1' + chr(39), '0', 't', '1')})))"
    return docs.selectExpr("doc_id", "coalesce(text, '') AS t").selectExpr("CAST(doc_id AS STRING) AS key", f"{raw} AS raw", f"{context} AS context")


def ledger_drafts(read) -> DataFrame:
    """validate_draft over every document: quotes and spans, bases, chains and cycles of inferences, pointers and sections."""
    return engine.validate_draft(document_drafts(read("documents", "doc_id", "text"))).select("key", "path", "code")


DRAFTS_SQL = r"""
WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS key, coalesce(text, '') AS t FROM documents),
e AS (
  SELECT key, t, '$.claims[' || k || '].evidence[0]' AS place, CASE WHEN k = 1 THEN substr(t, 2, 20) ELSE substr(t, 1, 20) END AS quote FROM d, (SELECT unnest([0, 1, 2, 3]) AS k)),
control AS (SELECT '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]' AS p)
SELECT key, '$context.sourceSegments[0].text' AS path, CASE WHEN t = '' THEN 'string_too_short' ELSE 'string_too_long' END AS code FROM d WHERE t = '' OR length(t) > 200000
UNION ALL SELECT key, '$context.sourceSegments[0].text', 'control_character' FROM d, control WHERE regexp_matches(t, p)
UNION ALL SELECT key, place || '.quote', 'string_too_short' FROM e WHERE quote = ''
UNION ALL SELECT key, place || '.quote', 'control_character' FROM e, control WHERE regexp_matches(quote, p)
UNION ALL SELECT key, place || '.span.end', 'span_out_of_bounds' FROM e WHERE length(t) < 20
UNION ALL SELECT key, place || '.quote', 'quote_mismatch' FROM e WHERE length(t) >= 20 AND quote <> substr(t, 1, 20)
UNION ALL SELECT key, '$.claims', 'claim_cycle' FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT key, '$.claims[3].basisClaimIds[0]', 'dangling_claim' FROM d WHERE doc_id % 5 = 1
UNION ALL SELECT key, '$.claims[4].basisClaimIds[0]', 'suggestion_chain' FROM d WHERE doc_id % 7 = 0
UNION ALL SELECT key, '$.document.titleClaimId', 'invalid_document_pointer' FROM d WHERE doc_id % 4 = 0
UNION ALL SELECT key, '$.sections.missingInformationClaimIds[0]', 'wrong_section_provenance' FROM d WHERE doc_id % 6 = 0
UNION ALL SELECT key, '$.sections.planActionIds[0]', 'dangling_action' FROM d WHERE doc_id % 8 = 0
"""


def ledger_issue_order(read) -> DataFrame:
    """The issues of every document's draft, numbered in the order of a walk through it."""
    issues = engine.validate_draft(document_drafts(read("documents", "doc_id", "text")))
    return issues.select("key", F.row_number().over(Window.partitionBy("key").orderBy("ord")).alias("place"), "path", "code")


def _in_order(sql: str) -> str:
    """SQL for issues with their place: contexts come before drafts, elements of claims before what they are to each other, and so on."""
    place = """CASE
      WHEN path LIKE '$context%' THEN [0, CASE code WHEN 'control_character' THEN 1 ELSE 0 END]
      WHEN path LIKE '%.evidence%' THEN [1, CAST(substr(path, 10, 1) AS INTEGER), CASE code WHEN 'string_too_short' THEN 0 WHEN 'control_character' THEN 1 ELSE 2 END]
      WHEN path LIKE '%.basisClaimIds%' THEN [2, CAST(substr(path, 10, 1) AS INTEGER)]
      WHEN path = '$.claims' THEN [3] WHEN path LIKE '$.document%' THEN [4] WHEN path LIKE '%missing%' THEN [5] ELSE [6] END"""
    return f"SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY {place}) AS INTEGER) AS place, path, code FROM ({sql})"


def user_packs(events: DataFrame) -> DataFrame:
    """key and raw: each user's events as the ledger of a pack that is otherwise well formed."""
    typed = events.selectExpr(
        "user_id", "event_type = 'purchase' AS bought",
        """struct(event_id, date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") AS at, CAST(get_json_object(props, '$.k') AS INT) AS k, CASE event_type WHEN 'click' THEN 'source_admitted' WHEN 'purchase' THEN 'consent_recorded' ELSE 'run_cancelled' END AS type) AS e""",
    )
    users = typed.groupBy("user_id").agg({"e": "collect_list", "bought": "max"}).toDF("user_id", "es", "bought").selectExpr("user_id", "bought", "array_sort(es) AS es")
    event = "named_struct('id', concat('event.', e.event_id), 'sequence', e.k, 'occurredAt', e.at, 'type', e.type, 'status', 'completed', 'actor', named_struct('location', 'browser', 'name', 'table'), 'relatedId', 'src.1')"
    fact = "named_struct('sourceId', 'src.1', 'sourceRevisionId', 'rev.1', 'segmentId', 'seg.1', 'quote', 'Bought', 'span', named_struct('start', 0, 'end', 6))"
    check = f"named_struct('state', 'accepted', 'validatorVersion', '1', 'validatedAt', {_TIME}, 'issueCodes', array(), 'checks', named_struct('citation', 'passed', 'semanticSupport', if(user_id % 3 = 0, 'partial', 'supported')))"
    claim = f"named_struct('id', 'claim.1', 'provenance', 'source_fact', 'title', 'Claim', 'statement', 'A claim.', {_CHECKED}, 'evidence', array({fact}), 'validation', {check})"
    document = "named_struct('documentType', 'notice', 'titleClaimId', 'claim.1', 'purposeClaimId', 'claim.1', 'actionRequiredClaimId', 'claim.1')"
    sections = "named_struct('briefClaimIds', array('claim.1'), 'factClaimIds', array('claim.1'), 'attentionClaimIds', array(), 'missingInformationClaimIds', array(), 'conflictClaimIds', array(), 'planActionIds', array())"
    analysis = f"named_struct('kind', 'ledger.validated_analysis', 'schemaVersion', '1.0.0', 'analysisId', 'analysis.1', 'knowledgeMode', 'source_only', 'sourceRevisionIds', array('rev.1'), 'document', {document}, 'claims', array({claim}), 'actions', array(), 'questions', array(), 'sections', {sections})"
    summary = "named_struct('totalClaims', size(es) % 3, 'accepted', 1, 'needsReview', 0, 'blocked', 0, 'stale', 0, 'totalActions', 0, 'acceptedActions', 0, 'needsReviewActions', 0, 'blockedActions', 0, 'staleActions', 0)"
    components = "array(named_struct('component', if(bought, 'ledger', 'parser'), 'name', 'table', 'version', '1'), named_struct('component', 'citation_validator', 'name', 'table', 'version', '1'))"
    kept = "array(named_struct('id', 'retention.1', 'subject', 'browser', 'state', 'locally_cleared', 'assertedBy', 'table', 'recordedAt', element_at(es, -1).at, 'eventId', concat('event.', element_at(es, -1).event_id)))"
    receipt = f"named_struct('id', 'receipt.1', 'createdAt', es[0].at, 'processingMode', if(user_id % 2 = 0, 'sample', 'browser_local'), 'events', transform(es, e -> {event}), 'consentRecords', array(), 'transfers', array(), 'retention', {kept}, 'components', {components}, 'validationSummary', {summary}, 'externalReferences', array(), 'correctionIds', array())"
    context = f"named_struct('sources', {_sources(1)}, 'sourceRevisions', {_revisions(chr(39) + 'active' + chr(39))}, 'sourceSegments', array({_segment('1', chr(39) + 'rev.1' + chr(39), '0', chr(39) + 'Bought it.' + chr(39), '1')}))"
    pack = f"named_struct('kind', 'ledger.action_pack', 'schemaVersion', '1.0.0', 'packId', concat('pack.', user_id), 'createdAt', element_at(es, -1).at, 'runMode', 'sample_fixture', 'canonicalSources', {context}, 'analysis', {analysis}, 'receipt', {receipt}, 'corrections', array(), 'limitations', array('Made of a table.'))"
    return users.selectExpr("CAST(user_id AS STRING) AS key", f"to_json({pack}) AS raw")


def ledger_packs(read) -> DataFrame:
    """validate_pack over every user's events: order in sequence and time, missing events, declared totals, retention, modes."""
    return engine.validate_pack(user_packs(read("events", "event_id", "ts", "user_id", "event_type", "props"))).select("key", "path", "code")


PACKS_SQL = """
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS key, *, date_trunc('millisecond', ts) AS said, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'click' THEN 'source_admitted' WHEN 'purchase' THEN 'consent_recorded' ELSE 'run_cancelled' END AS type,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events),
w AS (SELECT *, coalesce(lag(k) OVER own, -1) AS last_k, lag(said) OVER own AS last_at FROM e WINDOW own AS (PARTITION BY key ORDER BY idx)),
u AS (
  SELECT key, any_value(user_id) AS user_id, count(*) AS n, bool_or(event_type = 'purchase') AS bought, arg_min(said, idx) AS first_at, arg_max(said, idx) AS last_at, arg_max(type, idx) AS last_type FROM e GROUP BY key)
SELECT key, '$.receipt.events[' || idx || '].sequence' AS path, 'event_order' AS code FROM w WHERE k <= last_k
UNION ALL SELECT key, '$.receipt.events[' || idx || '].occurredAt', 'event_time_order' FROM w WHERE said < last_at
UNION ALL SELECT key, '$.receipt.events', unnest(['analysis_event_missing', 'validation_event_missing']) FROM u
UNION ALL SELECT key, '$.receipt.events', 'too_many_items' FROM u WHERE n > 1000
UNION ALL SELECT key, '$.receipt.createdAt', 'receipt_time_order' FROM u WHERE first_at < last_at
UNION ALL SELECT key, '$.receipt.components', 'ledger_version_missing' FROM u WHERE NOT bought
UNION ALL SELECT key, '$.receipt.validationSummary.totalClaims', 'summary_mismatch' FROM u WHERE n % 3 <> 1
UNION ALL SELECT key, '$.receipt.retention[0].eventId', unnest(['retention_event_mismatch', 'retention_subject_mismatch']) FROM u
UNION ALL SELECT key, '$.receipt.processingMode', 'run_mode_mismatch' FROM u WHERE user_id % 2 <> 0
UNION ALL SELECT key, '$.analysis.claims[0].validation.checks.semanticSupport', 'accepted_without_semantic_support' FROM u WHERE user_id % 3 = 0
"""

QUERIES = {"ledger_contexts": (ledger_contexts, CONTEXTS_SQL), "ledger_drafts": (ledger_drafts, DRAFTS_SQL), "ledger_packs": (ledger_packs, PACKS_SQL), "ledger_issue_order": (ledger_issue_order, _in_order(DRAFTS_SQL))}
