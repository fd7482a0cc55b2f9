"""Ledgers of what was sent to a provider, made of customers and their orders, with what is wrong with them; and SQL for exactly those issues.

A customer is a pack: three claims, two actions, one correction, and for each order a consent and a transfer. Remainders of the customer's and the orders' keys say what is wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import engine


def obj(**members: str) -> str:
    """SQL for a struct; a null member is absent in JSON."""
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in members.items()) + ")"


def text(value: str) -> str:
    return f"'{value}'"


def texts(*values: str) -> str:
    return f"array({', '.join(map(text, values))})" if values else "CAST(array() AS array<string>)"


def every(n: int, wrong: str, right: str = "NULL", key: str = "c") -> str:
    """What is wrong with every n-th, and right with the others."""
    return f"if({key} % {n} = 0, {wrong}, {right})"


def joined(*items: str) -> str:
    """JSON of an array of unlike objects."""
    return "concat('[', concat_ws(',', " + ", ".join(f"to_json({x})" for x in items) + "), ']')"


def moment(n: str) -> str:
    """The n-th second of the ledger."""
    return f"""date_format(timestamp_seconds(1704067200 + {n}), "yyyy-MM-dd'T'HH:mm:ss'Z'")"""


def digest(letter: str) -> str:
    return obj(algorithm=text("sha-256"), value=f"repeat({letter}, 64)")


def event(name: str, place: str, kind: str, related: str, status: str = "'completed'", location: str = "'browser'") -> str:
    return obj(id=name, sequence=f"CAST({place} AS INT)", occurredAt=moment(place), type=kind, status=status, actor=obj(location=location, name=text("table")), relatedId=related)


LATER, NEVER = "'2025-01-01T00:00:00Z'", "'2023-01-01T00:00:00Z'"


def customer_packs(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """key and raw: each customer as a pack."""
    listed = orders.selectExpr("o_custkey", "o_orderkey AS o").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o")).alias("os"))
    base = customers.join(listed, customers["c_custkey"] == listed["o_custkey"], "left").selectExpr("c_custkey AS c", "c_name AS name", "coalesce(os, CAST(array() AS array<bigint>)) AS os").withColumn("n", F.size("os"))

    revision = lambda n, status, letter, prior: obj(id=text(f"rev.{n}"), sourceId=text("src.1"), fingerprint=digest(letter), createdAt=moment("0"), status=status, supersedesRevisionId=prior)
    segment = lambda n, rev: obj(
        id=text(f"seg.{n}"), sourceId=text("src.1"), sourceRevisionId=text(rev), index=str(n), text="name", anchor=obj(kind=text("page_text"), page="1", block="0"), extraction=obj(method=text("manual"), engine=text("table"), version=text("1"), extractedAt=moment("0")),
    )
    context = obj(
        sources=f"array({obj(id=text('src.1'), displayName=text('row'), kind=text('file'), mediaType=text('text/plain'), pageCount='1', origin=obj(kind=text('upload')))})",
        sourceRevisions=f"array({revision(1, every(13, text('active'), text('superseded')), text('a'), 'NULL')}, {revision(2, every(17, text('superseded'), text('active')), every(11, text('a'), text('b')), every(19, 'NULL', text('rev.1')))})",
        sourceSegments=f"array({segment(0, 'rev.1')}, {segment(1, 'rev.2')})",
    )

    checked = lambda state, codes, checks, at="3 * n + 1": obj(state=state, validatorVersion=text("1"), validatedAt=moment(at), issueCodes=codes, checks=checks)
    seen = f"array({obj(sourceId=text('src.1'), sourceRevisionId=text('rev.2'), segmentId=text('seg.1'), quote='name', span=obj(start='0', end='length(name)'))})"
    sound, aside = (obj(citation=text(a), semanticSupport=text(b)) for a, b in (("passed", "supported"), ("not_applicable", "not_applicable")))
    claim = lambda n, provenance, validation, values="array()", **more: obj(id=text(f"claim.{n}"), provenance=text(provenance), title=text("Claim"), statement=text("A claim."), materiality=text("material"), normalizedValues=values, **more, validation=validation)
    good = texts()
    claims = joined(
        claim(1, "source_fact", checked(text("accepted"), good, sound, every(43, "0", "3 * n + 1")), f"array({obj(kind=text('date'), value=text('2024-01-01'))})", evidence=seen),
        claim(2, "inference", checked(text("accepted"), good, sound), evidence=seen, basisClaimIds=texts("claim.1"), rationale=text("So it is.")),
        claim(3, "suggestion", checked(every(7, text("stale"), text("accepted")), every(7, texts("old"), good), aside), basisClaimIds=texts("claim.1"), rationale=text("Why not."), sourceImposed="false", execution=text("manual_user_choice")),
    )
    action = lambda n, provenance, basis, timing, imposed, validation, consequence="NULL": obj(
        id=text(f"action.{n}"), provenance=text(provenance), order=str(n), priority=text("high"), title=text("Act"), description=text("Do it."), timing=timing, basisClaimIds=basis, requiredInputs=good, consequence=consequence, sourceImposed=imposed, execution=text("manual_user_choice"),
        validation=validation,
    )
    tried = obj(basis=every(14, text("failed"), text("passed")), timing=every(16, text("failed"), text("passed")), safety=every(15, text("failed"), text("passed")))
    done = obj(basis=text("passed"), timing=text("passed"), safety=text("passed"))
    actions = joined(
        action(
            1, "document_requirement", every(10, texts("claim.1", "claim.2"), texts("claim.1")), obj(kind=text("calendar_date"), date=every(5, text("2024-02-02"), text("2024-01-01")), basisClaimId=every(6, text("claim.2"), text("claim.1"))),
            every(8, "false", "true"), checked(text("accepted"), good, tried), every(12, obj(text=text("Or else."), basisClaimIds=texts("claim.9"))),
        ),
        action(2, "ledger_suggestion", texts("claim.3"), obj(kind=text("condition"), label=text("Then"), basisClaimId=text("claim.3")), every(9, "true", "false"), checked(every(20, text("blocked"), text("accepted")), every(20, texts("old"), good), done)),
    )
    document = obj(documentType=text("notice"), titleClaimId=text("claim.1"), purposeClaimId=text("claim.1"), actionRequiredClaimId=text("claim.1"), nearestDeadlineClaimId=text("claim.2"), primaryActionId=every(18, text("action.9"), text("action.1")))
    sections = obj(briefClaimIds=texts("claim.1"), factClaimIds=texts("claim.1", "claim.2"), attentionClaimIds=good, missingInformationClaimIds=good, conflictClaimIds=good, planActionIds=texts("action.1", "action.2"))
    question = obj(id=text("question.1"), text=text("Is it so?"), reason=text("It may not be."), basisClaimIds=every(21, texts("claim.9"), texts("claim.1")))
    head = obj(kind=text("ledger.validated_analysis"), schemaVersion=text("1.0.0"), analysisId=text("analysis.1"), knowledgeMode=text("source_only"), sourceRevisionIds=texts("rev.2"), document=document, questions=f"array({question})", sections=sections)

    of = lambda n, wrong, right="NULL": every(n, wrong, right, "x.o")
    mode_text = "if(c % 2 = 0, 'redacted_text', 'full_file')"
    shared = {"sourceRevisionIds": texts("rev.2"), "segmentIds": texts("seg.1"), "contentCategories": f"array({mode_text})", "redactions": texts("Name")}
    consent = obj(id="concat('consent.', x.k)", recordedAt=of(5, moment("3 * x.k + 1"), moment("3 * x.k")), approvedBy=text("user"), recipient=text("Provider"), provider=text("P"), model=text("M"), previewDigest=digest(text("c")), **shared)
    sent = shared | {
        "sourceRevisionIds": of(11, texts("rev.9"), texts("rev.2")), "segmentIds": of(7, texts("seg.9"), texts("seg.1")),
        "contentCategories": of(13, texts("document_metadata"), of(19, texts("redacted_text", "full_file"), f"array({mode_text})")), "redactions": of(17, good, texts("Name")),
    }
    transfer = obj(
        id="concat('transfer.', x.k)", consentId=of(29, text("consent.x"), "concat('consent.', x.k)"), startedAt=of(37, NEVER, moment("3 * x.k + 1")), completedAt=of(41, "NULL", moment("3 * x.k + 2")), recipient=of(3, text("Other"), text("Provider")), provider=text("P"),
        model=of(31, "NULL", text("M")), executionLocation=text("provider"), payloadDigest=digest(of(23, text("d"), text("c"))), payloadByteCount="10", providerPolicy=obj(retention=text("none"), trainingUse=text("not_used"), assertedBy=text("P")), **sent,
    )
    own = lambda k, n, kind, related, fails, place="'browser'": event(f"concat('event.', 3 * x.k + {n})", f"3 * x.k + {n}", text(kind), f"concat('{related}.', x.k)", of(fails, text("failed"), text("completed")), place)
    sending = f"array({own(0, 0, 'consent_recorded', 'consent', 47)}, {own(1, 1, 'transfer_started', 'transfer', 53)}, {own(2, 2, 'transfer_completed', 'transfer', 59, of(43, text('browser'), text('provider')))})"
    last = lambda k, kind, related, status="'completed'", place="'browser'": event(text(f"event.last{k}"), f"3 * n + {k}", kind, related, status, place)
    closing = ", ".join([
        last(0, text("analysis_completed"), text("analysis.1"), every(45, text("failed"), text("completed"))), last(1, text("validation_completed"), text("analysis.1"), place=every(46, text("provider"), text("browser"))),
        last(2, text("correction_recorded"), text("correction.1"), every(36, text("failed"), text("completed")), every(37, text("provider"), text("browser"))),
        last(3, text("local_cleanup_completed"), every(24, text("rev.9"), text("rev.2")), place=every(25, text("provider"), text("browser"))),
        last(4, every(30, text("deletion_requested"), text("deletion_reported")), text("transfer.0"), every(29, text("failed"), text("completed")), every(28, text("browser"), text("provider"))),
    ])
    kept = lambda k, subject, state, name, at: obj(id=text(f"retention.{k}"), subject=text(subject), state=text(state), assertedBy=text("table"), recordedAt=at, eventId=name)
    counts = {
        "totalClaims": "3", "accepted": every(7, "2", "3"), "needsReview": "0", "blocked": "0", "stale": every(7, "1", "0"), "totalActions": every(22, "3", "2"), "acceptedActions": every(20, "1", "2"), "needsReviewActions": "0", "blockedActions": every(20, "1", "0"), "staleActions": "0",
    }
    part = lambda name: obj(component=text(name), name=text("table"), version=text("1"))
    outside = obj(id=text("ref.1"), url=text("https://example.org/"), title=text("A page"), accessedAt=moment("0"))
    numbered = "transform(os, (o, k) -> named_struct('o', o, 'k', k))"
    receipt = obj(
        id=text("receipt.1"), createdAt=LATER, processingMode="if(c % 2 = 0, 'cloud_redacted', 'cloud_full')", events=f"concat(flatten(transform({numbered}, x -> {sending})), array({closing}))", consentRecords=f"transform({numbered}, x -> {consent})",
        transfers=f"transform({numbered}, x -> {transfer})",
        retention=f"array({kept(0, 'browser', 'locally_cleared', every(27, text('event.none'), text('event.last3')), every(26, LATER, moment('3 * n + 3')))}, {kept(1, 'provider', 'provider_reported_deleted', text('event.last4'), moment('3 * n + 4'))})",
        components=f"array({part('ledger')}, {part('citation_validator')})", validationSummary=obj(**counts), externalReferences=every(47, f"array({outside})", f"slice(array({outside}), 1, 0)"), correctionIds=every(40, good, texts("correction.1")),
    )
    correction = obj(
        id=text("correction.1"), sourceId=every(33, text("src.9"), text("src.1")), priorRevisionId=text("rev.1"), targetSegmentId=every(34, text("seg.1"), text("seg.0")), targetSpan=obj(start="0", end=every(32, "500", "8")),
        originalText=every(31, text("Customex"), text("Customer")), replacement=text("Client"), actor=text("user"), createdAt=every(35, LATER, moment("3 * n + 2")), resultingRevisionId=text("rev.2"), invalidatedClaimIds=texts("claim.1"),
        regeneratedClaimIds=every(38, texts("claim.3"), every(39, texts("claim.9"), texts("claim.1"))),
    )
    pack = obj(kind=text("ledger.action_pack"), schemaVersion=text("1.0.0"), packId="concat('pack.', c)", createdAt=every(41, NEVER, "'2025-01-02T00:00:00Z'"), runMode=every(42, text("sample_fixture"), text("live")), canonicalSources=context, corrections=f"array({correction})", limitations=texts("Made of a table."))
    opened = lambda struct: f"substr(to_json({struct}), 1, length(to_json({struct})) - 1)"
    raw = f"""concat({opened(pack)}, ',"receipt":', to_json({receipt}), ',"analysis":', {opened(head)}, ',"claims":', {claims}, ',"actions":', {actions}, '}}}}')"""
    return base.selectExpr("CAST(c AS STRING) AS key", f"{raw} AS raw")


def ledger_cloud_packs(read) -> DataFrame:
    """validate_pack over every customer: actions, questions and plans, consents, transfers, retention, corrections."""
    return engine.validate_pack(customer_packs(read("customer", "c_custkey", "c_name"), read("orders", "o_custkey", "o_orderkey"))).select("key", "path", "code")


def _when(table: str, key: str, *rules: tuple[str, str, str]) -> str:
    """SQL for (condition, path as an SQL expression, code) of each issue over a table with a key."""
    return " UNION ALL ".join(f"SELECT {key} AS key, {path} AS path, '{code}' AS code FROM {table} WHERE {condition}" for condition, path, code in rules)


def _sql() -> str:
    at = lambda n: f"c % {n} = 0"
    a, r, q = "'$.analysis", "'$.receipt", "'$.corrections[0]"
    whole = [
        (at(17), f"{a}.sourceRevisionIds[0]'", "stale_revision"), (at(17), f"{a}.claims[0].evidence[0].sourceRevisionId'", "stale_revision"), (at(17), f"{a}.claims[1].evidence[0].sourceRevisionId'", "stale_revision"),
        (at(14), f"{a}.actions[0].validation.checks.basis'", "accepted_without_basis_check"), (at(15), f"{a}.actions[0].validation.checks.safety'", "accepted_without_safety_check"), (at(16), f"{a}.actions[0].validation.checks.timing'", "accepted_without_timing_check"),
        (at(8), f"{a}.actions[0].sourceImposed'", "requirement_not_source_imposed"), (at(9), f"{a}.actions[1].sourceImposed'", "suggestion_source_imposed"),
        (at(10), f"{a}.actions[0].basisClaimIds[1]'", "requirement_needs_source_fact"), (at(6) + " AND c % 10 <> 0", f"{a}.actions[0].timing.basisClaimId'", "timing_basis_missing"), (at(6), f"{a}.actions[0].timing.basisClaimId'", "date_needs_source_fact"),
        (at(5) + " AND c % 6 <> 0", f"{a}.actions[0].timing.date'", "timing_value_mismatch"), (at(12), f"{a}.actions[0].consequence.basisClaimIds[0]'", "dangling_claim"),
        (at(7), f"{a}.actions[1].basisClaimIds[0]'", "blocked_claim_reference"), (at(7), f"{a}.actions[1].timing.basisClaimId'", "blocked_claim_reference"), (at(21), f"{a}.questions[0].basisClaimIds[0]'", "dangling_claim"),
        (at(18), f"{a}.document.primaryActionId'", "dangling_action"), (at(20), f"{a}.sections.planActionIds[1]'", "blocked_action_reference"),
        (at(45), f"{r}.events'", "analysis_event_missing"), (at(46), f"{r}.events'", "untrusted_validation_actor"), (at(43), f"{r}.events'", "validation_time_mismatch"), (at(22), f"{r}.validationSummary.totalActions'", "summary_mismatch"),
        (at(47), f"{r}.externalReferences'", "external_reference_in_source_only_mode"), ("n = 0", f"{r}.transfers'", "missing_external_transfer"),
        (at(27), f"{r}.retention[0].eventId'", "dangling_event"), (at(26) + " AND c % 27 <> 0", f"{r}.retention[0].recordedAt'", "retention_event_time_mismatch"), (at(25) + " AND c % 27 <> 0", f"{r}.retention[0].eventId'", "retention_actor_mismatch"),
        (at(24) + " AND c % 27 <> 0", f"{r}.retention[0].eventId'", "retention_subject_mismatch"), (at(30), f"{r}.retention[1].eventId'", "retention_event_mismatch"), (at(29), f"{r}.retention[1].eventId'", "retention_event_not_completed"),
        (at(28), f"{r}.retention[1].eventId'", "retention_actor_mismatch"), ("n = 0", f"{r}.retention[1].eventId'", "retention_subject_mismatch"),
        (at(33), f"{q}.sourceId'", "dangling_source"), (at(13), f"{q}.priorRevisionId'", "prior_revision_not_superseded"), (at(17), f"{q}.resultingRevisionId'", "resulting_revision_not_active"), (at(19), f"{q}'", "correction_revision_mismatch"),
        (at(33), f"{q}.sourceId'", "correction_source_mismatch"), (at(33), f"{q}.sourceId'", "correction_source_mismatch"), (at(11), f"{q}'", "unchanged_revision_fingerprint"), (at(34), f"{q}.targetSegmentId'", "correction_segment_mismatch"),
        (at(32), f"{q}.targetSpan.end'", "span_out_of_bounds"), (at(31) + " AND c % 32 <> 0", f"{q}.originalText'", "correction_text_mismatch"), (at(38), f"{q}.regeneratedClaimIds[0]'", "regenerated_claim_revision_mismatch"),
        (at(39) + " AND c % 38 <> 0", f"{q}.regeneratedClaimIds[0]'", "dangling_claim"), (at(36), f"{q}'", "correction_event_missing"), (at(35) + " AND c % 36 <> 0", f"{q}.createdAt'", "correction_event_time_mismatch"), (at(37) + " AND c % 36 <> 0", f"{q}'", "correction_actor_mismatch"),
        (at(41), "'$.createdAt'", "pack_time_order"), (at(40), f"{r}.correctionIds'", "correction_receipt_mismatch"), (at(42), f"{r}.processingMode'", "run_mode_mismatch"),
    ]
    on = lambda n: f"o % {n} = 0"
    t = "'$.receipt.transfers[' || k || ']"
    met, full, redacted = "o % 29 <> 0", "c % 2 <> 0", "c % 2 = 0"
    odd = "(o % 13 = 0 OR o % 19 = 0)"
    each = [
        (on(47), "'$.receipt.consentRecords[' || k || ']'", "consent_event_missing"), (on(5) + " AND o % 47 <> 0", "'$.receipt.consentRecords[' || k || '].recordedAt'", "consent_event_time_mismatch"),
        (on(29), f"{t}.consentId'", "transfer_without_consent"), (f"{met} AND {on(3)}", f"{t}.recipient'", "consent_mismatch"), (f"{met} AND {on(31)}", f"{t}.model'", "consent_mismatch"), (f"{met} AND {on(11)}", f"{t}.sourceRevisionIds'", "consent_mismatch"),
        (f"{met} AND {on(7)}", f"{t}.segmentIds'", "consent_mismatch"), (f"{met} AND {odd}", f"{t}.contentCategories'", "consent_mismatch"), (f"{met} AND {on(17)}", f"{t}.redactions'", "consent_mismatch"),
        (f"{met} AND {on(23)}", f"{t}.payloadDigest'", "payload_digest_mismatch"), (f"{met} AND {on(37)}", f"{t}.startedAt'", "transfer_before_consent"), (on(53), f"{t}'", "transfer_event_missing"), (on(37) + " AND o % 53 <> 0", f"{t}.startedAt'", "transfer_event_time_mismatch"),
        (on(41), f"{t}.completedAt'", "transfer_completion_required"), (on(59) + " AND o % 41 <> 0", f"{t}'", "transfer_completion_event_missing"), (on(43) + " AND o % 41 <> 0 AND o % 59 <> 0", f"{t}'", "transfer_actor_mismatch"),
        (f"{redacted} AND {on(19)} AND o % 13 <> 0", f"{t}.contentCategories'", "redacted_mode_content_mismatch"), (f"{redacted} AND ({on(13)} OR {on(17)})", f"{t}'", "redacted_mode_disclosure_missing"), (f"{full} AND {on(13)}", f"{t}.contentCategories'", "full_mode_content_mismatch"),
        (on(11), "'$.receipt'", "receipt_revision_mismatch"), (on(7), "'$.receipt'", "receipt_segment_mismatch"), (on(11) + " AND o % 7 <> 0", "'$.receipt'", "receipt_segment_revision_mismatch"),
    ]
    return f"""
WITH s AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
p AS (SELECT c_custkey AS c, (SELECT count(*) FROM s WHERE s.c = c_custkey) AS n FROM customer)
SELECT CAST(key AS VARCHAR) AS key, path, code FROM ({_when('p', 'c', *whole)} UNION ALL {_when('s', 'c', *each)})
"""


QUERIES = {"ledger_cloud_packs": (ledger_cloud_packs, _sql())}
