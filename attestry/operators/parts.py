"""The parts of a document: their members and the rules that need nothing but the part itself.

Names, bounds and choices are fixed values of the format. The product that makes documents has a name of its own choice, from which a few of the
format's values are built: kinds of documents, a place, a subject, a component and a provenance.
"""

from __future__ import annotations

from attestry.functions import values as V
from attestry.operators.structure import At, Check, Found, all_of, array_of, both, bound, choices, day, digest, each, flag, found, given, ident, ids, integer, listed, literal, moment, none, one_of, plain, real, text, thing, token, url, variants

#: The product's name where none is given.
PRODUCT = "ledger"

# Fixed values of the format.
EPSILON = "2.220446049250313e-16D"
STATES = ("accepted", "needs_review", "blocked", "stale")
CATEGORIES = ("full_file", "page_images", "extracted_text", "redacted_text", "document_metadata", "user_question")
PROVENANCES = ("source_fact", "inference", "suggestion", "not_confirmed", "conflict")


def s(at: At, name: str) -> str:
    return V.string(V.get(at.v, name))


def locations(product: str) -> tuple[str, ...]:
    return ("browser", "device", f"{product}_service", "provider")


# --- sources -----------------------------------------------------------------------------------------------------------------

origin = variants("kind", {
    **dict.fromkeys(("upload", "camera", "paste"), thing({}, open_keys=["kind"])),
    "url": thing({"url": url}, open_keys=["kind"]),
    "sample": thing({"fixtureId": ident}, open_keys=["kind"]),
})


def _origin_fits(at: At) -> str:
    o = at["origin"]
    return found(at, (f"{s(at, 'kind')} = 'url' AND {V.is_object(o.v)} AND NOT {s(o, 'kind')} <=> 'url'", o["kind"].path, "origin_mismatch"))


source = thing(
    {"id": ident, "displayName": plain(255), "kind": one_of("file", "image", "url", "text"), "mediaType": text(1, 127, pattern=(V.MEDIA_TYPE, "invalid_media_type")), "origin": origin},
    {"byteSize": integer(0), "pageCount": integer(1, 100_000)}, _origin_fits, order=("id", "displayName", "kind", "mediaType", "byteSize", "pageCount", "origin"),
)
revision = thing({"id": ident, "sourceId": ident, "fingerprint": digest, "createdAt": moment, "status": one_of("active", "superseded")}, {"supersedesRevisionId": ident})


def _inside_page(at: At) -> str:
    n = lambda k: V.number(V.get(at.v, k))
    return found(at, *((f"{n(a)} + {n(b)} > 1", at.path, "region_out_of_bounds") for a, b in (("x", "width"), ("y", "height"))))


def _span(low: str, high: str):
    """Both ends are numbers (safe integers where the part is a span) and the first is not before the second."""
    return lambda at: found(at, (f"{V.safe_integer(V.get(at.v, low))} >= {V.safe_integer(V.get(at.v, high))}", at.path, "invalid_span"))


def _characters(at: At) -> str:
    return found(at, (f"{V.number(V.get(at.v, 'characterStart'))} >= {V.number(V.get(at.v, 'characterEnd'))}", at.path, "invalid_span"))


region = thing({"unit": literal("normalized"), "x": real("0", "1"), "y": real("0", "1"), "width": real(EPSILON, "1"), "height": real(EPSILON, "1")}, more=_inside_page)
page = integer(1, 100_000)
anchor = variants("kind", {
    "page_text": thing({"page": page, "block": integer(0)}, open_keys=["kind"]),
    "page_region": thing({"page": page, "region": region}, open_keys=["kind"]),
    "plain_text": thing({"characterStart": integer(0), "characterEnd": integer(1)}, more=_characters, open_keys=["kind"]),
    "web": thing({"url": url}, {"selector": plain(1000)}, open_keys=["kind"]),
})
extraction = thing({"method": one_of("native_text", "ocr", "web", "manual", "sample"), "engine": plain(128), "version": plain(128), "extractedAt": moment})
segment = thing({"id": ident, "sourceId": ident, "sourceRevisionId": ident, "index": integer(0), "text": text(1, 200_000), "anchor": anchor, "extraction": extraction})
context = thing({"sources": array_of(1, 20), "sourceRevisions": array_of(1, 100), "sourceSegments": array_of(1, 10_000)})
#: Where the elements of arrays come; what they are to each other comes from 7 on.
CONTEXT_RANKS = {"sources": 4, "sourceRevisions": 5, "sourceSegments": 6}
CONTEXT_ELEMENTS = {"sources": source, "sourceRevisions": revision, "sourceSegments": segment}

# --- claims ------------------------------------------------------------------------------------------------------------------

span = thing({"start": integer(0), "end": integer(1)}, more=_span("start", "end"))
evidence = thing({"sourceId": ident, "sourceRevisionId": ident, "segmentId": ident, "quote": text(1, 8000), "span": span})
value = variants("kind", {
    "date": thing({"value": day}, open_keys=["kind"]),
    "money": thing({"amount": text(1, 100, pattern=(V.AMOUNT, "invalid_decimal_amount")), "currency": text(3, 3, pattern=(V.CURRENCY, "invalid_currency"))}, {"basis": one_of("annual", "monthly", "weekly", "daily", "one_time")}, open_keys=["kind"]),
    "duration": thing({"value": real(EPSILON, "1000000"), "unit": one_of("day", "week", "month", "year")}, open_keys=["kind"]),
})


def _state_and_issues(at: At) -> str:
    """Accepted means no issue codes; every other state means some."""
    codes = f"size({V.strings(V.get(at.v, 'issueCodes'))})"
    others = ", ".join(f"'{x}'" for x in STATES[1:])
    where = at["issueCodes"].path
    return found(at, (f"{s(at, 'state')} = 'accepted' AND {codes} > 0", where, "accepted_with_issues"), (f"{s(at, 'state')} IN ({others}) AND {codes} = 0", where, "missing_issue_code"))


def _attested(checks: dict) -> dict:
    return {"state": one_of(*STATES), "validatorVersion": plain(128), "validatedAt": moment, "issueCodes": listed(token, 0, 100), "checks": thing(checks)}


def claim_validation(at: At, provenance: str) -> str:
    checks = V.get(at.v, "checks")
    of = lambda name: V.string(V.get(checks, name))
    accepted = f"{s(at, 'state')} = 'accepted'"
    whole = f"{accepted} AND {V.is_object(checks)}"
    own = lambda at: both(
        _state_and_issues(at),
        found(
            at,
            (f"{accepted} AND {provenance} IN ('not_confirmed', 'conflict')", at["state"].path, "unsupported_state"),
            (f"{whole} AND {provenance} IN ('source_fact', 'inference', 'conflict') AND NOT {of('citation')} <=> 'passed'", at["checks"]["citation"].path, "accepted_without_citation_check"),
            (f"{whole} AND {provenance} IN ('source_fact', 'inference') AND NOT {of('semanticSupport')} <=> 'supported'", at["checks"]["semanticSupport"].path, "accepted_without_semantic_support"),
            (f"{whole} AND {provenance} = 'suggestion' AND NOT {of('semanticSupport')} <=> 'not_applicable'", at["checks"]["semanticSupport"].path, "invalid_suggestion_support_check"),
            first=2,
        ),
    )
    return thing(_attested({"citation": one_of("passed", "failed", "not_applicable"), "semanticSupport": one_of("supported", "partial", "unsupported", "not_applicable")}), more=own)(at)


def _distinct_segments(at: At) -> str:
    """A conflict cites two segments at least, over all alternatives."""
    refs = f"flatten(transform({V.records(V.get(at.v, 'alternatives'))}, a -> {V.records(V.get('a', 'evidence'))}))"
    cited = f"array_distinct(filter(transform({refs}, r -> {V.string(V.get('r', 'segmentId'))}), t -> t IS NOT NULL))"
    return found(at, (f"size({cited}) < 2", at["alternatives"].path, "conflict_needs_distinct_evidence"))


def not_imposed(code: str, when: str = "TRUE", value: str = "TRUE"):
    return lambda at: found(at, (f"{when.format(p=s(at, 'provenance'))} AND {V.boolean(V.get(at.v, 'sourceImposed'))} = {value}", at["sourceImposed"].path, code))


def claim(validated: bool):
    base = ["id", "provenance", "title", "statement", "materiality", "normalizedValues", *(["validation"] if validated else [])]
    cited = lambda low: each(evidence, low, 50)
    reason = plain(4000)
    alternative = thing({"statement": plain(4000), "evidence": cited(1)})
    kinds = variants("provenance", {
        "source_fact": thing({"evidence": cited(1)}, open_keys=base),
        "inference": thing({"evidence": cited(1), "basisClaimIds": ids(1, 100), "rationale": reason}, open_keys=base),
        "suggestion": thing({"basisClaimIds": ids(1, 100), "rationale": reason, "sourceImposed": flag, "execution": literal("manual_user_choice")}, after={"sourceImposed": not_imposed("suggestion_not_source_imposed")}, open_keys=base),
        "not_confirmed": thing({"evidence": cited(0), "reason": reason}, open_keys=base),
        "conflict": thing({"alternatives": each(alternative, 2, 20), "rationale": reason}, after={"alternatives": _distinct_segments}, open_keys=base),
    }, base)
    members = {"id": ident, "title": plain(300), "statement": plain(8000), "materiality": one_of("material", "supporting"), "normalizedValues": each(value, 0, 100)}

    def check(at: At) -> str:
        provenance = s(at, "provenance")
        asserted = found(at.under(1 + len(members), 9), (f"{provenance} IN ('suggestion', 'not_confirmed') AND size({V.records(V.get(at.v, 'normalizedValues'))}) > 0", at["normalizedValues"].path, "asserted_value_not_allowed"))
        own = [*(c(at[k].under(1 + n)) for n, (k, c) in enumerate(members.items())), asserted]
        if validated:
            own.append(claim_validation(at["validation"].under(2 + len(members)), provenance))
        return both(kinds(at.under(0)), given(V.is_object(at.v), both(*own)))

    return Check(lambda at: bound(at, check), lambda at: none(check(at)))


# --- actions, questions, the analysis ----------------------------------------------------------------------------------------

timing = variants("kind", {
    "calendar_date": thing({"date": day, "basisClaimId": ident}, open_keys=["kind"]),
    "condition": thing({"label": plain(300), "basisClaimId": ident}, open_keys=["kind"]),
    "none": thing({}, open_keys=["kind"]),
})


def action_validation(at: At, timing_kind: str) -> str:
    checks = V.get(at.v, "checks")
    of = lambda name: V.string(V.get(checks, name))
    whole = f"{s(at, 'state')} = 'accepted' AND {V.is_object(checks)}"
    expected = f"if({timing_kind} <=> 'none', 'not_applicable', 'passed')"
    own = lambda at: both(
        _state_and_issues(at),
        found(
            at,
            (f"{whole} AND NOT {of('basis')} <=> 'passed'", at["checks"]["basis"].path, "accepted_without_basis_check"),
            (f"{whole} AND NOT {of('safety')} <=> 'passed'", at["checks"]["safety"].path, "accepted_without_safety_check"),
            (f"{whole} AND NOT {of('timing')} <=> {expected}", at["checks"]["timing"].path, "accepted_without_timing_check"),
            first=2,
        ),
    )
    return thing(_attested({"basis": one_of("passed", "failed"), "timing": one_of("passed", "failed", "not_applicable"), "safety": one_of("passed", "failed", "needs_review")}), more=own)(at)


def action(validated: bool, product: str):
    def imposed(at: At) -> str:
        return both(
            not_imposed("requirement_not_source_imposed", "{p} = 'document_requirement'", "FALSE")(at),
            not_imposed("suggestion_source_imposed", f"{{p}} = '{product}_suggestion'")(at.under(1)),
        )

    def attested(at: At) -> str:
        kind = V.string(V.get(V.get(at.v, "timing"), "kind"))
        return given(V.is_object(V.get(at.v, "timing")), action_validation(at["validation"], kind))

    members = {
        "id": ident, "provenance": one_of("document_requirement", f"{product}_suggestion"), "order": integer(0, 200), "priority": one_of("critical", "high", "normal", "low"), "title": plain(300), "description": plain(4000),
        "basisClaimIds": ids(1, 100), "requiredInputs": listed(plain(2000), 0, 100), "sourceImposed": flag, "execution": literal("manual_user_choice"), "timing": timing,
    }
    order = [*list(members)[:8], "consequence", *list(members)[8:]]
    consequence = thing({"text": plain(2000), "basisClaimIds": ids(1, 100)})
    return thing(members, {"consequence": consequence}, attested if validated else None, ["validation"] if validated else [], order, {"sourceImposed": imposed})


question = thing({"id": ident, "text": plain(1000), "reason": plain(2000), "basisClaimIds": ids(0, 100)})
document = thing({"documentType": token, "titleClaimId": ident, "purposeClaimId": ident, "actionRequiredClaimId": ident}, {"nearestDeadlineClaimId": ident, "primaryActionId": ident})
SECTIONS = ("briefClaimIds", "factClaimIds", "attentionClaimIds", "missingInformationClaimIds", "conflictClaimIds", "planActionIds")
sections = thing(dict.fromkeys(SECTIONS, ids(0, 500)))


#: Where members of an analysis come that don't follow at once, and where the elements of its arrays do (the revisions that it names are looked up at 6, relations begin at 15).
ANALYSIS_RANKS = {"document": 7, "claims": 8, "actions": 10, "questions": 12, "sections": 14}


def analysis(validated: bool, product: str = PRODUCT):
    return thing({
        "kind": literal(f"{product}.validated_analysis" if validated else f"{product}.model_draft"), "schemaVersion": literal("1.0.0"), "analysisId": ident, "knowledgeMode": literal("source_only"), "sourceRevisionIds": ids(1, 100),
        "document": document, "claims": array_of(1, 500), "actions": array_of(0, 200), "questions": array_of(0, 100), "sections": sections,
    }, ranks=ANALYSIS_RANKS)


def analysis_elements(validated: bool, product: str = PRODUCT) -> dict:
    return {"claims": claim(validated), "actions": action(validated, product), "questions": question}


# --- the receipt -------------------------------------------------------------------------------------------------------------

RELATED = ("source_admitted", "extraction_completed", "payload_previewed", "consent_recorded", "transfer_started", "transfer_completed", "analysis_completed", "validation_completed", "correction_recorded", "deletion_requested", "deletion_reported", "local_cleanup_completed")
OBSERVED = ("deletion_requested", "provider_reported_deleted", "locally_cleared")


def _needs(member: str, tag: str, tags: tuple[str, ...], code: str):
    listed_ = ", ".join(f"'{t}'" for t in tags)
    return lambda at: found(at, (f"{s(at, tag)} IN ({listed_}) AND NOT {V.has(at.v, member)}", at[member].path, code))


party = {"provider": plain(255), "model": plain(255)}
scope = {"sourceRevisionIds": ids(0, 100), "segmentIds": ids(0, 10_000), "contentCategories": choices(*CATEGORIES), "redactions": listed(plain(2000), 0, 500)}
consent = thing({"id": ident, "recordedAt": moment, "approvedBy": literal("user"), "recipient": plain(255), "previewDigest": digest, **scope}, party, order=("id", "recordedAt", "approvedBy", "recipient", *party, "sourceRevisionIds", "segmentIds", "contentCategories", "previewDigest", "redactions"))
policy = thing({"retention": one_of("none", "temporary", "provider_policy", "unknown"), "trainingUse": one_of("not_used", "may_be_used", "unknown"), "assertedBy": plain(255)}, {"policyUrl": url})
CLAIM_COUNTS = ("totalClaims", "accepted", "needsReview", "blocked", "stale")
ACTION_COUNTS = ("totalActions", "acceptedActions", "needsReviewActions", "blockedActions", "staleActions")
summary = thing({**dict.fromkeys(CLAIM_COUNTS, integer(0, 500)), **dict.fromkeys(ACTION_COUNTS, integer(0, 200))})
reference = thing({"id": ident, "url": url, "title": plain(500), "accessedAt": moment})


#: Where members of a receipt come; the elements of an array follow at the next rank, and what they are to others after that.
RECEIPT_RANKS = {"events": 4, "consentRecords": 14, "transfers": 18, "retention": 25, "components": 29, "validationSummary": 33, "externalReferences": 34, "correctionIds": 37}

receipt = thing({
    "id": ident, "createdAt": moment, "processingMode": one_of("sample", "browser_local", "desktop_local", "cloud_redacted", "cloud_full"), "events": array_of(1, 1000), "consentRecords": array_of(0, 1000), "transfers": array_of(0, 1000),
    "retention": array_of(1, 1000), "components": array_of(1, 50), "validationSummary": summary, "externalReferences": array_of(0, 100), "correctionIds": ids(0, 500),
}, ranks=RECEIPT_RANKS)


def receipt_elements(product: str = PRODUCT) -> dict:
    place = one_of(*locations(product))
    event = thing(
        {"id": ident, "sequence": integer(0, 1000), "occurredAt": moment, "type": one_of(*RELATED, "run_cancelled", "run_failed"), "status": one_of("completed", "failed", "cancelled"), "actor": thing({"location": place, "name": plain(128)})},
        {"relatedId": ident}, _needs("relatedId", "type", RELATED, "related_id_required"),
    )
    transfer = thing(
        {"id": ident, "consentId": ident, "startedAt": moment, "recipient": plain(255), "executionLocation": place, "payloadDigest": digest, "payloadByteCount": integer(1), "providerPolicy": policy, **scope}, {"completedAt": moment, **party},
        order=("id", "consentId", "startedAt", "completedAt", "recipient", *party, "executionLocation", "sourceRevisionIds", "segmentIds", "contentCategories", "payloadDigest", "payloadByteCount", "redactions", "providerPolicy"),
    )
    retention = thing(
        {"id": ident, "subject": one_of("browser", "device", product, "provider"), "state": one_of("not_stored", *OBSERVED, "status_unavailable"), "assertedBy": plain(255), "recordedAt": moment},
        {"eventId": ident}, _needs("eventId", "state", OBSERVED, "retention_event_required"),
    )
    component = thing({"component": one_of(product, "parser", "ocr", "prompt_template", "provider_model", "citation_validator"), "name": plain(255), "version": plain(128)})
    return {"events": event, "consentRecords": consent, "transfers": transfer, "retention": retention, "components": component, "externalReferences": reference}


correction = thing({
    "id": ident, "sourceId": ident, "priorRevisionId": ident, "targetSegmentId": ident, "targetSpan": span, "originalText": text(1, 20_000), "replacement": text(1, 20_000), "actor": literal("user"), "createdAt": moment,
    "resultingRevisionId": ident, "invalidatedClaimIds": ids(1, 500), "regeneratedClaimIds": ids(0, 500),
})


#: Where the parts of a pack come; limitations are looked at last.
PACK_RANKS = {"canonicalSources": 6, "analysis": 7, "receipt": 8, "corrections": 9, "limitations": 16}


def pack(at: At, product: str = PRODUCT) -> Found:
    """A whole document. Without a context that is an object, only the envelope and the limitations are looked at."""
    envelope = thing(
        {"kind": literal(f"{product}.action_pack"), "schemaVersion": literal("1.0.0"), "packId": ident, "createdAt": moment, "runMode": one_of("sample_fixture", "live"), "canonicalSources": context, "limitations": listed(plain(2000), 1, 100)},
        open_keys=["analysis", "receipt", "corrections"], ranks=PACK_RANKS,
    )
    inner = {"analysis": analysis(True, product), "receipt": receipt, "corrections": array_of(0, 500)}
    rest = lambda at: given(f"{V.is_object(at.v)} AND {V.is_object(V.get(at.v, 'canonicalSources'))}", both(*(check(at[k].under(PACK_RANKS[k])) for k, check in inner.items())))
    return Found.of(f"concat({envelope(at)}, {bound(at, rest)})", lambda: all_of(envelope.ok(at), none(rest(at))))
