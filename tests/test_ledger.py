"""Every issue code is raised by a mutation of a valid document; all of them are checked in one pass over many documents."""

from __future__ import annotations

import copy
import json
import time
from pathlib import Path

import pytest

from attestry.operators import engine
from tests import ledgers as L

MESSAGES = engine.messages("ledger")
PACKS = {"pack": L.pack, "cloud": L.cloud, "corrected": L.corrected}


def at(doc, path: str):
    """The container and last key of a path like a.b.0.c."""
    *way, last = path.split(".")
    for step in way:
        doc = doc[int(step)] if isinstance(doc, list) else doc[step]
    return doc, int(last) if isinstance(doc, list) else last


#: code: (fixture, path, new value); a callable gets the document.
A, R, C = "analysis", "receipt", "canonicalSources"
V0 = f"{A}.claims.0.validation"
SEG0 = f"{C}.sourceSegments.0"
MUTATIONS = {
    "invalid_type": ("pack", f"{A}.claims.0.title", 5),
    "unknown_field": ("pack", f"{A}.claims.0.confidence", 0.9),
    "too_few_items": ("pack", f"{A}.claims.0.evidence", []),
    "too_many_items": ("pack", f"{R}.components", [{"component": "ledger", "name": "n", "version": "1"}] * 50 + [{"component": "citation_validator", "name": "n", "version": "1"}]),
    "string_too_short": ("pack", f"{A}.claims.0.title", ""),
    "string_too_long": ("pack", f"{A}.claims.0.title", "😀" * 151),
    "control_character": ("pack", f"{A}.claims.0.title", "a\u0007"),
    "active_content": ("pack", f"{A}.claims.0.statement", "é < script >"),
    "invalid_id": ("pack", "packId", "pack\n"),
    "invalid_token": ("pack", f"{A}.document.documentType", "Rent"),
    "invalid_enum": ("pack", f"{A}.claims.0.materiality", "odd"),
    "invalid_literal": ("pack", "schemaVersion", "2.0.0"),
    "invalid_integer": ("pack", f"{C}.sources.0.byteSize", 1.5),
    "integer_out_of_range": ("pack", f"{C}.sources.0.pageCount", 0),
    "invalid_number": ("pack", f"{A}.claims.2.normalizedValues.1.value", "5"),
    "number_out_of_range": ("pack", f"{A}.claims.2.normalizedValues.1.value", 0),
    "invalid_timestamp": ("pack", f"{SEG0}.extraction.extractedAt", "2027-03-01"),
    "invalid_date": ("pack", f"{A}.claims.1.normalizedValues.0.value", "2026-02-30"),
    "url_credentials": ("pack", f"{C}.sources.0.origin", {"kind": "url", "url": "https://a:b@example.org/"}),
    "invalid_url": ("pack", f"{C}.sources.0.origin", {"kind": "url", "url": "ftp://example.org/"}),
    "invalid_digest": ("pack", f"{C}.sourceRevisions.0.fingerprint.value", "A" * 64),
    "duplicate_id": ("pack", f"{A}.actions.1.id", "action.reply"),
    "invalid_media_type": ("pack", f"{C}.sources.0.mediaType", "pdf"),
    "invalid_decimal_amount": ("pack", f"{A}.claims.1.normalizedValues.1.amount", "1,150"),
    "invalid_currency": ("pack", f"{A}.claims.1.normalizedValues.1.currency", "eur"),
    "origin_mismatch": ("pack", f"{C}.sources.0.kind", "url"),
    "region_out_of_bounds": ("pack", f"{SEG0}.anchor", {"kind": "page_region", "page": 1, "region": {"unit": "normalized", "x": 0.8, "y": 0, "width": 0.3, "height": 1}}),
    "invalid_span": ("pack", f"{A}.claims.0.evidence.0.span", {"start": 5, "end": 5}),
    "dangling_source": ("pack", f"{C}.sourceRevisions.0.sourceId", "src.9"),
    "dangling_revision": ("pack", f"{C}.sourceRevisions.0.supersedesRevisionId", "rev.9"),
    "revision_source_mismatch": ("corrected", f"{C}.sourceRevisions.1.sourceId", "src.9"),
    "revision_cycle": ("pack", f"{C}.sourceRevisions.0.supersedesRevisionId", "rev.1"),
    "segment_revision_mismatch": ("pack", f"{SEG0}.sourceId", "src.9"),
    "duplicate_segment_index": ("pack", f"{SEG0}.index", 1),
    "page_out_of_bounds": ("pack", f"{SEG0}.anchor.page", 3),
    "ocr_region_required": ("pack", f"{SEG0}.extraction.method", "ocr"),
    "revision_not_analyzed": ("corrected", f"{A}.claims.0.evidence.0.sourceRevisionId", "rev.1"),
    "dangling_segment": ("pack", f"{A}.claims.0.evidence.0.segmentId", "seg.9"),
    "stale_revision": ("pack", f"{C}.sourceRevisions.0.status", "superseded"),
    "evidence_source_mismatch": ("pack", f"{A}.claims.0.evidence.0.sourceId", "src.9"),
    "span_out_of_bounds": ("pack", f"{A}.claims.0.evidence.0.span.end", 500),
    "quote_mismatch": ("pack", f"{A}.claims.0.evidence.0.quote", "Something else"),
    "accepted_with_issues": ("pack", f"{V0}.issueCodes", ["late"]),
    "missing_issue_code": ("pack", f"{V0}.state", "blocked"),
    "unsupported_state": ("pack", f"{A}.claims.5.validation.state", "accepted"),
    "accepted_without_citation_check": ("pack", f"{V0}.checks.citation", "failed"),
    "accepted_without_semantic_support": ("pack", f"{V0}.checks.semanticSupport", "partial"),
    "invalid_suggestion_support_check": ("pack", f"{A}.claims.4.validation.checks.semanticSupport", "supported"),
    "suggestion_not_source_imposed": ("pack", f"{A}.claims.4.sourceImposed", True),
    "conflict_needs_distinct_evidence": ("pack", f"{A}.claims.6.alternatives.1.evidence", [L.evidence(3)]),
    "asserted_value_not_allowed": ("pack", f"{A}.claims.5.normalizedValues", [{"kind": "date", "value": "2027-01-01"}]),
    "accepted_without_basis_check": ("pack", f"{A}.actions.0.validation.checks.basis", "failed"),
    "accepted_without_safety_check": ("pack", f"{A}.actions.0.validation.checks.safety", "needs_review"),
    "accepted_without_timing_check": ("pack", f"{A}.actions.0.validation.checks.timing", "not_applicable"),
    "requirement_not_source_imposed": ("pack", f"{A}.actions.0.sourceImposed", False),
    "suggestion_source_imposed": ("pack", f"{A}.actions.1.sourceImposed", True),
    "dangling_claim": ("pack", f"{A}.actions.0.consequence.basisClaimIds", ["claim.none"]),
    "blocked_claim_reference": ("pack", f"{V0}.state", "blocked"),
    "invalid_inference_basis": ("pack", f"{A}.claims.3.basisClaimIds", ["claim.parking"]),
    "suggestion_chain": ("pack", f"{A}.claims.4.basisClaimIds", ["claim.advice"]),
    "claim_cycle": ("pack", f"{A}.claims.3.basisClaimIds", ["claim.order"]),
    "requirement_needs_source_fact": ("pack", f"{A}.actions.0.basisClaimIds", ["claim.reply", "claim.order"]),
    "timing_basis_missing": ("pack", f"{A}.actions.0.basisClaimIds", ["claim.rent"]),
    "date_needs_source_fact": ("pack", f"{A}.actions.0.timing.basisClaimId", "claim.order"),
    "timing_value_mismatch": ("pack", f"{A}.actions.0.timing.date", "2030-01-01"),
    "invalid_document_pointer": ("pack", f"{A}.document.titleClaimId", "claim.advice"),
    "invalid_deadline_pointer": ("pack", f"{A}.document.nearestDeadlineClaimId", "claim.deposit"),
    "dangling_action": ("pack", f"{A}.document.primaryActionId", "action.none"),
    "blocked_action_reference": ("pack", f"{A}.actions.0.validation.state", "stale"),
    "suggestion_in_brief": ("pack", f"{A}.sections.briefClaimIds", ["claim.advice"]),
    "wrong_section_provenance": ("pack", f"{A}.sections.factClaimIds", ["claim.deposit"]),
    "related_id_required": ("pack", lambda d: d[R]["events"][0].pop("relatedId"), None),
    "event_order": ("pack", f"{R}.events.2.sequence", 1),
    "event_time_order": ("pack", f"{R}.events.2.occurredAt", "2027-03-01T08:00:00Z"),
    "receipt_time_order": ("pack", f"{R}.createdAt", L.T % 3),
    "analysis_event_missing": ("pack", f"{R}.events.2.status", "failed"),
    "validation_event_missing": ("pack", f"{R}.events.3.relatedId", "analysis.2"),
    "untrusted_validation_actor": ("pack", f"{R}.events.3.actor.location", "provider"),
    "validation_before_analysis": ("pack", f"{R}.events.3.sequence", 2),
    "validation_time_mismatch": ("pack", f"{V0}.validatedAt", L.T % 3),
    "consent_event_missing": ("cloud", f"{R}.events.2.status", "cancelled"),
    "consent_event_time_mismatch": ("cloud", f"{R}.consentRecords.0.recordedAt", L.T % 1),
    "transfer_without_consent": ("cloud", f"{R}.consentRecords", []),
    "consent_mismatch": ("cloud", f"{R}.transfers.0.recipient", "Somebody else"),
    "payload_digest_mismatch": ("cloud", f"{R}.transfers.0.payloadDigest.value", "4" * 64),
    "transfer_before_consent": ("cloud", f"{R}.consentRecords.0.recordedAt", L.T % 8),
    "transfer_event_missing": ("cloud", f"{R}.events.3.status", "failed"),
    "transfer_event_time_mismatch": ("cloud", f"{R}.transfers.0.startedAt", L.T % 4),
    "transfer_completion_required": ("cloud", lambda d: d[R]["transfers"][0].pop("completedAt"), None),
    "transfer_time_order": ("cloud", f"{R}.transfers.0.completedAt", L.T % 2),
    "transfer_completion_event_missing": ("cloud", f"{R}.events.4.status", "failed"),
    "transfer_actor_mismatch": ("cloud", f"{R}.transfers.0.executionLocation", "device"),
    "transfer_event_order": ("cloud", f"{R}.events.4.sequence", 3),
    "unexpected_external_transfer": ("cloud", f"{R}.processingMode", "browser_local"),
    "missing_external_transfer": ("cloud", f"{R}.transfers", []),
    "redacted_mode_content_mismatch": ("cloud", f"{R}.transfers.0.contentCategories", ["redacted_text", "full_file"]),
    "redacted_mode_disclosure_missing": ("cloud", f"{R}.transfers.0.redactions", []),
    "full_mode_content_mismatch": ("cloud", f"{R}.processingMode", "cloud_full"),
    "receipt_revision_mismatch": ("cloud", f"{R}.transfers.0.sourceRevisionIds", ["rev.9"]),
    "receipt_segment_mismatch": ("cloud", f"{R}.transfers.0.segmentIds", ["seg.9"]),
    "receipt_segment_revision_mismatch": ("cloud", f"{R}.transfers.0.sourceRevisionIds", []),
    "retention_event_required": ("pack", f"{R}.retention.0.state", "locally_cleared"),
    "dangling_event": ("cloud", f"{R}.retention.0.eventId", "event.99"),
    "retention_event_mismatch": ("cloud", f"{R}.retention.0.eventId", "event.7"),
    "retention_event_not_completed": ("cloud", f"{R}.events.7.status", "failed"),
    "retention_event_time_mismatch": ("cloud", f"{R}.retention.0.recordedAt", L.T % 5),
    "retention_actor_mismatch": ("cloud", f"{R}.events.7.actor.location", "provider"),
    "retention_subject_mismatch": ("cloud", f"{R}.events.8.relatedId", "transfer.9"),
    "ledger_version_missing": ("pack", f"{R}.components.0.component", "parser"),
    "validator_version_missing": ("pack", f"{R}.components.1.component", "ocr"),
    "external_reference_in_source_only_mode": ("pack", f"{R}.externalReferences", [{"id": "ref.1", "url": "https://example.org/", "title": "A page", "accessedAt": L.T % 1}]),
    "summary_mismatch": ("pack", f"{R}.validationSummary.totalClaims", 9),
    "prior_revision_not_superseded": ("corrected", f"{C}.sourceRevisions.0.status", "active"),
    "resulting_revision_not_active": ("corrected", f"{C}.sourceRevisions.1.status", "superseded"),
    "correction_revision_mismatch": ("corrected", f"{C}.sourceRevisions.1.supersedesRevisionId", "rev.2"),
    "correction_source_mismatch": ("corrected", "corrections.0.sourceId", "src.9"),
    "unchanged_revision_fingerprint": ("corrected", f"{C}.sourceRevisions.1.fingerprint.value", "1" * 64),
    "correction_segment_mismatch": ("corrected", "corrections.0.targetSegmentId", "seg.0"),
    "correction_text_mismatch": ("corrected", "corrections.0.originalText", "Notise"),
    "regenerated_claim_revision_mismatch": ("corrected", "corrections.0.regeneratedClaimIds", ["claim.advice"]),
    "correction_event_missing": ("corrected", f"{R}.events.2.status", "failed"),
    "correction_event_time_mismatch": ("corrected", "corrections.0.createdAt", L.T % 1),
    "correction_actor_mismatch": ("corrected", f"{R}.events.2.actor.location", "provider"),
    "pack_time_order": ("pack", "createdAt", L.T % 1),
    "correction_receipt_mismatch": ("corrected", f"{R}.correctionIds", []),
    "run_mode_mismatch": ("pack", "runMode", "live"),
}


def mutated(code: str) -> str:
    fixture, where, value = MUTATIONS[code]
    doc = copy.deepcopy(PACKS[fixture]())
    if callable(where):
        where(doc)
    else:
        box, key = at(doc, where)
        box[key] = value
    return json.dumps(doc)


@pytest.fixture(scope="module")
def found(spark) -> dict[str, set[tuple[str, str]]]:
    astral = L.pack()  # offsets are UTF-16 units: two for each emoji
    astral["canonicalSources"]["sourceSegments"][0]["text"] = "😀" + L.TEXTS[0]
    astral["analysis"]["claims"][0]["evidence"][0]["span"] = {"start": 2, "end": 2 + len(L.TEXTS[0])}
    cut = copy.deepcopy(astral)
    cut["analysis"]["claims"][0]["evidence"][0]["span"]["start"] = 1
    markup = L.pack()
    markup["canonicalSources"]["sourceSegments"][3]["text"] = "<b>The deposit remains two months of rent.</b>"
    markup["analysis"]["claims"][6]["alternatives"][0]["evidence"][0] |= {"quote": "<b>The", "span": {"start": 0, "end": 6}}
    nulls = L.pack()
    nulls["analysis"]["document"]["primaryActionId"] = None
    whole = L.pack()
    whole["canonicalSources"]["sources"][0]["byteSize"] = 1e3
    rows = [(name, json.dumps(f())) for name, f in PACKS.items()] + [("astral", json.dumps(astral)), ("cut", json.dumps(cut)), ("markup", json.dumps(markup)), ("nulls", json.dumps(nulls)), ("whole", json.dumps(whole)), ("broken", "{not json"), ("null", None), ("list", "[]")]
    chain = L.pack()
    extra = copy.deepcopy(chain["analysis"]["claims"][3]) | {"id": "claim.then", "basisClaimIds": ["claim.order"]}
    chain["analysis"]["claims"].append(extra)
    chain["receipt"]["validationSummary"] |= {"totalClaims": 8, "accepted": 6}
    loops = copy.deepcopy(chain)
    loops["analysis"]["claims"][3]["basisClaimIds"] = ["claim.then", "claim.order", "claim.rent"]
    rows += [("chain", json.dumps(chain)), ("loops", json.dumps(loops))]
    rows += [(f"={code}", mutated(code)) for code in MUTATIONS] + [("everything", json.dumps(everything()))]
    written = json.dumps(L.pack())[1:-1]
    rows.append(("written", '{"zz": 1, "b": 2, "30": 0, ' + written.replace('"packId": "pack.1"', '"packId": "pack.1", "packId": 4') + ', "a": 1, "7": 0, "zz": [{"q": 1}]}'))
    docs = spark.createDataFrame(rows, "key string, raw string").repartition(4)
    checked = engine.validate_pack(docs).cache()
    issues = checked.collect()
    out: dict[str, set] = {key: set() for key, _ in rows}
    for r in issues:
        out[r["key"]].add((r["path"], r["code"]))
    in_order: dict[str, list] = {}
    for r in sorted(issues, key=lambda r: list(r["ord"])):
        in_order.setdefault(r["key"], []).append((r["path"], r["code"]))
    out["in order"], out["text"] = in_order, {r["key"]: r["text"] for r in engine.format_issues(checked).collect()}
    out["loops, listed"] = sorted((r["path"], r["code"]) for r in issues if r["key"] == "loops")
    assert {r["code"] for r in issues} <= set(MESSAGES)
    return out


@pytest.mark.parametrize("key", ["pack", "cloud", "corrected", "astral", "markup", "whole", "chain"])
def test_valid(found, key):
    assert found[key] == set()


@pytest.mark.parametrize("code", MUTATIONS)
def test_each_code(found, code):
    assert code in {c for _, c in found[f"={code}"]}


def everything() -> dict:
    """A pack with issues in all its parts."""
    b = L.cloud()
    c, a, r = b[C], b[A], b[R]
    b |= {"zeta": 1, "alpha": 2, "10": 3, "2": 4, "packId": "9", "runMode": "odd", "limitations": ["<b>", "<b>", 5]}
    c["sources"] += [{"id": "src.1", "kind": "url", "origin": {"kind": "upload", "x": 1}}, 7]
    c["sourceRevisions"].append(c["sourceRevisions"][0] | {"id": "rev.9", "sourceId": "src.9", "supersedesRevisionId": "rev.9"})
    c["sourceSegments"][1] |= {"index": 0, "anchor": {"kind": "page_text", "page": 9, "block": -1}}
    c["sourceSegments"][2]["id"] = "seg.1"
    a["sourceRevisionIds"] = ["rev.1", "rev.1", 4, "rev.8", "9"]
    a["document"] |= {"titleClaimId": "claim.none", "extra": 1}
    a["claims"].insert(0, "text")
    a["claims"][1] |= {"zz": 1, "aa": 1, "evidence": [{"sourceId": "src.x", "sourceRevisionId": "rev.x", "segmentId": "seg.x", "quote": "", "span": {"start": 3, "end": 2}}, L.evidence(1) | {"quote": "no"}]}
    a["claims"][4]["basisClaimIds"] = ["claim.order", 5, "claim.parking", "claim.none"]
    a["claims"][4]["validation"]["state"] = "blocked"
    a["claims"][5] |= {"sourceImposed": True, "execution": "auto"}
    a["claims"][7]["alternatives"][1]["evidence"] = [L.evidence(3)]
    a["claims"][7]["rationale"] = ""
    a["actions"][0] |= {"sourceImposed": False, "execution": "auto", "basisClaimIds": ["claim.order"]}
    a["actions"][0]["timing"]["date"] = "2030-01-01"
    a["actions"][1]["id"] = "action.reply"
    a["sections"] |= {"planActionIds": ["action.none"], "briefClaimIds": ["claim.advice"]}
    r["createdAt"] = "2020-01-01T00:00:00Z"
    r["events"][3]["sequence"] = 0
    r["events"][1]["id"] = "event.0"
    r["transfers"][0] |= {"recipient": "X", "redactions": [], "completedAt": "2020-01-01T00:00:00Z"}
    r["transfers"].append(copy.deepcopy(r["transfers"][0]) | {"consentId": "consent.9"})
    r["retention"][0]["eventId"] = "event.99"
    r |= {"components": [{"component": "odd"}], "externalReferences": [{"id": "r", "url": "ftp://x"}], "correctionIds": ["correction.9"]}
    r["validationSummary"]["accepted"] = 77
    return b


def issue_lists() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list] = {}
    for line in (Path(__file__).parent / "issue_lists.txt").read_text().splitlines():
        if line.startswith("  "):
            out[name].append(tuple(line.strip().rsplit(" ", 1)))
        elif not line.startswith("#"):
            out[name := line] = []
    return out


EXACT = issue_lists()


@pytest.mark.parametrize("code", MUTATIONS)
def test_exact_issues(found, code):
    assert found["in order"][f"={code}"] == EXACT[code]


def test_everything_in_order(found):
    """Array places, ranks of members and of rules; unknown members as they are written (numbers first); places among objects where rules count these."""
    assert found["in order"]["everything"] == EXACT["everything"]
    assert found["text"]["everything"].splitlines() == [f"{p} [{c}] {MESSAGES[c]}" for p, c in EXACT["everything"]]


def test_members_as_written(found):
    """Of members with one name the last counts, at the place of the first."""
    assert found["in order"]["written"] == [(f"$.{k}", "unknown_field") for k in ("7", "30", "zz", "b", "a")] + [("$.packId", "invalid_type")]


def test_each_way_back_is_a_cycle(found):
    assert found["loops, listed"] == [("$.analysis.claims", "claim_cycle")] * 2


def test_all_codes_are_covered():
    assert set(MUTATIONS) | {"parser_exception"} == set(MESSAGES) and len(MESSAGES) == 127


def test_unreadable(found):
    assert found["broken"] == found["null"] == {("$", "parser_exception")}
    assert found["list"] == {("$", "invalid_type")}


def test_details(found):
    assert ("$.analysis.claims[0].evidence[0].quote", "quote_mismatch") in found["cut"]  # no error inside a surrogate pair
    assert ("$.analysis.document.primaryActionId", "invalid_type") in found["nulls"]  # null is present, not absent
    assert any(p.endswith(".confidence") for p, _ in found["=unknown_field"])


def test_many_citations_of_one_segment(spark):
    """500 claims with 50 citations each of a text of 200,000 units: the text is made into UTF-16 once, not 25,000 times. Every tenth claim misquotes once."""
    text = "".join(chr(97 + k * k % 26) if k % 97 else "é" for k in range(199_998)) + "😀"
    context, draft = L.context(), L.draft()
    context["sourceSegments"][0]["text"] = text
    cite = lambda k, n: {"sourceId": "src.1", "sourceRevisionId": "rev.1", "segmentId": "seg.0", "quote": text[k + n : k + n + 20 + n % 7], "span": {"start": k + n, "end": k + n + 20 + n % 7}}
    draft["claims"] = [L.claim(f"c{n}", "source_fact", evidence=[cite(3900 * k, n) for k in range(50)]) for n in range(500)]
    for c in draft["claims"][::10]:
        c["evidence"][7]["quote"] = "x" + c["evidence"][7]["quote"][1:] + "y"
    draft["claims"][3]["evidence"][0]["span"] = {"start": -20, "end": 200_000}
    draft["claims"][3]["evidence"][0]["quote"] = text[-19:]  # 20 units, of which the last character has two
    draft["claims"][4]["evidence"][0]["span"]["end"] = 200_001
    began = time.perf_counter()
    issues = engine.validate_draft(spark.createDataFrame([("k", json.dumps(draft), json.dumps(context))], "key string, raw string, context string"))
    spans = sorted((r["path"], r["code"]) for r in issues.where("code IN ('quote_mismatch', 'span_out_of_bounds')").collect())
    assert spans == sorted([*((f"$.claims[{n}].evidence[7].quote", "quote_mismatch") for n in range(0, 500, 10)), ("$.claims[4].evidence[0].span.end", "span_out_of_bounds")])
    assert time.perf_counter() - began < 120


def test_context_draft_and_verdicts(spark):
    bad = {"sources": [{"id": "src.x"}], "sourceRevisions": [{"id": "rev.x"}], "sourceSegments": [{"id": "seg.x", "anchor": None, "extraction": None}]}
    contexts = spark.createDataFrame([("good", json.dumps(L.context())), ("bad", json.dumps(bad))], "key string, raw string")
    issues = engine.validate_context(contexts)
    got = {r["key"]: r for r in engine.verdicts(contexts, issues).collect()}
    assert got["good"]["success"] and got["good"]["trust"] == "structural"
    assert not got["bad"]["success"] and got["bad"]["trust"] == "rejected"
    text = {r["key"]: r["text"] for r in engine.format_issues(issues).collect()}
    assert "[dangling_source]" in text["bad"] and "good" not in text
    with pytest.raises(engine.LedgerError):
        engine.assert_valid(contexts, issues)
    with pytest.raises(engine.LedgerError):
        engine.assert_trusted(contexts)

    loop = L.draft()
    loop["claims"][3]["basisClaimIds"] = ["claim.order"]
    drafts = spark.createDataFrame([("good", json.dumps(L.draft()), json.dumps(L.context())), ("loop", json.dumps(loop), json.dumps(L.context())), ("none", json.dumps(L.draft()), "[]")], "key string, raw string, context string")
    codes: dict[str, set] = {}
    for r in engine.validate_draft(drafts).collect():
        codes.setdefault(r["key"], set()).add((r["path"], r["code"]))
    assert codes == {"loop": {("$.claims", "claim_cycle")}, "none": {("$context", "invalid_type")}}
