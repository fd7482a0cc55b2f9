"""Valid documents to mutate: a tenancy notice, as a sample, sent to a provider, and corrected once."""

from __future__ import annotations

import copy

T = "2027-03-01T09:00:0%d.000Z"
TEXTS = [
    "Notice of rent review for Flat 4, Quayside House.",
    "From 1 May 2027 the monthly rent will be EUR 1,150.",
    "Reply in writing by 5 April 2027 if you object.",
    "The deposit remains two months of rent.",
    "Schedule B gives the deposit as three months of rent.",
]
SEG = [f"seg.{k}" for k in range(5)]


def evidence(k: int, start: int = 0, end: int | None = None) -> dict:
    end = len(TEXTS[k]) if end is None else end
    return {"sourceId": "src.1", "sourceRevisionId": "rev.1", "segmentId": SEG[k], "quote": TEXTS[k][start:end], "span": {"start": start, "end": end}}


def claim(name: str, provenance: str, **more) -> dict:
    return {"id": f"claim.{name}", "provenance": provenance, "title": name.title(), "statement": f"About the {name}.", "materiality": "material", "normalizedValues": [], **more}


def claims() -> list[dict]:
    return [
        claim("title", "source_fact", evidence=[evidence(0)]),
        claim("rent", "source_fact", evidence=[evidence(1, 0, 10)], normalizedValues=[{"kind": "date", "value": "2027-05-01"}, {"kind": "money", "amount": "1150", "currency": "EUR", "basis": "monthly"}]),
        claim("reply", "source_fact", evidence=[evidence(2)], normalizedValues=[{"kind": "date", "value": "2027-04-05"}, {"kind": "duration", "value": 5, "unit": "week"}]),
        claim("order", "inference", evidence=[evidence(1), evidence(2)], basisClaimIds=["claim.rent", "claim.reply"], rationale="Both dates are stated."),
        claim("advice", "suggestion", basisClaimIds=["claim.reply", "claim.deposit"], rationale="The deposit is unclear.", sourceImposed=False, execution="manual_user_choice"),
        claim("parking", "not_confirmed", evidence=[], reason="No segment mentions parking."),
        claim("deposit", "conflict", alternatives=[{"statement": "Two months.", "evidence": [evidence(3)]}, {"statement": "Three months.", "evidence": [evidence(4)]}], rationale="Two segments disagree."),
    ]


def actions() -> list[dict]:
    common = {"priority": "high", "requiredInputs": ["A letter"], "execution": "manual_user_choice"}
    return [
        {"id": "action.reply", "provenance": "document_requirement", "order": 0, "title": "Reply", "description": "Object in writing.", "timing": {"kind": "calendar_date", "date": "2027-04-05", "basisClaimId": "claim.reply"}, "basisClaimIds": ["claim.reply"], "consequence": {"text": "Not stated.", "basisClaimIds": ["claim.parking"]}, "sourceImposed": True, **common},
        {"id": "action.ask", "provenance": "ledger_suggestion", "order": 1, "title": "Ask", "description": "Ask about the deposit.", "timing": {"kind": "condition", "label": "Before replying", "basisClaimId": "claim.deposit"}, "basisClaimIds": ["claim.deposit"], "sourceImposed": False, **common},
    ]


def context() -> dict:
    segment = lambda k: {"id": SEG[k], "sourceId": "src.1", "sourceRevisionId": "rev.1", "index": k, "text": TEXTS[k], "anchor": {"kind": "page_text", "page": 1, "block": k}, "extraction": {"method": "sample", "engine": "typed", "version": "1", "extractedAt": T % 1}}
    return {
        "sources": [{"id": "src.1", "displayName": "notice.pdf", "kind": "file", "mediaType": "application/pdf", "byteSize": 2048, "pageCount": 2, "origin": {"kind": "sample", "fixtureId": "fixture.1"}}],
        "sourceRevisions": [{"id": "rev.1", "sourceId": "src.1", "fingerprint": {"algorithm": "sha-256", "value": "1" * 64}, "createdAt": T % 0, "status": "active"}],
        "sourceSegments": [segment(k) for k in range(5)],
    }


def draft() -> dict:
    return {
        "kind": "ledger.model_draft", "schemaVersion": "1.0.0", "analysisId": "analysis.1", "knowledgeMode": "source_only", "sourceRevisionIds": ["rev.1"],
        "document": {"documentType": "rent_notice", "titleClaimId": "claim.title", "purposeClaimId": "claim.rent", "actionRequiredClaimId": "claim.reply", "nearestDeadlineClaimId": "claim.reply", "primaryActionId": "action.reply"},
        "claims": claims(), "actions": actions(), "questions": [{"id": "question.1", "text": "Which deposit applies?", "reason": "Two are given.", "basisClaimIds": ["claim.deposit"]}],
        "sections": {"briefClaimIds": ["claim.title", "claim.reply"], "factClaimIds": ["claim.rent", "claim.order"], "attentionClaimIds": ["claim.deposit"], "missingInformationClaimIds": ["claim.parking"], "conflictClaimIds": ["claim.deposit"], "planActionIds": ["action.reply", "action.ask"]},
    }


def _checked(c: dict) -> dict:
    unsure = c["provenance"] in ("not_confirmed", "conflict")
    support = "supported" if c["provenance"] in ("source_fact", "inference", "conflict") else "not_applicable"
    return {**c, "validation": {"state": "needs_review" if unsure else "accepted", "validatorVersion": "v1", "validatedAt": T % 4, "issueCodes": ["open_point"] if unsure else [], "checks": {"citation": "not_applicable" if support == "not_applicable" else "passed", "semanticSupport": support}}}


def event(k: int, kind: str, related: str, place: str = "browser", at: str | None = None) -> dict:
    return {"id": f"event.{k}", "sequence": k, "occurredAt": at or T % k, "type": kind, "status": "completed", "actor": {"location": place, "name": "ledger"}, "relatedId": related}


def pack() -> dict:
    analysis = draft() | {"kind": "ledger.validated_analysis"}
    analysis["claims"] = [_checked(c) for c in analysis["claims"]]
    done = {"state": "accepted", "validatorVersion": "v1", "validatedAt": T % 4, "issueCodes": [], "checks": {"basis": "passed", "timing": "passed", "safety": "passed"}}
    analysis["actions"] = [{**a, "validation": copy.deepcopy(done)} for a in analysis["actions"]]
    return {
        "kind": "ledger.action_pack", "schemaVersion": "1.0.0", "packId": "pack.1", "createdAt": T % 6, "runMode": "sample_fixture", "canonicalSources": context(), "analysis": analysis,
        "receipt": {
            "id": "receipt.1", "createdAt": T % 5, "processingMode": "sample",
            "events": [event(0, "source_admitted", "src.1"), event(1, "extraction_completed", "rev.1"), event(3, "analysis_completed", "analysis.1"), event(4, "validation_completed", "analysis.1")],
            "consentRecords": [], "transfers": [], "retention": [{"id": "retention.1", "subject": "browser", "state": "not_stored", "assertedBy": "ledger", "recordedAt": T % 5}],
            "components": [{"component": "ledger", "name": "ledger", "version": "1"}, {"component": "citation_validator", "name": "checks", "version": "1"}],
            "validationSummary": {"totalClaims": 7, "accepted": 5, "needsReview": 2, "blocked": 0, "stale": 0, "totalActions": 2, "acceptedActions": 2, "needsReviewActions": 0, "blockedActions": 0, "staleActions": 0},
            "externalReferences": [], "correctionIds": [],
        },
        "corrections": [], "limitations": ["Sample data."],
    }


def cloud() -> dict:
    p = pack()
    p["runMode"], p["createdAt"] = "live", T % 9
    r = p["receipt"]
    r["processingMode"], r["createdAt"] = "cloud_redacted", T % 9
    for c in p["analysis"]["claims"] + p["analysis"]["actions"]:
        c["validation"]["validatedAt"] = T % 7
    r["events"] = [event(0, "source_admitted", "src.1"), event(1, "payload_previewed", "consent.1"), event(2, "consent_recorded", "consent.1"), event(3, "transfer_started", "transfer.1", "ledger_service"), event(4, "transfer_completed", "transfer.1", "provider"), event(5, "analysis_completed", "analysis.1", "provider"), event(7, "validation_completed", "analysis.1", "ledger_service"), event(8, "local_cleanup_completed", "rev.1"), event(9, "deletion_reported", "transfer.1", "provider")]
    shared = {"recipient": "Provider", "provider": "P", "model": "m", "sourceRevisionIds": ["rev.1"], "segmentIds": ["seg.0", "seg.1"], "contentCategories": ["redacted_text"], "redactions": ["Name"]}
    print_ = {"algorithm": "sha-256", "value": "2" * 64}
    r["consentRecords"] = [{"id": "consent.1", "recordedAt": T % 2, "approvedBy": "user", "previewDigest": print_, **copy.deepcopy(shared)}]
    r["transfers"] = [{"id": "transfer.1", "consentId": "consent.1", "startedAt": T % 3, "completedAt": T % 4, "executionLocation": "provider", "payloadDigest": dict(print_), "payloadByteCount": 10, "providerPolicy": {"retention": "none", "trainingUse": "not_used", "assertedBy": "P"}, **copy.deepcopy(shared)}]
    r["retention"] = [{"id": "retention.1", "subject": "browser", "state": "locally_cleared", "assertedBy": "ledger", "recordedAt": T % 8, "eventId": "event.8"}, {"id": "retention.2", "subject": "provider", "state": "provider_reported_deleted", "assertedBy": "P", "recordedAt": T % 9, "eventId": "event.9"}]
    return p


def corrected() -> dict:
    p = pack()
    c = p["canonicalSources"]
    old = c["sourceRevisions"][0]
    new = copy.deepcopy(old) | {"id": "rev.2", "fingerprint": {"algorithm": "sha-256", "value": "3" * 64}, "createdAt": T % 2, "supersedesRevisionId": "rev.1"}
    old["status"] = "superseded"
    c["sourceRevisions"].append(new)
    before = copy.deepcopy(c["sourceSegments"][0]) | {"id": "seg.before"}
    for s in c["sourceSegments"]:
        s["sourceRevisionId"] = "rev.2"
    c["sourceSegments"].append(before)
    p["analysis"]["sourceRevisionIds"] = ["rev.2"]
    for claim_ in p["analysis"]["claims"]:
        for group in [claim_, *claim_.get("alternatives", [])]:
            for e in group.get("evidence", []):
                e["sourceRevisionId"] = "rev.2"
    r = p["receipt"]
    r["events"].insert(2, event(2, "correction_recorded", "correction.1"))
    r["correctionIds"] = ["correction.1"]
    p["corrections"] = [{"id": "correction.1", "sourceId": "src.1", "priorRevisionId": "rev.1", "targetSegmentId": "seg.before", "targetSpan": {"start": 0, "end": 6}, "originalText": "Notice", "replacement": "NOTICE", "actor": "user", "createdAt": T % 2, "resultingRevisionId": "rev.2", "invalidatedClaimIds": ["claim.title"], "regeneratedClaimIds": ["claim.title"]}]
    return p
