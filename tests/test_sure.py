"""Conditions that a part has no issue: they hold of valid parts, so that these are not gone through, and of no part that has an issue."""

from __future__ import annotations

import json

import pytest

from attestry.operators import parts
from attestry.operators.structure import At, none
from tests import ledgers as L

SEGMENT, CONSENT, TRANSFER = L.context()["sourceSegments"][0], L.cloud()["receipt"]["consentRecords"][0], L.cloud()["receipt"]["transfers"][0]
ODD = [None, 5, -1, 1.5, 1e300, True, "", "a\u0007", "9x", "x" * 200_001, "<b>", "on a=", "😀" * 151, "2024-02-30T00:00:00Z", "0000-01-01T00:00:00Z", "2024-02-29T24:00:00+01:00", [], [1], ["a", "a"], {}, {"kind": "web", "url": "https://1.2.3"}]


def variants(part: dict) -> list[dict]:
    """The part with each member, and each one of a member, in turn missing or odd, and with one more."""
    made = [part, part | {"more": 1}]
    for name, value in part.items():
        made += [{k: v for k, v in part.items() if k != name}, *(part | {name: odd} for odd in ODD)]
        if isinstance(value, dict):
            made += [part | {name: inner} for inner in variants(value)]
    return made


@pytest.mark.parametrize("name", ["segment", "consent", "transfer"])
def test_sure_parts_have_no_issue(spark, name):
    part = {"segment": SEGMENT, "consent": CONSENT, "transfer": TRANSFER}[name]
    check = parts.segment if name == "segment" else parts.receipt_elements()[{"consent": "consentRecords", "transfer": "transfers"}[name]]
    issues = check(At("v", "'$'"))
    rows = [(k, json.dumps(x)) for k, x in enumerate(variants(part))]
    got = spark.createDataFrame(rows, "k long, s string").selectExpr("k", "parse_json(s) AS v").selectExpr("k", f"{none(issues)} AS sure", f"size({issues}) AS n").orderBy("k").collect()
    assert got[0].sure and not got[0].n and not got[1].sure
    assert all(r.sure is not None for r in got)
    assert [rows[r.k][1][:300] for r in got if r.sure and r.n] == []
