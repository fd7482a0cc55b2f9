"""Times and URLs as JavaScript takes them."""

from __future__ import annotations

import pytest

from attestry.functions import values as V

TIMES = {
    "2027-03-01T09:00:00Z": "2027-03-01 09:00:00", "2027-03-01T09:00Z": "2027-03-01 09:00:00", "2027-03-01T09:00:00.123456789Z": "2027-03-01 09:00:00.123456", "2027-03-01T09:00:00+02:00": "2027-03-01 07:00:00", "2027-03-01T09:00": "2027-03-01 09:00:00",
    "2027-02-31T10:00:00Z": "2027-03-03 10:00:00", "2027-03-01T24:00:00Z": "2027-03-02 00:00:00", "2027-03-01T24:00:01Z": None, "2027-03T10:00Z": "2027-03-01 10:00:00", "2027T10:00Z": "2027-01-01 10:00:00", "+002027-03-01T10:00Z": "2027-03-01 10:00:00",
    "-000000-03-01T10:00Z": None, "2027-13-01T10:00Z": None, "2027-03-32T10:00Z": None, "2027-03-00T10:00Z": None, "2027-03-01T25:00Z": None, "2027-03-01T10:60Z": None, "2027-03-01T10:00:60Z": None, "2027-03-01": None, "": None, "T": None, "tomorrow": None,
    "Mon, 01 Mar 2027 09:00:00 GMT": "2027-03-01 09:00:00", "Tue, 1 March 2027 9:05 EST": "2027-03-01 14:05:00", "1 Oct 2027 10:00 UTC": "2027-10-01 10:00:00", "Oct 1, 2027 10:00:07 PDT": "2027-10-01 17:00:07", "Thu Apr 01 2027 10:00:00 GMT+0200 (Central European Summer Time)": "2027-04-01 08:00:00",
    "01 Foo 2027 10:00 GMT": None, "31 Feb 2027 10:00 GMT": "2027-03-03 10:00:00", "Mon, 01 Mar 2027 24:30 GMT": None, "1 Oct 2027 10:00 GMT-03:30": "2027-10-01 13:30:00", "2027-03-01T09:00:00 Z": None, "2027-03-01T9:00Z": None,
}


def test_times(spark):
    rows = spark.createDataFrame([(k,) for k in [*TIMES, None]], "s string").selectExpr("s", f"CAST({V.instant('s')} AS STRING) AS at").collect()
    assert {r.s: r["at"] for r in rows} == TIMES | {None: None}


URLS = {
    "ok": [
        "https://example.org/", "http://example.org", "HTTPS://EXAMPLE.org:443/a?b#c", "  https://example.org/a b \n", "https:\\\\example.org\\a", "https:example.org", "https:///example.org", "http://a.b.c/\tx", "ht\ntp://example.org", "http://exa%6Dple.org", "http://münchen.de/",
        "http://1.2.3.4", "http://1.2.3", "http://0x7f.1", "http://017.0.0.1", "http://4294967295", "http://1.2.3.4.", "http://[::1]", "http://[1:2:3:4:5:6:7:8]:80/", "http://[::ffff:1.2.3.4]/", "http://example.org:65535", "http://example.org:/", "http://@example.org", "http://:@example.org/",
        "http://a_b.example", "http://ex+ample.org", "http://日本語。jp", "http://x..y/", "https://example.org/@user", "https://example.org?a@b",
    ],
    "credentials": ["https://a:b@example.org/", "http://user@example.org", "http://:secret@example.org", "http://a@b@example.org/", "http:a@example.org"],
    "invalid": [
        "", "example.org", "//example.org", "ftp://example.org", "mailto:a@b.c", "javascript:alert(1)", "http://", "https:///", "http://exa mple.org", "http://ex<ample", "http://a%2Fb", "http://a%zz", "http://example.org:65536", "http://example.org:8a", "http://256.1.1.1", "http://1.2.3.4.5",
        "http://1.2.3.08", "http://4294967296", "http://a.1", "http://[::1", "http://[::1]x", "http://[1:2:3]", "http://[1::2::3]", "http://[::g]", "http://[::1.2.3.256]", "http://a|b", "http://a^b", "https://user@", "http://%00/", "http:?a",
    ],
}


@pytest.mark.parametrize("kind", URLS)
def test_urls(spark, kind):
    rows = spark.createDataFrame([(u,) for u in URLS[kind]], "s string").selectExpr("s", f"{V.web_url('s')} AS kind").collect()
    assert [r.s for r in rows if r.kind != kind] == []


def test_no_url(spark):
    assert spark.createDataFrame([(None,)], "s string").selectExpr(f"{V.web_url('s')} AS kind").first().kind is None
