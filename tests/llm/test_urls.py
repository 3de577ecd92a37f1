import re

import pytest

from wayloom.llm import urls as op

URLS = [
    None, "", "no scheme", "http://", "http://COM/en/", "https://www.Example.com/en/7?x", "https://www.example.com/en/8", "http://notexample.com/en/7",
    "ftp://a.net/de/1", "http://example.net/de/81", "http://b.example.net/de/8#x", "http://org/es/", "http://xorg/es/", "http://x.org?q=/es/", "http://x.org/ES/",
    "http://www.casino-win.example.org/en/1", "http://mycasino.org/", "http://free-bets.example.com/en/7", "http://free.bets.org/", "a://b://c/d", "http://x.com/en/\nz",
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [r for r in op.PREFIX_RULES for h, _, p in [r.name.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    parts = [f"{a}" for a in re.split(r"[.-]", host)]
    bad = any(".".join(parts).find("") >= 0 and re.search(rf"(^|[.-]){re.escape(r.name)}($|[.-])", host) for r in op.PATTERNS)
    return host, path, None, "block" if bad else "allow"


def test_rules_match_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS + URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op.judge_urls(pages).collect()}
    assert got == {i: brute(u) for i, u, _ in rows}
    assert op.judge_urls(pages.limit(0)).count() == 0


def test_rules_without_tokens_are_refused(spark):
    with pytest.raises(ValueError):
        op.judge_urls(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), rules=[op.Rule("x", "block", ".*", (), False)])
