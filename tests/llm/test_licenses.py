import re

from wayloom.llm import licenses as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in op.BASE_PHRASES.items():
        part = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(part)] == part]
        starts += hits
        labels |= {label} if hits else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(docs):
    got = op.scan_licenses(docs).collect()
    want = sorted(map(str, ((r["doc_id"], *brute(r["text"])) for r in docs.collect())))
    assert sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got) == want
    for r in got:
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_base_places_match_brute_force(sf_docs):
    check(sf_docs)


def test_hard_rows(spark, hard_docs):
    check(hard_docs)
    check(spark.createDataFrame([(1, "Under the MIT license; under-the-mit-license under the mit licenses CC BY-NC cc by nc nc cc\nby\tnc")], "doc_id long, text string"))
    assert op.scan_licenses(hard_docs.limit(0)).count() == 0


def test_expressions():
    assert op.to_postfix("a OR b AND c WITH d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert op.to_postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    for bad in ("", "a b", "and a", "(a", "a)", "a or", "()"):
        assert op.to_postfix(bad) is None
    assert op.evaluate("MIT OR GPL-3.0").satisfied
    assert not op.evaluate("MIT AND GPL-3.0").satisfied
    assert op.evaluate("MIT AND (GPL-2.0 OR ISC)").satisfied
    assert op.evaluate("Apache-2.0 WITH LLVM-exception").satisfied
    assert op.evaluate("MIT OR (").names == ("mit",)


def test_tags(spark):
    text = "// SPDX-License-Identifier: GPL-3.0-only OR MIT\ncode"
    row = op.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "gpl-3,mit" and row["n_tags"] == 1 and row["permitted"] and row["n_base"] == 0 and row["base_labels"] == ""
