"""Names, tokens and retrieval scenarios."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayloom.functions import names, text
from wayloom.functions import text as text_rules
from wayloom.operators import retrieval


@pytest.mark.parametrize(
    "raw, want",
    [(" 京承 高速 辅路 ", "京承高速"), ("三环主路辅路", "三环"), ("Unnamed", None), ("辅路", None), ("edge:7", "edge:7"), ("Main St (old)", "mainst"), (None, None)],
)
def test_normal_names(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "n string")
    assert df.select(names.normal_name(F.col("n"))).first()[0] == want


def test_aliases(spark):
    df = spark.createDataFrame([("京藏高速", "motorway"), ("g6", "primary"), ("北四环路", None), (None, "trunk")], "k string, h string")
    got = [r[0] for r in df.select(names.alias_tokens(F.col("k"), F.col("h"), F.lit("c"))).collect()]
    assert got[0] == ["alias:route:g6", "alias:express:京藏", "alias:corridor:c"]
    assert got[1] == ["alias:route:g6", "alias:corridor:c"]
    assert got[2] == ["alias:ring:四环", "alias:corridor:c"]
    assert got[3] == []


def test_tokens_cover_words_grams_and_codes(spark):
    df = spark.createDataFrame([("How is F7 路网图?",)], "t string")
    got = df.select(text.tokens(F.col("t"))).first()[0]
    assert got.count("f7") == 2 and {"路", "网", "图", "路网", "网图", "路网图"} <= set(got)
    assert "how" not in got and "is" not in got


GUIDE = "# Guide\nintro\n## F7 corridors\n- ranks `roads` by trips\n### Empty\n\n## F8 routes\nA to B [ways](x). Second sentence; third part.\n```\ncode\n```\n"


def test_sections_skip_empty_bodies_and_clean_markdown(spark):
    docs = spark.createDataFrame([("docs/a.md", GUIDE), ("docs/b.md", "plain text only")], "path string, content string")
    rows = {r["id"]: (r["title"], r["heading"], r["content"]) for r in retrieval.split_sections(docs).collect()}
    assert rows == {
        "docs/a.md#0": ("Guide", "F7 corridors", "ranks roads by trips"),
        "docs/a.md#1": ("Guide", "F8 routes", "a to b ways. second sentence; third part."),
        "docs/b.md#0": ("b", "b", "plain text only"),
    }


def test_asked_feature_wins_and_others_are_demoted(spark):
    docs = spark.createDataFrame([("docs/a.md", GUIDE)], "path string, content string")
    ask = spark.createDataFrame([(1, "F8 roads trips")], "qid long, question string")
    chunks = retrieval.split_sections(docs)
    hits = retrieval.top_chunks(ask, chunks, 5).orderBy("rank").collect()
    assert hits[0]["heading"] == "F8 routes" and hits[0]["score"] > 6
    assert all(h["score"] < 1 for h in hits[1:])
    best = retrieval.relevant_sentences(ask, retrieval.top_chunks(ask, chunks, 1), 2).collect()
    assert [b["position"] for b in best] == [0]


def test_postings_name_every_section_of_a_token(spark):
    docs = spark.createDataFrame([("docs/a.md", GUIDE)], "path string, content string")
    postings = retrieval.inverted_index(retrieval.split_sections(docs))
    assert postings.filter("token = 'guide'").count() == 2


def scan(questions, chunks, top_k):
    """Every section scored against every question, by the rule."""

    def words(text):
        plain = re.sub(r"\s+", " ", text.strip().lower())
        grams = [run[i : i + n] for run in re.findall("[一-鿿]+", plain) for n in (1, 2, 3) for i in range(len(run) - n + 1)]
        found = re.findall(text_rules.WORD, plain) + grams + re.findall(text_rules.FEATURE, plain)
        return [w for w in found if w not in text_rules.STOP_WORDS and len(w) <= text_rules.MAX_TOKEN]

    def squeezed(text):
        return re.sub(r"\s+", "", text.lower())

    counted = [(c, Counter(words(f"{c['title']} {c['heading']} {c['heading']} {c['content']}"))) for c in chunks]
    counted = [(c, n) for c, n in counted if n]
    df = Counter(w for _, n in counted for w in n)
    out = []
    for qid, question in questions:
        asked = Counter(words(question))
        codes = set(re.findall(text_rules.FEATURE, question.lower()))
        rows = []
        for c, n in counted if asked else []:
            head = set(words(f"{c['title']} {c['heading']}"))
            score = sum(q * n[w] / math.sqrt(n.total()) * (math.log((len(counted) + 1) / (df[w] + 0.5)) + 1) * (1.8 if w in head else 1.0) for w, q in asked.items() if w in n)
            score += 2.0 if squeezed(question) and squeezed(question) in squeezed(c["title"] + c["heading"] + c["content"]) else 0.0
            bonus = sum(6.0 if f in f"{c['title']} {c['heading']}".lower() else 2.0 if f in c["content"].lower() else 0.0 for f in codes)
            matched = not codes or bonus > 0
            score = (score + bonus) * (1.0 if matched else 0.03)
            label = f"{c['path']} {c['title']} {c['heading']}".lower()
            if any(p in question.lower() for p in text_rules.DETAIL_PHRASES) and matched and any(m in label for m in text_rules.DETAIL_MARKS):
                score += 5.0
            if score > 0:
                rows.append((-round(score, 6), c["path"], c["heading"], c["id"]))
        out += [(qid, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:top_k], start=1)]
    return out


def test_retrieval_equals_a_full_scan(spark):
    rng = random.Random(8)
    latin = ["route", "speed", "grid", "taxi", "hour", "f3", "f12", "cache", "the", "of", "map", "node"]
    han = "路径生成逻辑轨迹地图速度时间代码"

    def piece(n):
        return " ".join(rng.choice(latin) if rng.random() < 0.6 else "".join(rng.choice(han) for _ in range(rng.randrange(1, 5))) for _ in range(n))

    chunks = []
    for i in range(160):
        heading = rng.choice(["part one", "F3 panel", "代码逻辑", "路径生成逻辑 notes", "usage", ""])
        content = piece(rng.randrange(0, 25)) + rng.choice(["", " xf31y", " prefix-f12z", " supergridspeedway", " 超长路径生成"])
        chunks.append({"id": f"d{i % 40}#{i}", "path": f"docs/{i % 40}.md", "title": rng.choice(["Guide", "技术"]), "heading": heading, "content": content})
    asks = ["grid speed", "what is f3", "f31 and route", "路径生成怎么计算", "怎么实现 f12", "怎么算", "ridspeedw", "为什么可信", "the of", "", "f9", "taxi hour cache map node", "radius", "轨迹 地图", "长路径"]
    questions = list(enumerate(asks)) + [(100 + k, chunks[k]["content"][3:40]) for k in range(0, 60, 5)]
    q = spark.createDataFrame(questions, "qid long, question string")
    c = spark.createDataFrame([tuple(x.values()) for x in chunks], "id string, path string, title string, heading string, content string")
    for top_k in (1, 5):
        got = [(r["qid"], r["rank"], r["id"], r["score"]) for r in retrieval.top_chunks(q, c, top_k).collect()]
        want = scan(questions, chunks, top_k)
        assert sorted((a, b, i, round(s, 4)) for a, b, i, s in got) == sorted((a, b, i, round(s, 4)) for a, b, i, s in want)
    assert retrieval.top_chunks(q, c.limit(0), 5).count() == 0 == retrieval.top_chunks(q.limit(0), c, 5).count()
