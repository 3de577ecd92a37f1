import random

from wayloom.llm import html as op

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Top <b>bar</b></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies a lot on this site today</div>
<div class="ad">Buy this now, it is really a very good thing to have</div><article><h1>Head &amp; tail</h1><p><b>First  long paragraph
with many words in it, so that it is content.<br><p>Short.</p><ul><li>One</li><li>Two&nbsp;2</li></ul><form><label>Name</label><input></form>
<aside>Related things here</aside><p>Second long paragraph with many words in it as well &#233;.</p><section id="comments"><p>A reader says a lot of things here, too many words.</p></section></article>
<div class="sidebar"><p>Side text that is long enough to look like content at first sight.</p></div><footer>&copy; All</footer>"""


def test_article_without_the_rest():
    assert op.main_text(PAGE) == (
        "Head & tail\nFirst long paragraph with many words in it, so that it is content.\nShort.\nOne\nTwo 2\nSecond long paragraph with many words in it as well é."
    )


def test_page_without_article():
    body = "<body><div><a href=x>Home</a> <a href=y>News</a></div><p>A long first paragraph that tells something of interest to us.</p><p>Yes.</p><p>Another long paragraph which goes on for quite a while, too.</p><div><a href=z>More links here</a></div></body>"
    assert op.main_text(body).split("\n") == ["A long first paragraph that tells something of interest to us.", "Yes.", "Another long paragraph which goes on for quite a while, too."]


def test_broken_pages():
    for page in (None, "", "   ", "<", "<p", "</p></div>", "<nav>only a menu</nav>", "<script>x", "<!-- <p>no</p> -->"):
        assert "menu" not in op.main_text(page)
    assert op.main_text("plain words") == "plain words"
    assert op.main_text("<article><p>a" + "<b>" * 3000 + "x" + "</div>" * 50 + "<p>b") == "ax\nb"


def test_smoothing_and_threshold():
    assert all(abs(v - 3.0) < 1e-9 for v in op.smooth([3.0] * 5))
    cut = op.threshold([1, 2, 1, 50, 60, 55])
    assert 2 < cut < 50
    assert op.threshold([4.0, 4.0]) == 4.0


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "url", "html", "'clash' AS text", "1 AS other")
    extra = spark.createDataFrame([(None, None, None, "t", 2), (1, "u", "<p>a</p>", None, 2), (1, "u", "<p>a</p>", None, 2)], "page_id long, url string, html string, text string, other int")
    rows = op.extract_main_text(pages.union(extra)).collect()
    assert len(rows) == pages.count() + 3 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["text"] == "a" for r in rows) == 2 and sum(r["text"] == "" for r in rows) == 1
    assert op.extract_main_text(pages.limit(0)).count() == 0


LONG = ["A first paragraph long enough to stand out among all of the lines.", "The second one is as long and tells a good deal more than that does."]


def test_unclosed_link_and_misleading_names():
    body = "".join(f"<p>{t}</p>" for t in LONG)
    want = "\n".join(LONG)
    assert op.main_text(f"<body><div><a name=top>{body}</div></body>") == want
    assert op.main_text(f"<body><p><a href=x>Start<p>{LONG[0]}<p>{LONG[1]}") == "Start\n" + want
    for names in ("comments-open", "no-sidebar", "with-header has-nav", "single ads-disabled"):
        assert op.main_text(f'<body class="{names}"><div class="{names}">{body}</div></body>') == want, names
    for names in ("site-header", "main-nav", "post_comments", "ad-slot", "x sidebar"):
        assert op.main_text(f'<body>{body}<div class="{names}"><p>{LONG[0]} Not this.</p></div></body>') == want, names
    assert op.main_text(f'<body><div class="page sidebar-left"><article>{body}</article></div></body>') == want


def test_several_articles_and_their_headers():
    page = f"<body><article><header><h1>Head</h1></header><p>{LONG[0]}</p></article><nav>menu</nav><article><p>{LONG[1]}</p><p>Yes.</p></article></body>"
    assert op.main_text(page) == f"{LONG[0]}\n{LONG[1]}\nYes."
    assert op.main_text(f"<main><article><p>{LONG[0]}</p></article><div class=comments><article><p>{LONG[1]}</p></article></div></main>") == LONG[0]


def test_generated_pages_match_what_they_were_made_of(spark):
    rng = random.Random(12)

    def sentence(n):
        return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."

    noise = [
        lambda: f'<nav><ul>{"".join(f"<li><a href=/{i}>{sentence(2)}</a></li>" for i in range(5))}</nav>',
        lambda: f'<div class="{rng.choice(["ad", "cookie-banner", "site-footer", "sidebar", "related-posts"])}"><p>{sentence(25)}</p></div>',
        lambda: f"<header>{sentence(3)}</header>",
        lambda: f"<script>var x = '<p>{sentence(20)}</p>';</script>",
        lambda: f"<form><label>{sentence(2)}</label><input></form>",
        lambda: f"<!-- {sentence(9)} --><aside><p>{sentence(30)}</p></aside>",
    ]
    pages, want = [], []
    for i in range(120):
        marked = i % 2 == 0
        parts = [sentence(rng.randrange(18, 40)) for _ in range(rng.randrange(3, 8))]
        if marked:
            parts.insert(rng.randrange(len(parts)), sentence(1))  # a short paragraph counts, too
        body = "".join(f"<p>{p.replace(' ', chr(10) if rng.random() < 0.1 else ' ')}{'</p>' if rng.random() < 0.8 else ''}" for p in parts)
        before, after = ("".join(rng.choice(noise)() for _ in range(rng.randrange(4))) for _ in range(2))
        tag = "article" if marked else "div"
        pages.append((i, f"http://x/{i}", f"<html><head><title>{sentence(4)}</title></head><body>{before}<{tag}>{body}</{tag}>{after}</body></html>"))
        want.append("\n".join(parts))
    long = [sentence(30) for _ in range(8000)]
    pages.append((500, None, "<article>" + "".join(f"<p>{p}" for p in long)))
    want.append("\n".join(long))
    rows = op.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in sorted(rows, key=lambda r: r["page_id"])] == want
