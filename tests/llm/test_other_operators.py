"""Web pages, archive records, vectors and the pipeline against brute-force versions."""

import collections
import datetime
import html as htmllib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint.llm import html_text, revisits, topk
from imprint.llm.queries import oracle_queries, registry

# ---------------------------------------------------------------- 3


@pytest.fixture(scope="module")
def tree():
    return html_text.train()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1><a href=/>Home</a></header><div class="cookie-notice">We use cookies, accept them all
now or read on for long.</div><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><main><article>
<header><h1>Title &amp; more</h1></header><p>First&nbsp; para &#233;<b>bold</b>\n\t text.<p>Ok.
<div class="ad">Buy now this wonderful thing that you need</div><p>Third <a href=x>link</a> para &lt;x&gt;.</p>
<form><label>Email</label><input><button>Go</button></form><aside>Side text</aside>
<section id="comments"><h2>Comments</h2><article class=comment><p>Great article I love it.</p></article></section>
</article></main><div id=sidebar><p>About the author, a long text about them that goes on here.</p></div>
<footer>&copy; all</footer></body></html>"""


def test_article_without_what_surrounds_it(tree):
    want = "Title & more\nFirst para ébold text.\nOk.\nThird link para <x>."
    assert html_text.main_text(PAGE, tree) == want


def test_broken_empty_and_long_pages(tree):
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == ""
    cut = PAGE[: PAGE.index("Third <a") + 8]
    assert html_text.main_text(cut, tree).endswith("Ok.\nThird")
    long = "<article>" + "<p>some words in a line &amp; more" * 20000 + "</article>"
    assert html_text.main_text(long, tree).count("\n") == 19999
    plain = "<body><p>" + "word " * 60 + "<p>" + "more " * 50 + "<ul><li><a>x</a><li><a>y</a></ul>"
    assert html_text.main_text(plain, tree).count("\n") == 1


def test_names_of_wrappers_and_small_parts_do_not_drop_articles(tree):
    long = "<p>" + "word " * 60 + "</p><p>" + "more " * 50 + "</p>"
    for page in (
        f"<div class='content-sidebar-wrap'><main>{long}</main></div>",
        f"<div class='has-sidebar'><article>{long}</article></div>",
        f"<div class=sidebar><article>{long}</article></div>",
        f"<form><main>{long}</main></form>",
        f"<div class=post-meta>By Ann Lee</div>{long}",
        f"<div class=story-teaser>By Ann Lee</div><div class=entry>Today</div>{long}",
    ):
        assert "word word" in html_text.main_text(page, tree) and "more more" in html_text.main_text(page, tree)
    apart = f"<article>{long * 2}</article><div>{'apart ' * 100}</div>"
    assert "apart" in html_text.main_text(apart, tree)
    for name in ("comments", "related-posts", "post-comments"):
        page = f"<article>{long}</article><div class={name}><article>{'other ' * 20}</article></div>"
        assert "other" not in html_text.main_text(page, tree)


def test_page_shapes_that_are_legal_or_common(tree):
    long = "<p>" + "word " * 60 + "</p><p>" + "more " * 50 + "</p>"
    want = ("word " * 60).strip() + "\n" + ("more " * 50).strip()
    head = "<html><head><title>Title of it</title><meta charset=utf-8>"
    for page in (
        f"<body><form action=x><input type=hidden name=v><input name=q><button>Go</button>{long}</form>",
        f"<body><form><div class='content'>{long}</div><input name=q></form>",
        f"{head}<style>p{{}}</style>{long}",  # neither </head> nor <body>
        f"{head}<script>1</script></head>{long}",
        f"<title>Title of it</title>{long}",
        f"{head}</head><body><svg/>{long}",
        f"{head}<body><div><svg><path d='x'/></svg></div>{long}",
        f"{head}<body><div class='related'><main>{long}</main></div>",
    ):
        assert html_text.main_text(page, tree) == want, page[:80]
    signup = "<form><label>Your name and address, please, for the weekly letter</label><input><input><button>Go</button></form>"
    assert html_text.main_text(f"<body>{long}{signup}", tree) == want
    assert html_text.main_text(f"<article>{long}{signup}</article>", tree) == want
    hidden = f"<div hidden><main>{'secret ' * 80}</main></div>"
    assert html_text.main_text(f"<body>{long}{hidden}", tree) == want
    assert html_text.main_text("<head>words straight in the head " + "and more of them " * 30, tree).startswith("words")


def test_time_grows_with_length_not_depth(tree):
    import time

    start = time.time()
    for page in (
        "<div>" * 100_000 + "text " * 50 + "</p>" * 100_000,
        "<b>" * 100_000 + "</i>" * 100_000 + "text",
        "<p><i>" + "<div><b>" * 50_000 + "</i>" * 50_000,
        "<a>" * 50_000 + "x<p>" * 50_000,
        "<ul><li>" * 50_000 + "</li></ul>" * 50_000,
    ):
        html_text.main_text(page, tree)
    assert time.time() - start < 10  # each about a second


def test_registered_pages_match_a_regular_expression(spark, sf_dir):
    got = {r.page_id: r for r in registry()["op3_flat_block_text"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html or "", re.S)
        parts = re.split(r"</?(?:p|h1|article)>", inner[1] if inner else "")
        parts = [" ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        text = "\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (text, len(text))


def test_pages_with_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>", "y"), (2, "u", PAGE, "z"), (2, "u", PAGE, "z")], "page_id long, url string, html string, text string")
    out = html_text.extract(df).collect()
    assert len(out) == 4 and sum(r.n_chars > 0 for r in out) == 2
    assert html_text.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]
    assert html_text.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 1

RECORD = "record_id long, record_type string, url string, captured timestamp, status int, headers map<string,string>, digest string, payload_length long, key string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def brute_resolve(rows):
    out = {}
    for r in rows:
        if r[1] != "revisit":
            continue
        norm = lambda h: {k.lower(): v for k, v in reversed(list((h or {}).items()))}
        before = [
            s for s in rows
            if s[1] == "response" and s[4] == 200 and s[2] and r[2] and s[3] and r[3]
            and s[2].lower() == r[2].lower() and s[3] < r[3]
        ]
        if not before:
            out[r[0]] = ("no_response", None, None)
            continue
        s = max(before, key=lambda s: (s[3], s[0]))
        a, b = norm(r[5]), norm(s[5])
        weak = lambda t: t and re.sub("^W/", "", t)
        same = None
        if a.get("etag") and b.get("etag"):
            same = weak(a["etag"]) == weak(b["etag"])
        elif a.get("last-modified") and b.get("last-modified"):
            same = a["last-modified"] == b["last-modified"]
        kind = "not_304" if r[4] != 304 else "unverified" if same is None else "resolved" if same else "mismatch"
        merged = {**b, **{k: v for k, v in a.items() if k in revisits.PERMITTED}} if kind == "resolved" else None
        out[r[0]] = (kind, s[0], merged)
    return out


def test_revisits_match_brute_force_with_a_hot_url(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        url = "HTTP://hot.example/a" if rng.random() < 0.4 else f"http://u{rng.integers(0, 40)}.example/p"
        kind = "response" if rng.random() < 0.1 else "revisit"
        when = at(int(rng.integers(0, 400)))
        tags = {} if rng.random() < 0.2 else {"ETag": rng.choice(['"a"', 'W/"a"', '"b"']).item()}
        if rng.random() < 0.5:
            tags["Last-Modified"] = rng.choice(["x", "y"]).item()
        tags["Content-Length"] = str(i)
        tags["DATE"] = str(i)
        status = 200 if kind == "response" and rng.random() < 0.9 else 304
        rows.append((i, kind, url, when, status, tags, f"d{i}" if kind == "response" else None, i, "clash"))
    rows += [(2000, "revisit", None, at(5), 304, None, None, None, None), (2001, "revisit", "http://u1.example/p", None, 304, None, None, None, None)]
    rows += [(2002, "response", None, at(1), 200, None, None, None, None), (2003, None, "x", at(1), None, None, None, None, None)]
    df = spark.createDataFrame(rows, RECORD).repartition(5)
    got = {r.record_id: (r.outcome, r.response_id, r.headers) for r in revisits.resolve_revisits(df).collect()}
    assert got == brute_resolve(rows)
    assert revisits.resolve_revisits(df.limit(0)).count() == 0
    body = spark.createDataFrame([(r[0], f"body{r[0]}") for r in rows], "record_id long, payload string")
    for r in revisits.attach_payload(revisits.resolve_revisits(df), body).collect():
        assert r.payload == (f"body{r.response_id}" if r.outcome == "resolved" else None)


def test_canonical_urls_and_header_names(spark):
    urls = {
        "HTTP://WWW.Ex.org:80/A/?utm_source=x&b=2&a=1#f": "ex.org/A?a=1&b=2",
        "https://ex.org": "ex.org", "ex.org/": "ex.org", "http://ex.org/p/?": "ex.org/p", "": "",
    }
    df = spark.createDataFrame([(u, k) for u, k in urls.items()], "u string, k string")
    assert df.filter(~revisits.canonical_url(F.col("u")).eqNullSafe(F.col("k"))).count() == 0
    one = spark.createDataFrame([({"ETag": "1", "etag": "2"},)], "h map<string,string>")
    assert len(one.select(revisits._headers(F.col("h")).alias("h")).first().h) == 1


# ---------------------------------------------------------------- 8


def brute_top(rows, k):
    fine = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine[i] = [math.floor(256 * np.float32(x).astype(float)) for x in v]
    out = []
    for q, a in fine.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in fine.items() if c != q and len(b) == len(a))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_topk_matches_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 20).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(1000, 1200)]
    rows += [(2000, None), (2001, [None] * 20), (2050, [float("nan")] * 20), (2100, [float("inf")] * 20), (None, rows[0][1]), (2150, [0.5] * 3), (2200, [])]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(4)
    want = brute_top(rows, 5)
    for candidates, queries in ((4096, 1024), (64, 3)):
        out = topk.top_k(df, F.col("id") % 50 == 0, candidates=candidates, queries=queries)
        assert sorted(map(tuple, out.collect())) == want
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_topk_repeated_query_rows_and_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(60)]
    rows += [(50, rows[50][1]), (50, rows[3][1])]  # the id of a query three times, twice with one vector
    schema = "vec_id long, embedding array<double>"
    out = topk.top_k(spark.createDataFrame(rows, schema), F.col("id") == 50, candidates=7, queries=2).collect()
    want = collections.Counter()
    for q, a in rows:
        if q == 50:
            dot = lambda b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))  # noqa: B023, E731
            best = sorted((-dot(b), c) for c, b in rows if c != 50)[:5]
            want.update((50, n, c, -s) for n, (s, c) in enumerate(best, 1))
    assert collections.Counter(map(tuple, out)) == want and len(out) == 15

    large = [(i, [float(rng.integers(-(2**40), 2**40)) for _ in range(9)]) for i in range(80)]
    large += [(100, [1e9] * 9), (101, [-1e9] * 9), (150, [1e300] + [0.0] * 8), (151, [1e300] + [0.0] * 8)]
    got = topk.top_k(spark.createDataFrame(large, schema), F.col("id") % 50 == 0, candidates=30).collect()
    top = (1 << 63) - 1
    scaled = {i: [max(-top - 1, min(top, math.floor(256 * x))) for x in v] for i, v in large}
    for q in (0, 50, 100, 150):
        best = sorted((-sum(x * y for x, y in zip(scaled[q], v)), c) for c, v in scaled.items() if c != q)[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert mine == [(n, c, max(-top - 1, min(top, -s))) for n, (s, c) in enumerate(best, 1)]


def test_bounds_drop_candidates_and_keep_the_best():
    rng = np.random.default_rng(4)
    cands = (rng.normal(0, 1, (3000, 64)) * np.linspace(3, 0.1, 64) * 100).astype(np.int64)
    for qid, ids, scores in topk.search_block(np.arange(20), cands[:20], np.arange(3000), cands, 5):
        exact = cands @ cands[qid]
        exact[qid] = -(2**62)
        best = np.lexsort((np.arange(3000), -exact))[:5]
        assert ids.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()


# ---------------------------------------------------------------- pipeline and contract


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, step in cp.STAGES[:-1]:
        docs = cp.stage(step(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= rows
        rows = docs.count()
    out = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert out.select("doc_id").distinct().count() == rows
    assert cp.run(spark, sf_dir).select("doc_id").distinct().count() == rows
    nothing = docs.limit(0)
    for _, step in cp.STAGES:
        assert step(spark, nothing, sf_dir).count() == 0


def test_clean_documents_stay(spark):
    """Every document labelled good and with ten words passes the quality rules."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    rows = registry()["op7_repetition_rules"](spark, sf).join(labels, "doc_id").filter("n_words >= 10 and not base_failed")
    assert rows.count() > 100 and rows.filter("not kept").count() == 0


def test_all_queries_are_registered():
    names = list(registry())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names[:-1]] == list(range(1, 14)) and names[-1] == "pipeline"
    assert set(oracle_queries()) <= set(names)
