"""HTML extraction, top-k, mixing, licences."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import html_extract, licenses, mixing, topk

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy, now, please, really</div><div class="cookie-notice">We use cookies, many of them</div>
<article><h1>Title &amp; more</h1><p><b>First  para,
with &eacute; and 1 &lt; 2.<br><p>Second <a href="x">link</a> para.<div class="share">Share</div><form><p>Sign up, now</p></form><p>Short.</p></article>
<aside class="sidebar"><p>Related, things, to, read, that, are, long</p></aside><section id="comments"><p>Nice, post, I, say, so, very, much, indeed, yes</p></section><footer>&copy; x</footer></body></html>"""


def test_article_without_the_rest():
    assert html_extract.extract(PAGE) == "Title & more First para, with é and 1 < 2. Second link para. Short."


@pytest.mark.parametrize(
    "page,want",
    [(None, ""), ("", ""), ("<p>a", "a"), ("<html><body><!-- x", ""), ("<div><p>one, two</p><p>three</p></div>", "one, two three"), ("<script>x", ""), ("plain text", "plain text"), ("<article><p>a</article><p>b", "a"), ("<main><p>x</p><p cla", "x")],
)
def test_odd_pages(page, want):
    assert html_extract.extract(page) == want


def test_names():
    frame = '<body><div class="page has-sidebar"><div id="main-menu">Home, News, Sport</div>{}<div class="sidebar-left">Other, things, here</div></div></body>'
    article = '<article class="post"><header><h1>Head</h1></header><p>Text, of the article.</p></article>'
    comments = '<section id="comments"><article class="comment"><p>I, too, think, that, this, is, so, very, true, and, long</p></article></section>'
    assert html_extract.extract(frame.format(article + comments)) == "Head Text, of the article."
    assert html_extract.extract('<body><div class="content"><p>Some, text.</p><p>More, text.</p></div><div class="promo">Buy, this, now</div></body>') == "Some, text. More, text."


BODY = "<h1>Head</h1>" + "".join(f"<p>This, is paragraph {k} of the text, with commas, and words that go on.</p>" for k in range(4))
BODY_TEXT = "Head " + " ".join(f"This, is paragraph {k} of the text, with commas, and words that go on." for k in range(4))


@pytest.mark.parametrize(
    "page",
    [
        '<body><form id="aspnetForm"><nav>Menu, of, things</nav><div class="content">{}</div><label>Find it</label><input></form></body>',
        '<body><form action="/"><article>{}</article><button>Send</button></form><form><p>Search, now</p></form></body>',
        '<body><article>{}<form><p>Sign up, now</p></form><div class="related"><a href="x">Other thing to read, and one more</a></div></article></body>',
        '<body><article>{}</article><article class="comment"><p>I, too, think, so, very, much</p></article></body>',
    ],
)
def test_forms_around_and_inside_the_text(page):
    assert html_extract.extract(page.format(BODY)) == BODY_TEXT


def test_formulas_and_related_work_are_text():
    more = "Much was done before, by others, in many places, and it helps. " * 3
    page = f'<article>{BODY}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding="tex">x=2</annotation></math> holds.</p><section class="related"><h2>Related work</h2><p>{more}</p></section></article>'
    assert html_extract.extract(page) == f"{BODY_TEXT} So x=2 holds. Related work {more.strip()}"


def page_of(r, words):
    """(page, text) of an article among frames of many forms."""
    sentence = lambda n: " ".join(r.choices(words, k=n)).capitalize() + ", " + " ".join(r.choices(words, k=n)) + "."
    paragraphs = [" ".join(sentence(r.randint(4, 12)) for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 9))]
    title = " ".join(r.choices(words, k=4)).capitalize()
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.choices(words, k=8))
    frames = [f"<nav><ul>{links}</ul></nav>", f'<div class="main-menu"><ul>{links}</ul></div>', f'<div class="social-links">{links}</div>', f'<aside><h3>More</h3><p>{sentence(5)}</p></aside>', f'<div id="sidebar"><p>{sentence(6)}</p></div>', f'<div class="cookie-notice"><p>{sentence(9)}</p></div>', f'<div class="ad-box">{sentence(4)}</div>', f'<form><input name="q"><label>{sentence(3)}</label></form>', "<script>if (a < b) { x = '<p>no</p>' }</script>"]
    r.shuffle(frames)
    body = "".join(f"<p>{p.replace('a', '&#97;', 1)}</p>" if r.random() < 0.9 else f"<blockquote>{p}</blockquote>" for p in paragraphs)
    shape = r.choice(["<article><h1>{t}</h1>{b}</article>", '<div class="post-content"><h1>{t}</h1>{b}</div>', '<div id="x7"><h1>{t}</h1>{b}</div>', '<main><h1>{t}</h1><section class="social-studies">{b}</section></main>'])
    comments = f'<section id="comments"><h2>Comments</h2><p>{sentence(10)}</p><p>{sentence(12)}</p></section>'
    k = r.randint(0, len(frames))
    page = f"<html><head><title>T</title></head><body><header><p>{sentence(4)}</p></header>{''.join(frames[:k])}{shape.format(t=title, b=body)}{comments}{''.join(frames[k:])}<footer><p>{sentence(5)}</p></footer></body></html>"
    return page, " ".join([title, *paragraphs])


def test_labelled_pages():
    """Token precision and recall over pages of which the text is known."""
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ra", "tu") for b in ("na", "vel", "dor", "sim", "pet", "aga")]
    hit = got = want = whole = 0
    for _ in range(150):
        page, text = page_of(r, words)
        found = html_extract.extract(page)
        a, b = Counter(found.split()), Counter(text.split())
        hit, got, want, whole = hit + (a & b).total(), got + a.total(), want + b.total(), whole + (found == text)
    assert hit / got > 0.95 and hit / want > 0.95 and whole > 120


def test_names_weigh():
    assert html_extract.extract("<body><div>First one.</div><div>Second one.</div></body>") == "First one. Second one."
    assert html_extract.extract('<article><p>One, two.</p><div class="social-studies"><p>Three, four.</p></div><div class="social-links">Share</div></article>') == "One, two. Three, four."


def test_deep_nesting_does_not_recurse():
    assert html_extract.extract("<div>" * 20_000 + "<p>deep text, here</p>") == "deep text, here"


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "z"), (None, None, None, None), (1, "u", PAGE, "z")], "page_id bigint, url string, html string, text string")
    rows = html_extract.extract_pages(df).collect()
    assert len(rows) == 3 and {r["n_chars"] for r in rows} == {0, len(html_extract.extract(PAGE))}
    assert html_extract.extract_pages(df.limit(0)).collect() == []


def brute_topk(rows, k=10):
    good = [(i, [math.floor(float(x) * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in good if i % 100 == 0}.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
        out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 7e5, 1e9])
def test_topk(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "VECTORS_A_TILE", 16)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 2)
    monkeypatch.setattr(topk, "WAVE", 2)
    rng = np.random.default_rng(2)
    same = (rng.normal(size=6) * scale).astype(np.float32).tolist()
    rows = [(i, (rng.normal(size=6) * scale).astype(np.float32).tolist() if i % 3 else same) for i in range(0, 410, 2)]
    rows += [(500, None), (None, same), (503, [1.0, None]), (505, [float("nan")] * 6), (507, [float("inf")] * 6), (508, [0.5])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, v int, block int").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows)
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_topk_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id bigint, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in got] == [(1, 1), (2, 2)]


def cells_of(seed=3, shape=(4, 3, 2)):
    rng = np.random.default_rng(seed)
    at = [k.ravel() for k in np.indices(shape)]
    mass = rng.random(len(at[0])) * 100
    mass[rng.random(len(mass)) < 0.2] = 0
    return mass, at


def test_raking_meets_the_targets():
    mass, at = cells_of()
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.9, 0.1])]
    out = mass * mixing.rake(mass, at, targets)
    for k, t in zip(at, targets):
        assert np.allclose(np.bincount(k, out) / out.sum(), t, atol=1e-8)
    assert (mixing.rake(np.zeros(4), [np.arange(4)], [np.ones(4)]) == 1).all()


@pytest.mark.parametrize("targets", [None, {"source": {"s0": 0.5}, "lang": {"l0": 0.2, "l1": 0.3, "l2": 0.5}}])
def test_raking_tables_gives_the_weights_of_the_driver(spark, monkeypatch, targets):
    mass, at = cells_of(5, (6, 3, 2))
    rows = [(f"s{a}", f"l{b}", f"t{c}", int(m), 3) for m, a, b, c in zip(mass, *at)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint, n bigint")
    weights = []
    for most in (1000, 0):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", most)
        monkeypatch.setattr(mixing, "TOLERANCE", 1e-4)
        df, top = mixing.weights_of(cells, targets)
        weights.append(({tuple(r)[:3]: r["_weight"] for r in df.collect()}, top))
    (a, ta), (b, tb) = weights
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], rel=2e-2) for k in a) and ta == pytest.approx(tb, rel=2e-2)


def test_many_sources_all_have_targets(spark):
    """More sources than any fixed number of levels; each is met, a level without a target keeps its share of the rest."""
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 150).alias("source"))
    rows = mixing.mixed(many, {"source": {"s149": 0.05, "s3": 0.01}})
    total = rows.agg(F.sum("_copies")).first()[0]
    share = {r[0]: r[1] / total for r in rows.groupBy("_row.source").agg(F.sum("_copies")).collect()}
    assert share["s149"] == pytest.approx(0.05, abs=0.01) and share["s3"] == pytest.approx(0.01, abs=0.004) and share["s77"] == pytest.approx(0.94 / 148, abs=0.003)
    with pytest.raises(ValueError, match="s0"):
        mixing.mixed(many, {"source": {"s1": 1.0}}).count()


def test_rows_without_doc_id_are_drawn_one_by_one(spark):
    many = spark.range(2000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mixed(many, {"source": {"big": 0.5, "small": 0.5}}).where("_sampled").select("_row.source").groupBy("source").count().collect()}
    assert abs(got["big"] - 400) < 80 and got["small"] == 400


def test_mixing(spark, odd_docs, no_docs):
    rows = mixing.mixed(odd_docs)
    assert rows.count() == odd_docs.count() and rows.where("_probability < 0 or _probability > 1 or _probability is null").count() == 0
    assert mixing.mixed(no_docs).collect() == []
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mixed(many, {"source": {"big": 0.5, "small": 0.5}}).where("_sampled").select("_row.source").groupBy("source").count().collect()}
    assert abs(got["big"] - got["small"]) < 120 and got["small"] == 800


def test_mixing_raises_a_rare_level(spark):
    """A level under 2 % of the tokens is raised to its target, and the other axes keep theirs."""
    rare = F.col("id") % 200 == 0
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"), F.when(rare, "rare").otherwise("big").alias("source"))
    rows = mixing.mixed(many, {"source": {"rare": 0.3, "big": 0.7}, "lang": {"de": 0.2, "en": 0.8}})
    total = rows.agg(F.sum(F.col("_tokens") * F.col("_copies"))).first()[0]
    for axis, level, want in (("source", "rare", 0.3), ("lang", "de", 0.2)):
        part = rows.where(F.col(f"_row.{axis}") == level)
        assert abs(part.agg(F.sum(F.col("_tokens") * F.col("_copies"))).first()[0] / total - want) < 0.01


def test_licenses(spark, odd_docs, no_docs):
    mit = dict((n, t) for n, t in licenses.LICENSES if len(t) > 500)
    texts = ["Copyright (c) 2020 Someone\nAll rights reserved.\n" + mit["MIT"].upper().replace(",", " ,"), "text\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0.", mit["MIT"] + " and more", None, "", "© me"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert got[0]["license"] == "MIT" and got[2]["license"] is None
    assert got[1]["notices"] == "CC-BY-NC-4.0,MIT" and got[1]["n_notices"] == 2
    assert got[3]["digest"] is None and got[4]["digest"] is None and got[5]["digest"] is None
    header = "/*\n * Copyright 2021 Someone\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n */\nint main() {}\n"
    paragraphs = "My project\n\nIt works.\n\n" + mit["MIT"].split("MIT License (MIT)\n")[-1].replace("charge, to", "charge,\nto") + "\n\n# SPDX-License-Identifier: LGPL-2.1-or-later"
    more = spark.createDataFrame([(0, header), (1, paragraphs)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["notices"] for r in licenses.scan_licenses(more).collect()}
    assert found == {0: "Apache-2.0", 1: "LGPL-2.1,MIT"}
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count() and licenses.scan_licenses(no_docs).collect() == []
