"""Language, quality, search and page text: held-out accuracy, brute force, and small cases."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import htmltext, langid, quality, queries, search
from trackloom.llm.common import held_out

from .conftest import AWKWARD

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BIGGER = "/root/testdata/sf0.01"


def test_held_out(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in [*range(-5, 50), None]], "doc_id long").select("doc_id", held_out()).collect()}
    assert got.pop(None) is True
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}


# ---- language


def test_language_of_held_out_documents(spark):
    rows = queries.QUERIES["op1_language_id"](spark, BIGGER).join(spark.read.parquet(f"{BIGGER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in rows.collect() if r["held_out"]]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_letters_and_buckets():
    assert langid.letter_codes("!! 12 \n").size == langid.letter_codes("").size == 0
    assert "".join(chr(c or 32) for c in langid.letter_codes("Ab, c9É")) == " ab c é "
    codes = langid.letter_codes("abc " * 200_000)
    whole = Counter(np.concatenate(list(langid.buckets_of(codes))).tolist())
    # 1 to 3 grams of ' abc ' within the word and its bounds, whatever block they fall into
    one = Counter(np.concatenate(list(langid.buckets_of(langid.letter_codes("abc")))).tolist())
    assert whole == {bucket: 200_000 * n for bucket, n in one.items()}


def test_language_of_awkward_rows(docs):
    rows = [(i, t, "de" if i % 2 else "fr") for i, t in enumerate(["und der die das", "le la les des"] * 20)]
    model = langid.fit_languages(docs(rows))
    assert model.languages == ["de", "fr"]
    found = langid.identify(docs(AWKWARD), model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]  # the clashing score is replaced
    got = found.collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in model.languages) == letters and (r["lang_pred"] == "und") != letters
    assert langid.fit_languages(docs([])).languages == []
    assert {r["lang_pred"] for r in langid.identify(docs(AWKWARD), langid.fit_languages(docs([]))).collect()} == {"und"}
    kept = langid.keep_identified(docs(rows + [(900, "..."), (901, None)]))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == len(rows)


# ---- quality


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{BIGGER}/labels.parquet")
    rows = [r for r in queries.QUERIES["op4_quality"](spark, BIGGER).join(labels, "doc_id").collect() if r["held_out"]]
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    assert bad and sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(1 - r["predicted"] for r in bad) >= 0.8 * len(bad)
    above = sum((g["score"] > b["score"]) + 0.5 * (g["score"] == b["score"]) for g in good for b in bad)
    assert above >= 0.95 * len(good) * len(bad)


def test_statistics():
    assert quality.statistics("") == [0.0] * len(quality.STATISTICS)
    one = dict(zip(quality.STATISTICS, quality.statistics("Aa bb\nbb 1!"), strict=True))
    assert one["upper"] == pytest.approx(1 / 11) and one["digits"] == pytest.approx(1 / 11) and one["bangs"] == pytest.approx(1 / 11)
    assert one["same_as_before"] == pytest.approx(1 / 3) and one["distinct_lines"] == 1
    # segments are weighted by their length
    long = "word " * 120_000
    assert quality.statistics(long)[2:8] == pytest.approx(quality.statistics("word " * 1000)[2:8], abs=1e-2)


def test_isotonic():
    assert quality._isotonic(np.array([1.0, 0.0, 2.0, 1.0]), np.array([1.0, 1.0, 3.0, 1.0])).tolist() == [0.5, 0.5, 1.75, 1.75]


def test_random_features_approximate_a_gaussian_kernel():
    chance = np.random.default_rng(0)
    n = len(quality.STATISTICS)
    rows = chance.normal(size=(30, n))
    model = quality.QualityModel(
        np.zeros(n), np.ones(n), chance.normal(size=(n, 20_000)) / quality.WIDTH, chance.uniform(0, 2 * np.pi, 20_000), 0.0, np.zeros(1), rows, rows
    )
    z = model.features(rows)
    exact = np.exp(-((rows[:, None] - rows[None]) ** 2).sum(-1) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_quality_of_awkward_rows(spark, docs):
    rows = [(i, ("good text of words " * (i % 5 + 1)) if i % 2 else "XX !!! ||| XX XX " * (i % 7 + 1)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(5, None), (None, 1), (7, 1)], "doc_id long, quality long")
    model = quality.fit_quality(docs(rows), labels)
    found = quality.score_quality(docs(AWKWARD + rows), model)
    assert found.columns == ["doc_id", "text", "lang", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(AWKWARD) + len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = quality.fit_quality(docs([]), labels)
    assert {r["score"] for r in quality.score_quality(docs(AWKWARD), none).collect()} == {0.5}
    kept = quality.keep_good(docs(rows), labels)
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert {r["doc_id"] % 2 for r in kept.collect()} == {1}


# ---- search


def bm25(rows, queries_, k):
    texts = [(i, search.terms_of(t or "")) for i, t in rows if i is not None]
    mean = max(1.0, sum(len(t) for _, t in texts) / max(1, len(texts)))
    df = Counter(w for _, t in texts for w in set(t))
    out = []
    for q, text in queries_:
        asked = Counter(search.terms_of(text or ""))
        scores = []
        for i, words in texts:
            tf = Counter(words)
            s = sum(
                n * math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (search.K1 + 1)
                / (tf[w] + search.K1 * (1 - search.B + search.B * len(words) / mean))
                for w, n in asked.items() if tf[w]
            )
            if s > 0:
                scores.append((-round(s, search.DIGITS), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_search_against_brute_force(docs, small, monkeypatch):
    if small:  # many shards and task groups
        for name, value in (("SHARD_ROWS", 20), ("SHARD_WORDS", 2000), ("BLOCK", 4), ("TASK_BYTES", 3000), ("TASK_QUERIES", 5)):
            monkeypatch.setattr(search, name, value)
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 100])))) for i in range(180)]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + [(900, None), (None, "w1 w2"), (901, "w1 " * 3000)]
    asked = [(i, t) for i, t in rows if i is not None and i % 10 == 0] + [(7000, "unseen"), (7001, None), (7002, "W1 w1 w2")]
    df = docs(rows)
    got = search.search(df, docs(asked).select(F.col("doc_id").alias("query_id"), "text"), k=5).collect()
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got)
    want = bm25(rows, asked, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_search_does_not_shuffle_the_index(spark, docs, monkeypatch):
    """Neither the index for each block of queries nor the queries for each part of the index."""
    monkeypatch.setattr(search, "SHARD_ROWS", 10)
    monkeypatch.setattr(search, "TASK_QUERIES", 4)
    explained, plain = {}, search.settle

    def explain(df):
        return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def watched(df, label="table", **more):
        explained[f"{label} {len(explained)}"] = explain(df)
        return plain(df, label, **more)

    monkeypatch.setattr(search, "settle", watched)
    rows = [(i, f"all{i % 2} w{i % 7} v{i % 5}") for i in range(60)]
    found = search.search(docs(rows), docs(rows).selectExpr("doc_id as query_id", "text"), k=3)
    explained["result"] = explain(found)
    assert found.count() == 180
    for label, plan in explained.items():
        if not label.startswith("index"):
            sent = "".join(re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan))
            assert not re.search(r"\b(lengths|counts|rows|terms)#", sent), label


def test_search_adds_up_in_pieces(docs, monkeypatch):
    """Few postings at once, and what is kept merged often, lead to the same results."""
    for name, value in (("POSTINGS", 3), ("KEPT", 1), ("TOGETHER", 7), ("SHARD_ROWS", 40), ("BLOCK", 4), ("FREQUENT", 0.5)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.choice([0, 3, 30])))) for i in range(100)]
    rows += [(i, rows[i - 200][1]) for i in range(200, 230)]
    asked = docs(rows).selectExpr("doc_id as query_id", "text")
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in search.search(docs(rows), asked, k=4).collect())
    assert got == [w[:3] for w in bm25(rows, rows, 4)]


def test_search_of_awkward_rows(docs):
    df = docs([r for r in AWKWARD if r[0] != 7])
    asked = df.select(F.col("doc_id").alias("query_id"), "text")
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in search.search(df, asked, k=3).collect())
    want = bm25([(r[0], r[1]) for r in AWKWARD if r[0] != 7], [(r[0], r[1]) for r in AWKWARD if r[0] not in (7, None)], 3)
    assert got == [w[:3] for w in want]
    empty = docs([])
    assert search.search(empty, asked).collect() == []
    assert search.search(df, empty.select(F.col("doc_id").alias("query_id"), "text")).collect() == []


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body class="no-sidebar">
<nav><ul><li><a href="/">Home</a></li></ul></nav><header><p>Site name</p></header><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div id="ad1">Buy now</div><aside>Aside</aside>
%s
<div class="comments"><article class="comment"><p>First! What a great long comment this is, really, by a reader.</p></article></div>
<form><p>Your name</p><input></form><footer>Foot &copy;</footer></body></html>"""
ARTICLE = """<h1>The  title &amp; more</h1><p>One <b>bold</b> and <a href="/x">link</a>
 text.<br><p>Two&nbsp;&eacute;&#233;&#x1F600;</p><ul><li>a<li>b</ul><pre>x
  y</pre><table><tr><td>1<td>2</table><blockquote>"quoted"</blockquote>"""
TEXT = "The title & more\nOne bold and link text.\nTwo éé\U0001f600\na\nb\nx y\n1\n2\n\"quoted\""


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main><article>%s</article></main>", "<main>%s</main>"])
def test_article_is_extracted(frame):
    assert htmltext.extract(PAGE % (frame % ARTICLE)) == TEXT


def test_article_in_plain_divs():
    paragraphs = "".join(f"<p>Paragraph {i} of the main text, which goes on for quite some words about its matter.</p>" for i in range(6))
    links = "<div>" + "".join(f'<a href="/{i}">link {i} to somewhere</a> ' for i in range(12)) + "</div>"
    page = f"<html><body>{links}<div><h1>A title of some length for it</h1>{paragraphs}</div>{links}</body></html>"
    found = htmltext.extract(page).split("\n")
    assert found[-6:] == [f"Paragraph {i} of the main text, which goes on for quite some words about its matter." for i in range(6)]
    assert not any("link 3" in x for x in found)


def test_awkward_pages(spark):
    for html, text in [
        (None, ""), ("", ""), ("just text &lt;3", "just text <3"), ("<p>", ""), ("<", "<"), ("a < b", "a < b"), ("<p>unclosed", "unclosed"),
        ("</div></p>x", "x"), ("<article></article>", ""), ("<script>only()", ""), ("<!-- never ends <p>x</p>", ""), ("<p title='a>b'>x</p>", "x"),
        ("<article><p>" + "w " * 200_000 + "</p></article>", ("w " * 200_000).strip()), ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ('<article><p>a <a href="x>b</a> c</p><p>d</p></article>', "a b c\nd"),
    ]:
        assert htmltext.extract(html) == text, (html or "")[:50]
    df = spark.createDataFrame([(1, None, "x"), (1, "<article>a</article>", "x")], "page_id long, html string, main_text string")
    assert sorted(r["main_text"] for r in htmltext.extract_text(df).collect()) == ["", "a"]
    assert htmltext.extract_text(df.limit(0)).collect() == []


def test_article_in_parts():
    part = "<article><p>Part {} goes on for some words about its matter, and then a few more.</p></article>"
    text = [f"Part {i} goes on for some words about its matter, and then a few more." for i in range(3)]
    parts = "".join(part.format(i) for i in range(3))
    links = "<ul>" + "".join(f'<li><a href="/{i}">link {i} to somewhere</a></li>' for i in range(9)) + "</ul>"
    assert htmltext.extract(f"<body>{links}{parts}</body>") == "\n".join(text)
    assert htmltext.extract(f"<body>{links}<main><h1>Title</h1>{parts}</main></body>") == "\n".join(["Title", *text])
    assert htmltext.extract(f"<body>{parts}<article><p><a href='/'>only a link</a></p></article></body>") == "\n".join(text)


@pytest.mark.parametrize("wrapper", ["<div id='page' class='no-sidebar'>%s</div>", "<div class='share-page'>%s</div>", "<form>%s</form>"])
@pytest.mark.parametrize("inner", ["<article><h1>Title</h1><p>Some text.</p></article>", "<h1>Title</h1><p>Some text.</p>", "<p>Title</p><p>Some text.</p>"])
def test_marked_wrapper_keeps_its_article(wrapper, inner):
    assert htmltext.extract("<body>" + wrapper % inner + "</body>").endswith("Some text.")
    assert htmltext.extract(f"<body><div class='sidebar'><p>Beside.</p></div>{wrapper % '<article>Text.</article>'}</body>") == "Text."


def test_page_query(spark):
    """The generated pages hold one article each, whose blocks are known."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as h
    import re

    for r in queries.QUERIES["op8_html_text"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", re.sub("<br>", " ", inner))]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# ---- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns and dict(after.dtypes) == dict(docs.dtypes), name
        left, right = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert set(right) <= set(left), name
        if name == "quality classifier":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
            assert len(set(right) & bad) < 0.4 * len(set(left) & bad)
            assert len(right) >= 0.85 * len(left)
        elif name == "language ID":
            assert set(left) == set(right)  # all of them are prose in a learned language
        elif name == "line dedup":
            from .test_dedup import lines_brute

            want = {d: [x for i, x in enumerate(left[d]["text"].split("\n")) if i not in gone] for d, _, gone in lines_brute([(d, r["text"]) for d, r in left.items()])}
            assert {d: r["text"].split("\n") if want[d] else [] for d, r in right.items()} == {d: w or [] for d, w in want.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in right.values())
        else:
            from .test_dedup import near_brute

            assert set(right) == {c for _, _, c in near_brute([(d, r["text"]) for d, r in left.items()])}
        before = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in before.collect()}


def test_pipeline_runs_from_end_to_end(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
