"""Main text of pages: layouts whose articles are known, classes against a plain restatement, the given pages."""

import html
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.llm import html_extraction as ex
from touchline.llm.html_page import read

WORDS = "alpha beta gamma delta kappa omega sigma theta river stone cloud paper window garden music letter seven bright".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def article(rng):
    """Blocks of an article, with characters that need references."""
    return [prose(rng, 6).title(), *(prose(rng, rng.randrange(5, 60)) + rng.choice([".", " & so <on>.", " «é»"]) for _ in range(rng.randrange(1, 6)))]


def paragraphs(blocks, tag="p"):
    return "".join(f"<{tag}>{html.escape(b)}</{tag}>\n" for b in blocks)


def semantic(rng, blocks, k):
    return (
        f"<html><head><title>x</title><style>p{{}}</style></head><body><header><h1>The Site</h1><nav><a href=/a>Home</a></nav></header><div class='cookie-notice'>We use cookies {prose(rng, 3)}</div>"
        f"<main><article><header><h1>{html.escape(blocks[0])}</h1></header>{paragraphs(blocks[1:])}<div class=ad>{prose(rng, 9)}</div><form><label>Name</label><input name=q></form></article>"
        f"<section id=comments><h3>Comments</h3><p>{prose(rng, 40)}</p></section></main><aside>{prose(rng, 30)}</aside><footer>&copy; {prose(rng, 5)}</footer><script>var t = '<p>no</p>'</script></body>"
    )


def divisions(rng, blocks, k):
    """No element says what it is: names are arbitrary, and one notice is the same on every page."""
    links = "".join(f"<div class=z9><a href=/{k}-{i}>{prose(rng, 2)}</a></div>" for i in range(9))
    return (
        f"<div id=q1><div class=q2>{links}</div><div class=q4><h1>{html.escape(blocks[0])}</h1><div class=q5 id=p{k}>{paragraphs(blocks[1:], 'div')}"
        f"<div>Read all our terms before you go on and tell us what you think of them by letter please</div></div></div><div class=q6>Edition of the Daily {k % 7}</div></div>"
    )


def unclosed(rng, blocks, k):
    return f"<!DOCTYPE html><body><ul class=menu><li>One<li>Two</ul><article><h1>{html.escape(blocks[0])}</h1>" + "".join(f"<p><b>{html.escape(b)}<br>" for b in blocks[1:]) + f"</article><div class='sidebar'>{prose(rng, 30)}"


LAYOUTS = {"semantic.example": semantic, "divisions.example": divisions, "unclosed.example": unclosed}


@pytest.fixture(scope="module")
def made():
    rng, rows, want = random.Random(5), [], {}
    for host, layout in LAYOUTS.items():
        for k in range(30):
            blocks = article(rng)
            number = len(rows)
            rows.append((number, f"https://{host}/{k}?x={k}", layout(rng, blocks, k)))
            want[number] = "\n".join(blocks)
    return rows, want


def test_articles_of_known_layouts(spark, made):
    rows, want = made
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "tokens", "slots", "n", "kind", "text", "class")})
    got = ex.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_given_pages_are_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")

    def plain(source):
        inner = re.search("<article>(.*?)</article>", source, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", inner)]
        return "\n".join(b for b in blocks if b)

    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in ex.extract(pages).collect()} == {k: plain(x) for k, x in rows.items()}


def test_classes_equal_grouping_by_whole_vectors(spark, made):
    rows = [(r[1], r[2]) for r in made[0]] + [(made[0][0][1], made[0][0][2])] * 3
    pages = spark.createDataFrame(rows, "url string, html string").select(ex.host_of(F.col("url")).alias("host"), "html")
    got = set()
    for r in ex.equivalence_classes(ex.count_tokens(pages), ex.page_counts(pages)).collect():
        classes = defaultdict(set)
        for t in r["tokens"]:
            classes[t["class"]].add((t["kind"], t["token"]))
        got |= {(r["host"], frozenset(c)) for c in classes.values()}
    vectors, headings, n_pages = defaultdict(Counter), defaultdict(set), Counter()
    for k, (url, source) in enumerate(rows):
        host, page = url.split("/")[2], read(source)
        n_pages[host] += 1
        for token in ex.tokens_of(page):
            vectors[host, token][k] += 1
            headings[host, token].add(ex.heading(page))
    classes = defaultdict(set)
    for (host, token), vector in vectors.items():
        share = 0.5 if token[0] == ex.TEXT else 0.2
        if len(vector) >= share * n_pages[host] and (token[0] != ex.TEXT or len(headings[host, token]) >= 5):
            classes[host, frozenset(vector.items())].add(token)
    assert got == {(host, frozenset(c)) for (host, _), c in classes.items() if len(c) > 1}
    assert len(got) > 4


def test_classes_out_of_order_are_no_template(spark):
    """Two names that stand on every page, in either order, are text of the host, not of its template."""
    rows = [(k, "http://h/", f"<div class=a><h1>{k} {WORDS[k % 9]}</h1>" + "".join(f"<p>{x}</p>" for x in (["uno", "dos"] if k % 2 else ["dos", "uno"])) + f"<p>{prose(random.Random(k), 25)}</p></div>") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all({"uno", "dos"} <= set(r["text"].split("\n")) for r in ex.extract(pages).collect())
    same = spark.createDataFrame([(k, u, x.replace("<p>dos</p><p>uno</p>", "<p>uno</p><p>dos</p>")) for k, u, x in rows], "page_id long, url string, html string")
    assert not any({"uno", "dos"} & set(r["text"].split("\n")) for r in ex.extract(same).collect())


def test_copies_keep_their_text(spark):
    """A host of copies and near copies of one article: nothing of it becomes template."""
    blocks = article(random.Random(9))
    rows = [(k, "http://copies.example/a", semantic(random.Random(k), [blocks[0], *blocks[1:], f"Number {k % 4} of all"], k)) for k in range(40)]
    got = ex.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == "\n".join([*blocks, f"Number {r['page_id'] % 4} of all"]) for r in got)


def test_odd_pages(spark):
    long = "<p>" + "x" * 300_000 + "</p>" + "<div>" * 3000 + "deep" + "<p>wide</p>" * 3000
    rows = [(1, None, None), (1, None, None), (None, "", ""), (2, "no url", "plain  text here"), (3, "http://A.b/", "<"), (4, "http://a.B/x", "<p"), (5, "http://long/", long), (6, "http://c/", "<p>a</p></p>b<!-- <p>c</p>"), (7, "http://c/", '<a href="x>y<p>z')]
    got = ex.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "" and by[None] == "" and by[2] == "plain text here" and by[3] == "<" and by[6] == "a\nb" and by[4] == "<p" and by[7] == "y\nz"
    assert by[5].count("wide") == 3000 and "deep" in by[5] and len(by[5]) > 300_000
    assert ex.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<p>b<div>c</p>d</div>e", ["a", "b", "c", "d", "e"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>x", ["a", "b", "c", "d", "x"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("a < b &amp;&lt;p&gt; &#233;&nbsp;<i>c</i>d", ["a < b &<p> é cd"]),
        ("<SCRIPT>'</p>'</SCRIPT>k<style>x", ["k"]),
    ],
)
def test_blocks(source, want):
    assert [text for _, text, _ in read(source).blocks] == want
