import collections
import random
import time

import pytest

from tvloom.llm import html_extract as he

ROOT = he.token("")

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div>
<div class="cookie-notice">We use cookies</div><main><article class="post"><header><h1>A &amp; B&nbsp;C</h1></header><p>One<br>two <b>three</b>
 four<p>Five &lt;six&gt; <span class="ad">buy <i>now</i></span> seven<form><input>Name</form><ul><li>x<li>y</ul>
<aside>Related</aside><div id="comments"><p>Nice!</p></div></article></main><aside>Side</aside><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert he.main_text(PAGE, ROOT) == "A & B C\n\nOne two three four\n\nFive <six>\n\nseven\n\nx\n\ny"


def test_without_article():
    assert he.main_text("<body><div id=nav>Menu</div><div><p>Text</p></div><footer>f</footer>", ROOT) == "Text"
    assert he.main_text("plain 1 < 2 text", ROOT) == "plain 1 < 2 text"
    assert he.main_text("", ROOT) == ""


def test_broken_markup_ends():
    assert he.main_text("<p>a <a href=\"x>b</p><p>c</p>" * 2000, ROOT).startswith("a")
    assert he.main_text("<p>x</p><script>never closed <p>y</p>", ROOT) == "x"
    assert len(he.main_text("<" * 20000, ROOT)) == 20000
    began = time.time()
    for text in ("<a" * 1_000_000, "<a" * 100_000 + ">", "<a \"" * 100_000, "<a '\" " * 50_000 + ">", "<a x=" * 100_000 + ">"):
        he.main_text(text, ROOT)
    assert time.time() - began < 5


def test_a_word_in_a_name_drops_no_page():
    assert he.main_text("<body><article class='post category-social'><p>A</p></article>", ROOT) == "A"
    assert he.main_text("<body><div class='layout has-sidebar'><p>A</p><div class='sidebar'>s</div></div>", ROOT) == "A"
    assert he.main_text("<body><div id='page' class='no-comments'><p>A</p><div class='ad-300x250'>Buy</div></div>", ROOT) == "A"
    assert he.main_text("<body><form action='/'><div><p>A</p></div></form>", ROOT) == "A"
    assert he.main_text("<body><div class='social'><p>x</p><main><p>A</p><div class='share'>s</div></main></div><aside><article>t</article></aside>", ROOT) == "A"
    page = "<body><div class='widget'><article><p>A</p></article></div><div class='comments'><article><p>Nice!</p></article></div>"
    assert he.main_text(page, ROOT) == "A"


def pages(spark, n=12):
    rows = []
    for i in range(n):
        body = f"<article><h1>T{i}</h1><p>Story {i} {'word ' * i}</p><section><p>Follow our channel today</p></section></article>"
        rows.append((i, f"http://Host.example:80/p{i}", f"<html><body><div>Welcome</div>{body}</body></html>", "x"))
    rows += [(100, "http://other.example/", "<body><p>Follow our channel today</p></body>", "x"), (101, None, None, "x"), (102, "::bad::", "", "x"), (3, rows[3][1], rows[3][2], "x"), (None, "", "<p>only</p>", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_template_of_a_host_is_left_out(spark):
    got = {}
    for r in he.extract(pages(spark), keep=["page_id", "url"]).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[5] == ["T5\n\nStory 5 word word word word word"] and got[3] == [got[3][0]] * 2
    assert got[100] == ["Follow our channel today"] and got[101] == got[102] == [""] and got[None] == ["only"]
    found = {r.host: r for r in he.templates(pages(spark)).collect()}
    assert found["host.example"].slot == he.token("/html/body/article") and len(found["host.example"].constant) >= 2


def plain_layout(i, words, comments=True):
    """A page whose chrome stands in unnamed elements."""
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in random.Random(i).sample(words, 5))
    story = "".join(f"<p>Paragraph {k} of story {i} {' '.join(random.Random(i * 31 + k).choices(words, k=40))}</p>" for k in range(4))
    return f"<html><body><div><ul>{menu}</ul></div><div>We use cookies on this site, and you agree to all of them by reading on.</div><div><h1>Title {i}</h1>{story}</div><div>Buy {words[i % len(words)]} now</div><div>All rights reserved</div></body></html>"


def labelled(page):
    """Tell the elements apart, as sites do, by meaningless names."""
    parts = page.split("<div>")
    return parts[0] + "".join(f"<div class='x{k}'>{p}" for k, p in enumerate(parts[1:]))


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_chrome_in_unnamed_elements(spark, n):
    words = [f"word{k}" for k in range(60)]
    rows = [(i, f"http://h.example/{i}", labelled(plain_layout(i, words))) for i in range(n)]
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=["page_id"]).collect()}
    for i in range(n):
        assert got[i].startswith(f"Title {i}\n\nParagraph 0 of story {i}") and got[i].count("\n\n") == 4, got[i]
        assert he.main_text(rows[i][2], ROOT) != got[i]


def test_skeleton_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(60)]
    rows = []
    for i in range(40):
        extra = "<section><p>s</p></section>" * rng.randrange(3)
        rows.append((i, f"http://{rng.choice('abc')}.example/", labelled(plain_layout(i % 25, words)).replace("</body>", extra + "</body>")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    skeleton, constant = he.skeletons(df)
    got, got_constant = {(r.host, r.token) for r in skeleton.collect()}, {(r.host, r.token, r.text) for r in constant.collect()}
    want, want_constant = set(), set()
    for h in "abc":
        host_pages = sorted({html for _, url, html in rows if url == f"http://{h}.example/"})
        parsed = [he.blocks(p) for p in host_pages]
        counts = [paths for _, paths in parsed]
        vector = {path: tuple(c.get(path, 0) for c in counts) for c in counts for path in c}
        common = {p for p, v in vector.items() if sum(map(bool, v)) >= he.SHARE * len(v)}
        nested = {p for p in common if p.rpartition("/")[0] in common | {""}}
        sizes = collections.Counter(vector[p] for p in nested)
        want |= {(f"{h}.example", he.token(p)) for p in nested if sizes[vector[p]] >= he.LEAST_TOKENS and vector[p].count(1) >= he.SHARE * len(host_pages)}
        read = collections.Counter()
        for found, paths in parsed:
            read.update((p, t) for p, t in he.texts(found).items() if paths[p] == 1)
        want_constant |= {(f"{h}.example", he.token(p), t) for (p, t), n in read.items() if n >= max(he.REPEATS, he.SHARE * len(host_pages)) and all(paths[p] == 1 for found, paths in parsed if he.texts(found).get(p) == t)}
    assert got == want and got_constant == want_constant and want_constant


def test_templates_do_without_telling_tags(spark):
    """With article, nav and their like renamed to divs of no meaning the pages give the same texts; tags and names alone don't."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = "html"
    for i, tag in enumerate(("article", "nav", "aside", "footer", "header", "main")):
        plain = f"regexp_replace(regexp_replace({plain}, '(?i)<{tag}(?=[ >])[^>]*>', '<div class=\"k{i}\">'), '(?i)</{tag} *>', '</div>')"
    renamed = df.selectExpr("page_id", "url", f"{plain} as html")
    assert renamed.where("html rlike '<(article|nav|main)[ >]'").count() == 0
    told = {r.page_id: r.text for r in he.extract(df, keep=["page_id"]).collect()}
    got = {r.page_id: r.text for r in he.extract(renamed, keep=["page_id"]).collect()}
    assert got == told and len(told) == df.count()
    assert not any(he.main_text(r.html, ROOT) == told[r.page_id] for r in renamed.collect())
    assert all(r.slot != ROOT for r in he.templates(df).collect())


def test_clash(spark):
    with pytest.raises(ValueError):
        he.extract(pages(spark).withColumnRenamed("host", "text"), keep=["text"])


def test_a_passage_of_some_pages_is_not_template(spark):
    rows = [(i, "http://h/", f"<body><article><p>P{i}</p>{'<p>shared by some</p>' if i % 2 else ''}</article></body>") for i in range(10)]
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=["page_id"]).collect()}
    assert got[1] == "P1\n\nshared by some" and got[2] == "P2"


def test_empty_table(spark):
    assert he.extract(pages(spark).where("false"), keep=["page_id"]).collect() == []


def test_query(spark, small):
    rows = he.pages_query(spark, small).collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) > 0 and "©" not in r.text for r in rows)
