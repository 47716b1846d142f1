import random
import re
import time
from html import unescape

import pandas as pd
from logsluice.llm import html

PAGES = "page_id long, url string, html string"


def test_test_pages_against_a_pattern(spark):
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r for r in html.op2_html(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(pages)
    for p in pages.itertuples():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.DOTALL)[1]
        parts = [re.sub(r"\s+", " ", unescape(x)).strip() for x in re.split(r"<[^>]*>", re.sub(r"</?b>", "", inner))]
        expected = "\n".join(x for x in parts if x)
        assert (found[p.page_id].text, found[p.page_id].n_chars, found[p.page_id].url) == (expected, len(expected), p.url)


def page(body, k=0):
    return f"<html><head><title>T{k}</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_parts_that_are_no_article():
    body = """<header>Site name</header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
    <main><h1>Title &amp; more</h1><p>One  <b>bold</b>\n word<span class="ad-inline">buy</span>.<p>Two &lt;x&gt; &eacute;<br>three
    <script>var a = "<p>no</p>";</script><form><p>Your name</p></form><aside>See also</aside><ul><li>a<li>b</ul>
    <table><tr><td>c</td><td>d</td></tr></table></main>
    <section id="comments"><p>First!</p></section><div role="complementary">Side</div><footer>&copy; us</footer><!-- <p>x</p> -->"""
    assert html.main_text(page(body), [], None) == "Title & more\nOne bold word.\nTwo <x> é\nthree\na\nb\nc\nd"


def test_broken_pages():
    assert html.main_text("<html><head><title>T</title><meta><body><article><p>One<p>Two <i>x</b> y</article>", [], None) == "One\nTwo x y"
    assert html.main_text("<article><p>A <a class='share-link' href='#'>share</a>b</p><p title='a > b'>C</p><br/>D</article", [], None) == "A b\nC\nD"
    assert html.main_text("<ARTICLE><P>Up</P><SCRIPT>if (a < b) { x('<p>no</p>') }</SCRIPT><P>per", [], None) == "Up\nper"
    assert html.main_text("", [], None) == html.main_text("<!-- only -->", [], None) == html.main_text("<script>x", [], None) == ""


def test_template_of_a_host(spark):
    rows = []
    for k in range(6):
        body = f"""<div class="top"><p>Welcome to our site</p></div><div class="body"><p>Text number {k} of this page, with words.</p>
        <p>This text is on every page.</p><p>And {'more ' * k}text that differs.</p></div><div class="low"><p>Imprint</p></div>"""
        rows.append((k, f"http://Host.example/{k}", page(body, k)))
    rows += [(100, "https://u@other.example:80/x", page("<div><p>Only page of its host.</p></div>")), (101, None, None), (102, "odd", ""), (103, "http://host.example/y", "<p>un<closed"), (None, "http://z.example", "plain text")]
    found = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    for k in range(6):
        assert found[k].startswith(f"Text number {k} of this page, with words.") and "Welcome" not in found[k] and "Imprint" not in found[k]
    assert found[100] == "Only page of its host." and found[101] == found[102] == "" and found[103] == "un" and found[None] == "plain text"
    assert html.extracted(spark.createDataFrame([], PAGES)).count() == 0


def test_fixed_blocks_are_left_out(spark):
    rows = [(k, "http://h.example/", page(f"<div class='c'><p>Always here</p><p>Own {k} text</p><p>Twice</p><p>Twice</p></div>", k)) for k in range(5)]
    found = html.extracted(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(r.text for r in found) == [f"Own {k} text\nTwice\nTwice" for k in range(5)]
    same = [(k, "http://h.example/", page("<article><p>All the same</p><p>on every page</p></article>")) for k in range(5)]
    assert {r.text for r in html.extracted(spark.createDataFrame(same, PAGES)).collect()} == {"All the same\non every page"}


def test_classes_with_an_error_page_and_two_layouts(spark):
    rows = []
    for k in range(6):
        for host, top in (("a", "Welcome to us"), ("b", "Welcome to us" if k % 2 else "Another head")):
            low = "Imprint" if k % 2 or host == "a" else "Contact us"
            body = f"<div class='x'><p>{top}</p><p>{top}, again</p></div><div class='y'><p>Own text {k} of {host}.</p></div><div class='z'><p>{low}</p></div>"
            rows.append((len(rows), f"http://{host}.example/{k}", page(body, k)))
    rows += [(50 + k, "http://b.example/", page("<div class='x'><p>Another head</p><p>Another head, again</p></div><div class='y'><p>Own text 7.</p></div><div class='z'><p>Contact us</p></div>" if k % 2 else "<div class='x'><p>Welcome to us</p><p>Welcome to us, again</p></div><div class='y'><p>Own text 8.</p></div><div class='z'><p>Imprint</p></div>")) for k in range(2)]
    rows += [(90, "http://a.example/e", None), (91, "http://a.example/f", ""), (92, "http://a.example/g", "<p>Error 500")]
    found = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(found[i] == f"Own text {i // 2} of {'ab'[i % 2]}." for i in range(12))
    assert (found[50], found[51], found[90], found[91], found[92]) == ("Own text 8.", "Own text 7.", "", "", "Error 500")


def test_classes_out_of_order_do_not_count(spark):
    parts = ["<div class='m'><p>One</p></div>", "<div class='n'><p>Two</p></div>", "<div class='o'><p>Three</p></div>"]
    pages = [(k, "http://h.example/", "".join(parts[(k + i) % 3] for i in range(3)) + f"<div class='q'><p>Own {k}</p></div>") for k in range(6)]
    found = {r.page_id: sorted(r.text.split("\n")) for r in html.extracted(spark.createDataFrame(pages, PAGES)).collect()}
    assert all({f"Own {k}"} < set(found[k]) for k in range(6))


def test_all_slots_of_the_article(spark):
    rows = []
    for k in range(5):
        parts = "".join(f"<div class='{c}'><p>{c} {k} " + f"{c}{k} " * n + "</p></div>" for c, n in (("first", 9), ("second", 40), ("third", 12)))
        rows.append((k, "http://h.example/", page(f"<div class='top'><p>Our site</p></div><div class='all'>{parts}</div>", k)))
        inner = f"<p>Welcome here</p><p>Own {k}</p><p>Copied from nowhere</p>"
        rows.append((10 + k, "http://i.example/", page(f"<div class='top'><p>Our site</p></div><article>{inner}</article>", k)))
    found = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(5):
        assert [x.split()[0] for x in found[k].split("\n")] == ["first", "second", "third"]
        assert found[10 + k] == f"Own {k}"


def test_names_drop_no_article():
    for around in ("<body class='has-sidebar'><article class='post comments-open'>{}</article>", "<body class='sidebar'><div class='widget'><article class='comment'>{}</article></div>", "<div id='sidebar'><main id='search'>{}</main></div>"):
        assert html.main_text(around.format("<p>Text</p>"), [], None) == "Text"
    inner = "<h2 id='related-work'>Related work</h2><section id='discussion'><p>We discuss.</p></section>"
    assert html.main_text(f"<article>{inner}</article><div class='related'><p>Other</p></div>", [], None) == "Related work\nWe discuss."


def test_names_inside_an_article_count_if_they_repeat(spark):
    share = lambda k: f"<div class='share'><p>Share {k} now</p></div>"
    rows = [(k, "http://h.example/", page(f"<article><p>Own {k}</p>{share(k)}</article>", k)) for k in range(5)]
    rows += [(9, "http://h.example/", page("<article><p>Own 9</p><section id='discussion'><p>Once</p></section></article>"))]
    found = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {k: f"Own {k}" for k in range(5)} | {9: "Own 9\nOnce"}


def test_unclosed_parts_are_skipped_alone():
    for name in ("button", "svg", "select", "textarea", "object", "iframe", "video"):
        assert html.main_text(f"<article><p>One</p><{name} x='y'><p>Two</p><p>Three</p></article>", [], None) == "One\nTwo\nThree"
        assert html.main_text(f"<article><p>One</p><{name}>no</{name.upper()} ><p>Two</p><{name}><p>Three</p></article>", [], None) == "One\nTwo\nThree"
    assert html.main_text("<p>a <a class='share'>no</A> yes <A class='share'>no</a> end</p>", [], None) == "a yes end"
    assert html.main_text("<article><p title=it's>don't</p><p>won't</p></article>", [], None) == "don't\nwon't"
    assert html.main_text("<article><p>x</p><script>var a<p>y</p>", [], None) == "x\ny"


def test_broken_tags_take_time_in_proportion():
    start = time.perf_counter()
    for bit in ("<a ", '<a "', "<a x='<b y=\"", '<span class="share">', "<button>x", "<script>", "<!--", "<p><b", "<div>", "</"):
        html.blocks(bit * (1_000_000 // len(bit)))
    assert time.perf_counter() - start < 60
    assert html.main_text("<div>" * 500 + "<p>deep</p><p>down</p>" + "</div>" * 500 + "<p>up</p>", [], None) == "deep\ndown\nup"


def test_rows_with_equal_page_id_are_pages(spark):
    rows = [(7, "http://h.example/", page(f"<div class='c'><p>Always here</p><p>Own {k} text</p><p>And here</p></div>", k)) for k in range(4)]
    assert sorted(r.text for r in html.extracted(spark.createDataFrame(rows, PAGES)).collect()) == [f"Own {k} text" for k in range(4)]


MENU = "<div class='head'><p>Site</p></div><ul class='list'><li>Home</li><li>About us</li></ul>"
LOW = "<div class='low'><p>Imprint</p><p>Our address</p></div>"


def own(k):
    return f"<p>Own text {k} of the page, with some words to read.</p><p>And more {k} of it, as long as an article is.</p>"


def wrapped(kind, k):
    """A page whose text stands in, or behind, something that is usually no text."""
    body, article = f"<div class='text'>{own(k)}</div>", f"<article>{own(k)}</article>"
    return {
        "form": f"<form action='x'>{MENU}{body}{LOW}</form>",
        "form, article": f"<form action='x'>{MENU}{article}{LOW}</form>",
        "form, main": f"<form action='x'>{MENU}<main>{own(k)}</main>{LOW}</form>",
        "open nav": f"<nav><ul><li>Home</li><li>About us</li></ul>{body}{LOW}",
        "open nav, article": f"<nav><ul><li>Home</li><li>About us</li></ul>{article}{LOW}",
        "open aside, article": f"<aside><p>Aside</p>{article}{LOW}",
        "open header, article": f"<header><p>Site</p>{article}{LOW}",
        "fieldset": f"{MENU}<fieldset>{own(k)}</fieldset>{LOW}",
        "notice": f"{MENU}<div class='notice'>{own(k)}</div>{LOW}",
        "heading": f"{MENU}<div class='title'><h1>H{k}</h1></div><div class='text'>{own(k)}{own(k + 70)}</div>{LOW}",
        "comments": f"{MENU}{body}<div id='comments'><article class='comment-body'><p>Reader {k} says so and so.</p></article></div>{LOW}",
        "comments, article": f"{MENU}<article>{own(k)}<article class='comment'><p>Reader {k} says.</p></article></article>{LOW}",
        "discussion": f"{MENU}<div class='text'>{own(k)}" + (f"<section id='discussion'><p>D text {k}.</p></section>" if k == 1 else "") + f"</div>{LOW}",
    }[kind]


KINDS = ["form", "form, article", "form, main", "open nav", "open nav, article", "open aside, article", "open header, article", "fieldset", "notice", "heading", "comments", "comments, article", "discussion"]


def test_no_page_is_lost_to_its_elements_or_names(spark):
    """On hosts of six and of two pages the whole article and nothing else; on hosts of one page all of it."""
    rows, expected = [], {}
    for at, kind in enumerate(KINDS):
        for size in (6, 2, 1):
            for k in range(size):
                key = at * 100 + size * 10 + k
                rows.append((key, f"http://h{at}-{size}.example/{k}", page(wrapped(kind, k), k)))
                texts = re.findall("<p>([^<]*)</p>", own(k) + (own(k + 70) if kind == "heading" else ""))
                more = [f"H{k}"] if kind == "heading" else []
                expected[key] = more + texts + ([f"D text {k}."] if kind == "discussion" and k == 1 else []), size, kind
    found = {r.page_id: r.text.split("\n") for r in html.extracted(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    for key, (texts, size, kind) in expected.items():
        if size > 1 or "article" in kind or "main" in kind:
            assert found[key] == texts, (kind, size)
        else:
            assert [x for x in found[key] if x in texts] == texts and not any("Reader" in x for x in found[key]), kind


def test_closed_parts_stay_away():
    cards = "<aside><article><p>Other story</p></article></aside>"
    assert html.main_text(page(f"<div><p>Own story here.</p></div>{cards}"), []) == "Own story here."
    assert html.main_text(page("<div><p>Own story here, long enough.</p></div><form><p>Your name</p></form>"), []) == "Own story here, long enough."
    assert html.main_text(page("<div><p>Short.</p></div><div id='comments'><p>" + "A very long comment. " * 50 + "</p></div>"), []) == "Short."
    assert html.main_text("<div id='comments'><article class='comment'><p>Only this</p></article></div>", []) == "Only this"


def deduced(pages):
    """The text of each page of one host by plain deduction: classes of equal vectors, checked for support, order and nesting; then the slots."""
    parts = [html.blocks(h) for h in pages]
    seen = {}  # token: (kind, path, counts by page, places by page)
    for k, (found, tags, _) in enumerate(parts):
        for kind, path, text, place in [(0, p, None, at) for p, at in tags] + [(1, p, t, at) for p, t, _, at in found]:
            _, _, counts, places = seen.setdefault((path, text), (kind, path, [0] * len(pages), {}))
            counts[k] += 1
            places.setdefault(k, place)
    classes = {}
    for token, (_, _, counts, _) in seen.items():
        if sum(map(bool, counts)) >= max(html.LEAST_PAGES, html.LEAST_SHARE * len(pages)):
            classes.setdefault(tuple(counts), []).append(token)
    big = lambda c: {v: t for v, t in c.items() if len(t) >= html.LEAST_TOKENS}
    mean = lambda t: sum(seen[t][3].values()) / len(seen[t][3])
    for vector, tokens in big(classes).items():
        bad = set()
        for k in (k for k, n in enumerate(vector) if n):
            line = sorted(tokens, key=lambda t: seen[t][3][k])
            bad |= {t for i, t in enumerate(line) if any(mean(u) > mean(t) for u in line[:i])}
        classes[vector] = [t for t in tokens if t not in bad]
    classes = big(classes)
    support = {}
    for vector, tokens in classes.items():
        for t in tokens:
            if seen[t][0] == 0:
                support[t[0]] = max(support.get(t[0], 0), sum(map(bool, vector)))
    fixed = set()
    for vector, tokens in classes.items():
        around = ["/".join(p) for p in [tokens[0][0].split("/")[:k] for k in range(1, 99)] if all(t[0].split("/")[: len(p)] == p for t in tokens)]
        if set(around) == {""} or any(support.get(p, 0) >= sum(map(bool, vector)) for p in around):
            fixed |= {t for t in tokens if seen[t][0] == 1}
    return ["\n".join(t for p, t, _, _ in found if (p, t) not in fixed) for found, _, _ in parts]


def test_deduction_alone_against_a_plain_one(spark):
    rng, rows, expected, whole = random.Random(4), [], [], []
    word = lambda: f"w{rng.randrange(10**6)}"
    for host in range(3):
        top, low = [f"Top {word()} {i}" for i in range(3)], [f"Low {word()} {i}" for i in range(4)]
        pages = []
        for k in range(9):
            items = "".join(f"<li>{word()} {word()}</li>" for _ in range(rng.randrange(4)))
            texts = [f"{word()} {word()} {word()}." for _ in range(rng.randrange(1, 5))]
            extra = "<div class='k9'><p>Seen on some</p><p>pages alone</p></div>" if k % 3 == 0 else ""
            body = f"<div class='k1'>{''.join(f'<p>{x}</p>' for x in top)}</div>{extra}<div class='k2'>{''.join(f'<p>{x}</p>' for x in texts)}<ul class='k3'>{items}</ul></div><div class='k4'>{''.join(f'<span>{x}</span><br>' for x in low)}</div>"
            pages.append(page(body, k))
            whole.append("\n".join(texts + re.findall("<li>(.*?)</li>", items)))
        rows += [(len(rows) + k, f"http://h{host}.example/{k}", h) for k, h in enumerate(pages)]
        expected += deduced(pages)
    found = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert [found[k] for k in range(27)] == expected == whole
