from html.parser import HTMLParser

import pytest

from vacantry.llm import html_extract as H


def page(i, body, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul>" + "".join(f"<li><a href='/{k}'>m{i}{k}</a></li>" for k in range(i % 4 + 1))
        + f"</ul></nav><!-- <p>no</p> --><div class='ad big'>buy {i}</div><article>{body}</article>{extra}<footer>&copy; {i}</footer></body></html>"
    )


def pages():
    rows, want = [], {}
    for i in range(30):
        body = f"<h1>Title &amp;amp; {i}</h1>" + "".join(f"<p>Par <b>{k}</b>\n of&nbsp;{i}<br>next" for k in range(i % 3 + 1))
        extra = ["", "<aside>side</aside>", "<section id='comments'><article class='comment'><p>reader</p></article></section>", "<form><p>send</p></form>"][i % 4]
        note = "<div class='cookie-notice'>take cookies</div><p>Always the same words.</p>"
        rows.append((i, f"https://h.example.com/{i}", page(i, body + note, extra)))
        want[i] = "\n".join([f"Title &amp; {i}", *[f"Par {k} of {i} next" for k in range(i % 3 + 1)], "Always the same words."])
    return rows, want


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string")
    return {r.page_id: r.text for r in H.extract(df).collect()}


@pytest.mark.parametrize("parts", [1, 6])
def test_article_only(spark, parts):
    """Menus, adverts, notices, comments and forms are left out; a paragraph of the article that all pages share is not."""
    rows, want = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want


@pytest.mark.parametrize("n", [1, 9, 10, 500])
def test_nothing_in_an_article_is_lost(spark, n):
    """Texts that one page has, and texts that all have, at any number of pages and parts."""
    rows, want = [], {}
    for i in range(n):
        sections = 5 if i == 7 else i % 3 + 1
        body = f"<h1>Title {i}</h1>" + "".join(f"<h2>Part {k} of {i}</h2><p>Words {k} of {i}</p>" for k in range(sections))
        lines = [f"Title {i}"] + [x for k in range(sections) for x in (f"Part {k} of {i}", f"Words {k} of {i}")]
        if i == n // 2:
            body += "<blockquote>Said once</blockquote><ul><li>One item</li></ul><figure><figcaption>A figure</figcaption></figure><h3>Always the same words.</h3>"
            lines += ["Said once", "One item", "A figure", "Always the same words."]
        rows.append((i, f"https://h.example.com/{i}", f"<html><body><p>Outside</p><article>{body}<div><p>Always the same words.</p></div></article></body></html>"))
        want[i] = "\n".join([*lines, "Always the same words."])
    rows.append((n, "https://h.example.com/e", ""))
    for parts in (1, 50):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert {r.page_id: r.text for r in H.extract(df).collect()} == want | {n: ""}


def unmarked(n):
    """Pages without an article element, whose classes mean nothing."""
    rows, want = [], {}
    for i in range(n):
        menu = "<div class='q'>" + "".join(f"<div class='r'><a href='/{k}'>Menu {k}</a></div>" for k in range(5)) + "</div>"
        paragraphs = [f"Words {k} of page {i}, " + "more of them " * (i % 4 + 2) for k in range(i % 4 + 2)]
        inner = f"<h1>Title {i}</h1>" + "".join(f"<div class='v'><p>{p}</p></div>" for p in paragraphs)
        lines = [f"Title {i}", *(p.strip() for p in paragraphs)]
        if i % 5 == 2:
            inner += f"<div class='t'><blockquote>Said on {i}</blockquote></div><ul><li>x{i}<li>y{i}</ul>"
            lines += [f"Said on {i}", f"x{i}", f"y{i}"]
        side = f"<div class='z'><p>Our company sells hats.</p><p>Hat {i % 3}</p></div>" * (i % 2)
        rows.append((i, f"https://u.example.com/{i}", f"<html><body class='page-{'abcdefg'[i % 7]}'><div class='w'>{menu}<div class='c'>{inner}<p>Read at your own risk.</p></div>{side}</div></body></html>"))
        want[i] = "\n".join(lines)
    return rows, want


@pytest.mark.parametrize("n", [9, 10, 200])
def test_the_wrapper_finds_the_article_without_marks(spark, n):
    """Menu, side column and a sentence that all pages share are left out, nothing else, in any number of parts."""
    rows, want = unmarked(n)
    for parts in (1, 50):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert {r.page_id: r.text for r in H.extract(df).collect()} == want


def test_large_hosts_alike(spark, monkeypatch):
    """A wrapper that forgets its order, and rules that are joined by salt, choose the same."""
    rows, want = unmarked(40)
    monkeypatch.setattr(H, "LARGE", 8)
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want


def test_near_copies_without_marks_keep_their_text(spark):
    """What near copies share is no template."""
    body = "<h1>A title</h1><p>A long paragraph of the article.</p><p>Another long paragraph of it.</p>"
    got = run(spark, [(1, "http://n/1", f"<body>{body}</body>"), (2, "http://n/2", f"<body>{body}<p>One more.</p></body>")])
    assert got[1] == "A title\nA long paragraph of the article.\nAnother long paragraph of it." and got[2] == got[1] + "\nOne more."


@pytest.mark.parametrize("mark", ["class='sidebar'", "id=comments", "role=\"banner\"", "hidden", "aria-hidden='true'", "style='display: none'"])
def test_attributes_behind_long_ones_are_read(mark):
    for first in ("", f"data-v2='{'x hidden ' * 500}' ", f"srcset=\"{'a.png 1x, ' * 400}\" data_w={'y' * 5000} "):
        assert H.signature(f"<div {first}{mark}>")[1][-1] == "!"
        assert H.signature(f"<div {first}class='text body'>") == ("div", "div.body.text")
    H.signature("<div " + "a" * 200000 + "'>")  # ends soon
    kinds = [k for k, w in H.stream(f"<article><div data-x='{'z' * 900}' {mark}><p>out</p></div><p>in</p></article>") if k == "open"]
    assert len(kinds) == 4
    rule = {"root": "article", "drop": [], "same": []}
    assert H.main_text(f"<article><div data-x='{'z' * 900}' {mark}><p>out</p></div><p>in</p></article>", rule) == "in"


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "not an address", "plain text &lt;b&gt; only"), (4, "http://a/", "<p>one<p>two<div>three"), (5, "http://a/", "<article><p>cut of"), (6, "http://a/", "<article><!-- open"),
        (7, "http://b/", "<main><p>x</p></main><p>y</p>"), (8, "http://c/", "<article>" + "<p>long</p>" * 30000 + "</article>"), (9, "http://c/", "<article><p a='>'>q</article><script>no"), (9, "http://c/", "<article><p a='>'>q</article><script>no"),
    ]
    got = run(spark, rows)
    assert len(got) == 9 and got[1] == got[2] == ""
    assert got[3] == "plain text <b> only" and got[5] == "cut of" and got[6] == "" and got[7] == "x" and got[8].count("\n") == 29999 and got[9] == "q"


def test_copies_of_one_page_keep_their_text(spark):
    got = run(spark, [(i, "http://s.example.com/x", page(1, "<h1>Same</h1><p>Everywhere</p>")) for i in range(15)])
    assert set(got.values()) == {"Same\nEverywhere"}


def test_merging_gives_optional_repeated_and_slots():
    a, b = (H.page_wrapper(t) for t in ("<div><p>a</p><p>b</p><h2>same</h2></div>", "<div><p>c</p><h2>same</h2><ul><li>x</li><li>y</li></ul></div>"))
    flat = str(H.merged(a, b))
    assert "['<ul', True]" in flat and "'#'" in flat and [n for n, _ in H.merged(a, b)][0] == "<div"
    group = H.merged(a, b)[1]
    assert isinstance(group[0], list) and group[0][0][0] == "<p"


def test_large_wrappers_are_generalised(monkeypatch):
    monkeypatch.setattr(H, "LARGE", 10)
    w = H.page_wrapper("<p>a</p><h1>b</h1><p>c</p><h2>d</h2>")
    for k in range(6):
        w = H.merged(w, H.page_wrapper("".join(f"<h{(i * k) % 5 + 1}>t</h{(i * k) % 5 + 1}>" for i in range(9))))
    assert len(w) <= 10


def test_empty_table(spark):
    assert run(spark, []) == {}


class Plain(HTMLParser):
    """Blocks of text within ``article``, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.run, self.blocks = 0, "", []

    def flush(self):
        if text := " ".join(self.run.split()):
            self.blocks.append(text)
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.run += " "
        elif tag not in H.INLINE:
            self.flush()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag not in H.INLINE:
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.run += data if self.inside else ""


def test_query_equals_a_plain_parser(spark, sf):
    """The given pages all have an article without marked parts in it."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in H.query(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        plain = Plain()
        plain.feed(p.html or "")
        plain.flush()
        assert got[p.page_id].text == "\n".join(plain.blocks) and got[p.page_id].n_chars == len(got[p.page_id].text)


NONE = {"root": "", "drop": [], "same": []}


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><p>Hello <span class="ad">buy</span> world text.</p><p>Next</p></article>', "Hello world text.\nNext"),
        ('<article><p>A <a class="social-link">tweet <b>it</b></a> b</p><p>c</p></article>', "A b\nc"),
        ('<article><p>A <span class="ad">x <span>y</span> z</span> b</p></article>', "A b"),
        ('<article><p>A <span class="ad">never closed</p><p>b <b>c</b></p></article>', "A\nb c"),
        ('<article><a class="promo"><div>x</div><p>y</p></a><p>b</p></article>', "b"),
        ('<article><p>a <img class="ad"> b <span class="lead">c</span></p></article>', "a b c"),
        ('<article><div class="commentary">a</div><div class="legal">b</div><div class="share-price">c</div><p class="advent adder sidewalk">d</p></article>', "a\nb\nc\nd"),
        ('<article><div class="share-buttons">a</div><div class="cookie-notice">b</div><div id="comment-list">c</div><div class="big ad">d</div><p>e</p></article>', "e"),
    ],
)
def test_marked_parts_go_and_nothing_else(page, want):
    assert H.main_text(page, NONE) == want


def test_teasers_beside_the_story_stay_out(spark):
    """One teaser or several, of another kind of article element than the story; a page of articles keeps them all."""
    card = lambda i, k: f"<article class='card'><h2>Other {i} {k}</h2><p>Short.</p></article>"
    story = lambda i: f"<h1>Title {i}</h1><p>{'Words of the story. ' * (i % 3 + 3)}</p>"
    rows = [(i, "http://t/", f"<main><article>{story(i)}</article>{''.join(card(i, k) for k in range(i % 3))}</main>") for i in range(20)]
    rows += [(100 + i, "http://l/", f"<main>{card(i, 0)}{card(i, 1)}</main>") for i in range(5)] + [(200, "http://t/", f"<body>{card(9, 9)}</body>")]
    got = run(spark, rows)
    for i in range(20):
        assert got[i] == f"Title {i}\n" + " ".join(["Words of the story."] * (i % 3 + 3))
    assert got[100] == "Other 0 0\nShort.\nOther 0 1\nShort." and got[200] == "Other 9 9\nShort."


def test_given_pages_without_marks(spark, sf):
    """With all semantic tags and classes gone, the wrapper finds the articles of nearly all pages."""
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {r.page_id: r.text for r in H.query(spark, sf).collect()}
    bare = lambda html: re.sub(r"<div [^>]*>", "<div>", re.sub(r"<(/?)(?:article|nav|footer|aside|section|main|header)\b[^>]*>", r"<\1div>", html or ""))
    got = run(spark, [(p.page_id, p.url, bare(p.html)) for p in pages])
    assert sum(got[i] == want[i] for i in want) > 0.8 * len(want)
