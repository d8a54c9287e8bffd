import html
import json
import random
import re

import pytest

from roadpulse.llm import html_wrappers as hw
from roadpulse.llm.markup import blocks, parse
from roadpulse.llm.queries import QUERIES


def wrapper(*pages):
    made = None
    for page in pages:
        items = hw.stream(parse(page))
        made = items if made is None else hw.align(made, items)
    return hw.expression(made)


def test_texts_become_slots_and_runs_repeat():
    assert wrapper("<ul><li>a<li>b</ul>", "<ul><li>c</ul>") == "<ul>(<li>#</li>)+</ul>"
    assert wrapper("<p>a</p>", "<p>b</p>") == "<p>#</p>"


def test_mismatches_become_optional():
    assert wrapper("<h1>t</h1><p>a</p>", "<h1>t</h1><div>x</div><p>a</p>") == "<h1>#</h1>(<div>#</div>)?<p>#</p>"
    assert wrapper("<div><p>a</p></div>", "<div></div>", "<div><p>a</p><p>b</p></div>") == "<div>(<p>#</p>)*</div>"


def test_groups_repeat():
    assert wrapper("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>") == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"


def matches(items, streamed):
    """Whether a wrapper, as a regular expression over tags, matches a page's unfolded stream."""

    def pattern(items):
        out = ""
        for name, optional, repeated, inner in items:
            body = r"#" if name == "#" else pattern(inner) if name == "()" else f"<{re.escape(name)}>{pattern(inner)}</>"
            out += f"(?:{body}){'*' if optional and repeated else '?' if optional else '+' if repeated else ''}"
        return out

    return re.fullmatch(pattern(items), streamed) is not None


def unfolded(node):
    out, held = "", False
    for c in node.children:
        if isinstance(c, str):
            if c and not c.isspace() and not held:
                out += "#"
                held = True
        else:
            out += f"<{c.signature}>{unfolded(c)}</>"
            held = False
    return out


@pytest.mark.parametrize("seed", range(10))
def test_a_wrapper_matches_every_page_it_was_made_of(seed):
    draw = random.Random(seed)

    def part(depth):
        kind = draw.choice(["p", "div", "ul", "h2", "section"])
        if kind in ("p", "h2") or depth > 3:
            return f"<{kind if kind != 'ul' else 'p'}>x</{kind if kind != 'ul' else 'p'}>"
        if kind == "ul":
            return "<ul>" + "<li>y</li>" * draw.randint(0, 3) + "</ul>"
        return f"<{kind}>" + "".join(part(depth + 1) for _ in range(draw.randint(0, 3))) + f"</{kind}>"

    pages = [parse("<body>" + "".join(part(0) for _ in range(draw.randint(1, 4))) + "</body>") for _ in range(6)]
    made = hw.stream(pages[0])
    for page in pages[1:]:
        made = hw.align(made, hw.stream(page))
    made = json.loads(json.dumps(made))
    for page in pages:
        assert matches(made, unfolded(page))


def text(page, main=(), template=()):
    return hw.main_text(page, list(main), list(template))


def test_what_is_left_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
    <main><article><header><h1>Title &amp; more</h1></header><p>One <b>two</b>\n three&nbsp;four<br>five</p><div class="ad">Buy</div><aside>Related</aside>
    <p hidden>no</p><p style="display: none">no</p><form><label>Mail</label><input><button>Go</button></form><ul><li>item 1<li>item 2</ul><p>5 &lt; 6 &#169; &eacute;</p>
    <div id="comments"><p>First!</p></div></article></main><div class="sidebar"><p>side</p></div><footer>&copy; me</footer></body></html>"""
    assert text(page, ["/html/body.has-sidebar/main"]) == "Title & more\n\nOne two three four five\n\nitem 1\n\nitem 2\n\n5 < 6 © é"
    assert text(page) == text(page, ["/html/body.has-sidebar/main"])


def test_broken_pages():
    assert text("<article><p><b>One.<br><p>Two.<p>Three") == "One.\n\nTwo.\n\nThree"
    assert text("<article><p>One <a href='x'>two") == "One two"
    assert text("<article><p>a < b and <") == "a < b and <"
    assert text("<article><p>x</p><scr") == "x"
    assert text("<article><script>if (a</b) x()") == ""
    for page in (None, "", "   ", "<", "<!--", "</p></div>", "<p", "&amp"):
        assert text(page) in ("", "<", "&")
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("<article><p>" + "word " * 200_000) == " ".join(["word"] * 200_000)


def test_inline_elements_stay_in_their_block():
    assert blocks(parse("<p>a<span class='x'>b <span>c</span></span> d <em>e</em></p>f"), lambda n: False) == ["ab c d e", "f"]


SITE = "<html><body><div class='top'>Our site since 1990, all rights</div><div class='wrap'><div class='x1'>{}</div></div><div class='low'>Terms and conditions apply to it</div></body></html>"


def test_sites_without_an_article_element(spark):
    draw = random.Random(2)
    rows = []
    for k in range(30):
        own = [" ".join(draw.choice("red blue green car road town".split()) for _ in range(20)) + f" {k}" for _ in range(3)]
        rows.append((k, "http://Plain.example.org/a?b", SITE.format("".join(f"<p>{p}</p>" for p in own)), "\n\n".join(own)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string").repartition(4)
    assert all(r["text"] == r["want"] for r in hw.extract(df).collect())


def test_rounds_of_merging(spark, monkeypatch):
    monkeypatch.setattr(hw, "GROUP", 3)
    parts = ["<h2>a</h2>", "<p>b</p>", "<ul><li>c</ul>", "<table><tr><td>d</table>"]
    pages = ["".join(p for k, p in enumerate(parts) if n >> k & 1) for n in range(1, 16)]
    rows = [("one", json.dumps(hw.stream(parse(p)))) for p in pages] + [("two", json.dumps(hw.stream(parse("<p>x</p>"))))]
    made = {r["host"]: json.loads(r["wrapper"]) for r in hw.infer_wrappers(spark.createDataFrame(rows, "host string, wrapper string").distinct()).collect()}
    assert set(made) == {"one", "two"}
    assert all(matches(made["one"], unfolded(parse(p))) for p in pages)


def test_hard_rows(spark):
    schema = "page_id long, url string, html string, text string, host string, _host int, _main string"
    rows = [(1, None, None, "clash", None, 1, None), (None, "not a url", "", None, None, None, None), (2, "http://h/x", "<article><p>a</article>", "t", "h", 2, "m"), (2, "http://h/x", "<article><p>a</article>", "t", "h", 2, "m")]
    df = spark.createDataFrame(rows, schema)
    made = hw.extract(df)
    assert made.columns == [*df.columns, "text_"]
    assert sorted(r["text_"] for r in made.collect()) == ["", "", "a", "a"]
    assert hw.extract(df.limit(0)).count() == 0


def expected(page):
    """The article of a generated page, cut out by its own simple form."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    inner = re.sub(r"<(?:b|br|/b)>", " ", inner)
    return "\n\n".join(t for p in re.split(r"</?(?:p|h1)>", inner) if (t := " ".join(html.unescape(p).split())))


def test_given_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    made = QUERIES["op3_html_extraction"](spark, sf).collect()
    assert len(made) == len(pages)
    for r in made:
        assert r["text"] == expected(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


#: Templates of sites: {t} title, {b} paragraphs, {x} and {c} other texts that change from page to page.
TEMPLATES = {
    "ids": "<html><body><div id='header'><h1>My Site</h1><p>slogan</p></div><div id='menu'><ul><li><a href='#'>a</a><li><a>b</a></ul></div>"
    "<div id='content'><h1>{t}</h1>{b}<div class='share'>Tweet this</div></div><div id='sidebar'><p>Popular: {x}</p></div>"
    "<div class='comments'><p>{c}</p></div><div id='footer'><p>Copyright</p></div></body></html>",
    "main": "<body><header><a>Home</a> Site name</header><main><h1>{t}</h1>{b}<section class='comment-list'><p>{c}</p></section></main><aside><p>{x}</p></aside><footer>foot</footer></body>",
    "post": "<body><div class='page'><div class='top-bar'>Login <a>here</a></div><div class='post'><div class='post-title'>{t}</div><div class='post-body'>{b}</div>"
    "<div class='newsletter-signup'><form>Email</form>Subscribe</div></div><div class='related-posts'><p>{x}</p></div></div></body>",
    "table": "<table><tr><td class='nav'><a>one</a><a>two</a></td><td><h2>{t}</h2>{b}</td><td class='ads'>{x}</td></tr></table>",
    "flat": "<body><nav>n</nav><div class='cookie-banner'>We use cookies. <button>OK</button></div><h1>{t}</h1>{b}<div id='disqus_thread'><p>{c}</p></div><footer>f</footer></body>",
    "unnamed": "<body><div class='wrapper has-sidebar'><div class='col-8'><div class='inner'><h1>{t}</h1>{b}</div></div><div class='col-4'><div class='box'><h3>Recent</h3>"
    "<ul><li><a href=1>{x}</a></li></ul></div></div></div><div class='bottom'>All rights reserved by the owner</div></body>",
    "article": "<body><article class='teaser'><h2>x</h2></article><article><header><h1>{t}</h1><p class='byline'>By me</p></header>{b}<footer>Tags: a</footer>"
    "<section id='comments'><article class='comment'><p>{c}</p></article></section></article></body>",
}


def test_templates(spark):
    draw = random.Random(1)

    def prose(n):
        return " ".join(draw.choice("red blue green car road town river stone light paper".split()) for _ in range(n)) + "."

    rows = []
    for name, template in TEMPLATES.items():
        for k in range(12):
            title, own = prose(5), [prose(25) for _ in range(draw.randint(2, 5))]
            page = template.format(t=title, b="".join(f"<p>{p}</p>" for p in own), x=prose(10), c=prose(12))
            rows.append((name, f"https://{name}.example.org/{k}", page, "\n\n".join([title, *own])))
    df = spark.createDataFrame(rows, "name string, url string, html string, want string").repartition(6)
    assert {r["name"] for r in hw.extract(df).collect() if r["text"] != r["want"]} == set()


def extracted(spark, pages):
    rows = [(k, f"http://one.example.org/{k}", page) for k, page in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return [r["text"] for r in sorted(hw.extract(df).collect(), key=lambda r: r["page_id"])]


def test_copies_of_one_page_keep_its_text(spark):
    page = "<body><div class=wrap><h1>T</h1><p>One.</p></div></body>"
    assert extracted(spark, [page] * 5) == ["T\n\nOne."] * 5
    assert extracted(spark, [page] * 3 + [page.replace("One", "Two")]) == ["T\n\nOne."] * 3 + ["T\n\nTwo."]


def test_constant_text_goes_without_the_blocks_in_it(spark):
    page = "<body><table><tr><td class=q>What is {0}?</td><td class=a>Answer: <p>{0} it is</p></td></tr></table></body>"
    words = ("one", "two", "three", "four")
    assert extracted(spark, [page.format(w) for w in words]) == [f"What is {w}?\n\n{w} it is" for w in words]


def test_names_of_one_page_are_no_part_of_paths(spark):
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def page():
        ids = ["".join(draw.choice(letters) for _ in range(12)) for _ in range(4)]
        parts = "".join(f"<h2 id='{i}' class='title c-{i}'>{i}</h2><p class='w-1/2'>{i} {i} {i}</p>" for i in ids)
        return f"<body><div class=page><div class=box>{parts}</div></div></body>", "\n\n".join(f"{i}\n\n{i} {i} {i}" for i in ids)

    rows = [(k, f"http://one.example.org/{k}", *page()) for k in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string").repartition(4)
    assert all(r["text"] == r["want"] for r in hw.extract(df).collect())
    reduced = hw._reduced(df.select(hw.host_of(df["url"]).alias("host"), "html")).cache()
    assert hw.known_names(reduced).first()["known"] == ["box", "page", "title", "w--"]
    assert len(hw.decisions(reduced).first()["wrapper"]) < 400


def test_items_of_the_wrapper_tell_like_paths_apart(spark):
    words = "ash birch cedar elm fir hazel".split()
    own = [f"All about {w}: " + " ".join([w] * 30) for w in words]
    page = "<body><div><p>Read our rules</p></div><h1>{0}</h1><div><p>{0}</p>Tail of {0}<hr>Read our rules</div><ul><li>x</ul><div><p>Read our rules</p></div></body>"
    made = extracted(spark, [page.format(o) for o in own])
    assert made == [f"{o}\n\nTail of {o}" for o in own]


def test_names_meet_the_items_of_a_wrapper():
    items = hw.stream(parse("<h1>a</h1><dl><dt>a<dd>b<dt>c<dd>d</dl><p>x</p><p>y</p><h1>b</h1>"))
    level = hw.Level(items)
    assert level.match(("h1", "dl", "p", "p", "p", "h1")) == [0, 1, 2, 2, 2, 3]
    assert level.match(("dl", "table", "p", "h1")) == [1, None, 2, 3]
    assert level.below(1).match(("dt", "dd", "dt", "dd", "dt")) == [0, 1, 0, 1, 0]
    assert level.segments == ["h1", "dl", "p", "h1~2"]
