"""Main text of pages that are written here, and of the given ones."""

import html
import re

from cardwatch.llm.html import extract_main_text, main_text, parse, read_page, tag_tokens, templates, with_host, word_tokens
from cardwatch.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"

FRAME = """<!DOCTYPE html><html><head><title>{t}</title><style>p {{x}}</style><script>var a="</p><p>no";</script></head><body>
<header class="top"><a href="/">Site of news</a></header><nav><ul><li><a href="/a">Home {n}</a></li><li><a href="/b">More</a></li></ul></nav>
<!-- ad --><div class="ad">Buy {n} now</div><div id="cookie-notice">We use cookies</div>
{body}
<section class="comments"><p>reader {n} says hello</p></section><form><label>Mail</label><input name=q><button>Go</button></form>
<aside>Also read {n}</aside><footer>&copy; site &middot; {n}</footer></body></html>"""


def page(n, body):
    return FRAME.format(t=f"Title {n}", n=n, body=body)


def test_frame_goes_article_stays(spark):
    rows, want = [], {}
    for n in range(12):
        body = f"<article><h1>Head {n}</h1><p>Words &amp; more&nbsp;words <b>number</b>\n {n}<br>next line<p>Second &lt;{n}&gt;<p>Share this story</article>"
        rows.append((n, "http://Example.org/x/%d" % n, page(n, body)))
        want[n] = f"Head {n}\n\nWords & more words number {n} next line\n\nSecond <{n}>"
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_pages_without_article_element(spark):
    rows = [
        (n, f"https://a.example/{n}", page(n, f"<div class='body'><p>Only story {n} here</p></div><div><a href='/z'>Link</a> <a href='/y'>Other {n}</a></div>"))
        for n in range(10)
    ]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Only story {n} here" for n in range(10)}


def test_awkward_rows(spark):
    rows = [
        (1, None, None, "x"),
        (2, "http://h.example/", "", "x"),
        (None, "no url at all", "<article><p>cut off <b>te", "x"),
        (4, "http://h.example/2", "<article>&am &#x41; 1 < 2 <p>a<script>never closed <p>b", "x"),
        (4, "http://h.example/2", "<article>&am &#x41; 1 < 2 <p>a<script>never closed <p>b", "x"),
        (5, "http://h.example/3", "plain text, no tags", "x"),
        (6, "http://h.example/4", "<article>" + "<p>word and word</p>" * 20000 + "</article><foot", "x"),
        (7, "http://h.example/5", "<div>" * 3000 + "deep" + "</div>" * 3000, "x"),
    ]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string"))
    texts = sorted(((r.page_id, r.text) for r in got.collect()), key=str)
    long = "\n\n".join(["word and word"] * 20000)
    four = "&am A 1 < 2\n\na"
    want = [(1, ""), (2, ""), (None, "cut off te"), (4, four), (4, four), (5, "plain text, no tags"), (6, long), (7, "deep")]
    assert texts == sorted(want, key=str)
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def deduced(pages):
    """Classes by laying the vectors out: the template of one host's pages, brute force."""
    parsed = list({p.content: p for p in map(parse, pages) if p.content is not None}.values())

    def shared(found):
        vectors = {}
        for token in set().union(*found):
            vectors.setdefault(tuple(token in f for f in found), []).append(token)
        return {t for v, ts in vectors.items() for t in ts if len(ts) > 1 and 2 * sum(v) > len(v) and sum(v) > 1}

    skeleton = shared([tag_tokens(p) for p in parsed])
    return skeleton, shared([word_tokens(p, skeleton) for p in parsed])


def test_template_against_laid_out_vectors(spark):
    pages = [page(n, f"<article><p>x{n}</p>{'<p>y</p>' * (n % 3)}</article>") for n in range(9)]
    pages += [plain(n, f"<div><p>the story {n}</p></div>") for n in range(5)] + [pages[2], None, "", pages[3][:90]]
    rows = [(n, f"https://a.example/{n}", p) for n, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    skeleton, words = deduced(pages)
    for parts in (frame.repartition(5), frame.coalesce(1)):
        (found,) = templates(parts).collect()
        assert found.host == "a.example" and set(found.skeleton) == skeleton and set(found.words) == words
    assert len(skeleton) > 10 and len(words) > 5


def test_given_templates(spark):
    """All hosts of the given pages."""
    source = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = {r.host: r for r in templates(source).collect()}
    hosts = {}
    for r in with_host(source, "url", "html").collect():
        hosts.setdefault(r.host, []).append(r.page)
    for host, pages in hosts.items():
        skeleton, words = deduced(pages)
        r = found.get(host)
        assert (set(r.skeleton or ()) if r else set()) == skeleton
        assert (set(r.words or ()) if r else set()) == words


def test_given_pages(spark):
    """The given pages have one article each; what stands in it, block by block, is the text."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = QUERIES["op1_html_extraction"](spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_parts():
    assert [t for _, t, *_ in read_page("a<b>c</b>") if t] == [(["a"], (False, False)), (["c"], (False, False))]
    got = parse("<div>a b</div><div>b</div>")
    assert len(set(got.places(tag_tokens(got)))) == 5 and len(set(got.places(()))) == 1
    assert len(word_tokens(got, ())) == 4 and len(word_tokens(got, tag_tokens(got))) == 8
    assert main_text("<p>a</p>", (), ()) == "a"


def texts(spark, pages, host="https://a.example"):
    """The texts of pages of one host, in their order."""
    rows = [(n, f"{host}/{n}", p) for n, p in enumerate(pages)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_tags_that_look_like_skipped_ones(spark):
    pages = [
        '<p>one <svg class="i"/> two</p><p>three</p>',
        '<p>one <svg class="a>b"><text>gone</text></svg> two</p>',
        "<style-guide>one</style-guide><title-bar>two</title-bar><template-x>three</template-x>",
        "<article><header class='entry-header'><h1>Head</h1></header><figure><figcaption>Caption</figcaption></figure><p>Story</p></article>",
        "<header>frame</header><div class='page-header'>frame</div><article><p>Story</p></article><header>frame</header>",
    ]
    want = ["one two\n\nthree", "one two", "one\n\ntwo\n\nthree", "Head\n\nCaption\n\nStory", "Story"]
    assert [texts(spark, [p])[0] for p in pages] == want


def plain(n, body):
    """A page without article and main, all of whose frame stands in plain elements."""
    frame = "<html><body><div>{0}</div>{1}<div>We use cookies and cookies of the site</div></body></html>"
    return frame.format("<ul><li><a href='/'>Home</a></li><li><a href='/n'>Other %d</a></li></ul>" % n, body)


def test_empty_and_cut_pages_leave_the_template(spark):
    pages = [plain(n, f"<div><p>the story {n} of the day</p></div>") for n in range(12)]
    odd = [None, "", "<html><body><h1>404</h1></body></html>", pages[3][:40]]
    for n in (3, 12):
        want = [f"the story {i} of the day" for i in range(n)]
        assert texts(spark, pages[:n] + odd[: n // 3])[:n] == want


def test_words_that_repeat_or_stand_in_the_story_too(spark):
    notice = "We use cookies and cookies of the site"
    pages = [f"<body><div>{notice}</div><div>{'we use the site and cookies ' * n}{n}</div></body>" for n in range(1, 9)]
    assert texts(spark, pages) == [("we use the site and cookies " * n) + str(n) for n in range(1, 9)]


def test_same_blocks_in_articles_stay_on_hosts_of_any_size(spark):
    def one(n):
        return f"<article><h1>Release notes</h1><p>By our staff</p><p>story {n}</p></article>"

    for size in (1, 2, 7, 8, 9):
        assert texts(spark, map(one, range(size))) == [f"Release notes\n\nBy our staff\n\nstory {n}" for n in range(size)]
    copies = [f"<body><div id='x{n}'><h1>Only head</h1><p>only story</p></div></body>" for n in range(9)]
    assert texts(spark, copies) == ["Only head\n\nonly story"] * 9


def test_links_of_the_story_stay(spark):
    def body(n):
        refs = "".join(f"<li><a href='/{i}'>Source {n} {i}</a></li>" for i in range(3))
        return f"<div><h1><a href='/{n}'>Head {n}</a></h1><p>the long story number {n} of this day</p><p>see <a href='/r'>report {n} here</a></p><ul>{refs}</ul></div>"

    want = [
        "\n\n".join([f"Head {n}", f"the long story number {n} of this day", f"see report {n} here"] + [f"Source {n} {i}" for i in range(3)])
        for n in range(10)
    ]
    assert texts(spark, [plain(n, body(n)) for n in range(10)]) == want


def test_names_around_and_inside_an_article(spark):
    pages = {
        '<div class="layout has-sidebar"><article><p>Story</p></article></div>': "Story",
        '<div class="no-sidebar"><main><p>Story</p></main></div>': "Story",
        '<article class="post search-engine"><p>Story</p></article>': "Story",
        '<form id="aspnetForm"><article><p>Story</p></article></form>': "Story",
        '<div class="sidebar"><div class="related"><article><p>Story</p></article></div></div>': "Story",
        '<article><h2 id="related-work">Related work</h2><p id="login">Story</p><h2 id="login">Login</h2></article>': "Related work\n\nStory\n\nLogin",
        '<article><p>Story</p><section class="comments"><p>Hello</p></section><div id="share">Send</div></article>': "Story",
        '<aside><article><p>Teaser</p></article></aside><article><p>Story</p></article>': "Story",
        '<div class="search-results"><p>The one long story of this page</p></div><div>by me</div>': "The one long story of this page\n\nby me",
        '<div class="cookie-notice"><p>We use them</p></div><div><p>The one long story of this page</p></div>': "The one long story of this page",
    }
    assert [texts(spark, [p], f"https://h{i}.example")[0] for i, p in enumerate(pages)] == list(pages.values())


def test_template_matters_without_article(spark):
    """Plain elements only: without other pages the frame cannot be told from the story."""
    pages = [plain(n, f"<div><p>the story {n} of the site</p></div>") for n in range(6)]
    alone = [texts(spark, [p])[0] for p in pages]
    assert all("cookies" in a for a in alone)
    assert texts(spark, pages) == [f"the story {n} of the site" for n in range(6)]
