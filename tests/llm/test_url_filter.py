"""Rules and aliases of urls, by hand and against SQL."""

import duckdb
import pytest
from compare import difference

from cardwatch.llm.queries import ORACLES, QUERIES, URL_RULES
from cardwatch.llm.url_filter import Rule, judge_urls, page_links

CANONICAL = '<html><head><link rel="canonical" href="{}"></head><body>x</body></html>'
REFRESH = '<head><META content="0; URL={}" http-equiv=refresh></head>'

PAGES = [
    (1, "https://www.example.com/en/1", ""),  # allow: the longer rule
    (2, "https://m.example.com/en/1?x=1#y", ""),  # block
    (3, "http://example.com/fr/1", ""),  # allow: com/
    (4, "https://a.example.net/es/9", ""),  # block
    (5, "https://a.example.net/de/9", CANONICAL.format("/es/9")),  # no rule, alias of a blocked page
    (6, "https://b.example.org/x", CANONICAL.format("https://A.example.net/de/9#part")),  # over one more link
    (7, "https://c.example.org/x", REFRESH.format("https://b.example.org/x")),  # and a redirect
    (8, "https://d.example.org/x", CANONICAL.format("https://d.example.org/x")),  # its own address
    (9, "https://e.example.org/x", CANONICAL.format("https://shop.example.com/en/none")),  # a target outside of the table
    (10, "https://f.example.org/x", CANONICAL.format("http://f.example.net/fr/")),  # blocked and allowed aliases: allowed
    (11, "https://f.example.net/fr/", CANONICAL.format("https://www.example.com/en/2")),  # its own rule blocks
    (12, None, CANONICAL.format("https://a.example.net/es/9")),
    (13, "no scheme/en/", CANONICAL.format("https://a.example.net/es/9")),
    (14, "https://g.example.org", "<!-- " + CANONICAL.format("https://a.example.net/es/9") + " -->"),
    (15, "https://h.example.org?q=/", "<script>var t='" + CANONICAL.format("https://a.example.net/es/9") + "'</script>"),
    (16, "https://i.example.org/a/b?q=1", "<link href='../es' rel='next'><link rel=alternate href=/x><meta name=refresh content='0;url=/y'>"),
    (17, "https://j.example.net/es", ""),  # the rule's path ends with a slash
    (18, "HTTPS://K.EXAMPLE.NET/ES/", ""),  # paths keep their case
    (19, "https://examplecom/en/", ""),
    (20, "https://l.example.org/a/b", CANONICAL.format("c")),  # relative to the folder
    (21, "https://l.example.org/a/c", REFRESH.format("//a.example.net/es/1?a=1&amp;b=2")),
    (22, "https://m.example.org/a", CANONICAL.format("mailto:x@example.net")),
    (23, "https://n.example.org/a", CANONICAL.format("")),
    (24, "ftp://x://com/y", None),
    (25, "://net/es/", ""),
    (2, "https://m.example.com/en/1?x=1#y", ""),
    (26, "https://o.example.org/ü?ö=/es/", CANONICAL.format("?p=2")),
    (27, "https://o.example.org/ü?p=2", REFRESH.format("https://a.example.net/fr/ß")),
]
BLOCKED = {2, 4, 5, 6, 7, 9, 11, 20, 21, 25, 26, 27}
# 9: block example.com/en/ fits shop.example.com. 20 leads to 21 and on.


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_by_hand(spark, folder):
    got = {r.page_id: r for r in QUERIES["op13_url_filter"](spark, folder).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == BLOCKED
    assert {r.verdict for r in got.values()} == {"allow", "block"}
    assert (got[1].rule, got[2].rule, got[3].rule, got[17].rule) == ("www.example.com/en/", "example.com/en/", "com/", None)
    assert (got[18].host, got[18].path, got[24].host, got[12].host, got[13].path) == ("k.example.net", "/ES/", "x:", "", "")
    assert (got[15].host, got[15].path) == ("h.example.org", "")


def test_against_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert difference(QUERIES["op13_url_filter"](spark, folder), con, ORACLES["op13_url_filter"]) is None


def test_no_python(spark, folder, capsys):
    QUERIES["op13_url_filter"](spark, folder).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Arrow", "Python", "Pandas"))


def test_long_chains_and_hubs(spark):
    """A chain of redirects whose last address is blocked, and many addresses with one canonical page."""
    chain = [(i, f"https://x.org/{i}", REFRESH.format(f"https://x.org/{i + 1}")) for i in range(60)]
    chain += [(60, "https://x.org/60", CANONICAL.format("https://y.net/es/"))]
    hub = [(1000 + i, f"https://z.org/{i}", CANONICAL.format("https://z.org/page")) for i in range(500)]
    df = spark.createDataFrame(chain + hub, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in judge_urls(df, URL_RULES).collect()}
    assert all((v == "block") == (i <= 60) for i, v in got.items()) and len(got) == 561
    bad = [*URL_RULES, Rule("block", "z.org", "/499")]
    assert all(r.verdict == "block" for r in judge_urls(df, bad).collect())
    good = [*bad, Rule("allow", "z.org", "/250")]
    assert {r.page_id for r in judge_urls(df, good).collect() if r.verdict == "block" and r.page_id >= 1000} == {1499}


def test_clashing_names_nulls_and_empty(spark):
    schema = "page_id long, url string, html string, host string, rule int, address string, row string, alias int, linked int"
    df = spark.createDataFrame([(None, "https://a.net/es/", None, "h", 1, "a", "r", 2, 3)] * 2 + [(None,) * 9], schema)
    got = judge_urls(df, URL_RULES).collect()
    assert sorted((r.host, r.rule or "", r.verdict, r.address or "", r.row or "", r.alias or 0) for r in got) == [
        ("", "", "allow", "", "", 0),
        ("a.net", "net/es/", "block", "a", "r", 2),
        ("a.net", "net/es/", "block", "a", "r", 2),
    ]
    assert judge_urls(df.limit(0), URL_RULES).collect() == [] and page_links(df.limit(0)).collect() == []


def test_attributes_of_any_form(spark):
    forms = ["<link rel=canonical href=https://t.org/a>", "<LINK\nHREF='https://t.org/a' data-href='x'\nREL='Canonical shortlink'/>",
             '<link data-rel="x" rel=" canonical " href = "https://t.org/a" >', '<meta http-equiv="Refresh" content="5.5, url=\'https://t.org/a\'">']
    df = spark.createDataFrame([(i, f"https://s.org/{i}", f) for i, f in enumerate(forms)], "page_id long, url string, html string")
    assert [r.target for r in page_links(df).collect()] == ["https://t.org/a"] * 4
