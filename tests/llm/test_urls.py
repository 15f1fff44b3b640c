from compare import assert_same, connect, same_types
from conftest import MEDIUM, SMALL

from cohortlab.llm import urls
from cohortlab.llm.oracles import SQL
from cohortlab.llm.queries import REGISTRY

NAME = "op6_url_filter"
PAGES = [
    (1, "http://a.org/x", '<link rel="canonical" href="https://b.example.com/en/1">'),
    (2, "https://b.example.com/en/1/", ""),
    (3, "http://c.org/y", "<META http-equiv=refresh content='0; url=/z'>"),
    (4, "http://www.c.org/z?utm_source=q", "<p><link href=http://www.example.com/en/9 rel=canonical>"),
    (5, "http://www.example.com/en/9", None),
    (6, None, None),
    (7, "HTTPS://B.Example.COM/EN", None),
    (8, "http://d.org/q#top", "<link rel=canonical href=//a.org/x>"),
    (9, "no-url", "<link rel=canonical href=http://b.example.com/en/1>"),
    (10, "http://e.org/p", '<link rel="canonical" href="http://blocked.net/es/2?a=1&amp;ref=z">'),
    (11, "http://f.org/p", '<link rel="canonical" href="http://e.org/p/">'),
    (12, "http://blocked.net/es/2?a=1", None),
    (13, "http://f.org/p?page=2", None),
    (14, "http://g.org", "<link rel=canonical href=http://www.example.com/en/9><meta http-equiv=refresh content='1;URL=http://b.example.com/en/1'>"),
    (None, "http://x.net/fr/1", None),
    (10, "http://e.org/p", '<link rel="canonical" href="http://blocked.net/es/2?a=1&amp;ref=z">'),
]
SCHEMA = "page_id long, url string, html string, node string, rule string"


def planted(spark, *drop):
    return spark.createDataFrame([(*p, "n", "r") for p in PAGES if p[0] not in drop], SCHEMA)


def verdicts(df):
    return {r["page_id"]: (r["rule"], r["verdict"], r["decided_by"]) for r in df.collect()}


def test_decisions_reach_aliases(spark):
    got = verdicts(urls.judge(planted(spark, 14)))
    assert got[1] == got[8] == (None, "block", "alias")
    assert got[2] == ("example.com/en/", "block", "rule")
    assert got[3] == got[4] == (None, "allow", "alias")
    assert got[5] == ("www.example.com/en/", "allow", "rule")
    assert got[6] == got[9] == (None, "allow", "default")
    assert got[7] == ("com/", "allow", "rule")
    assert got[10] == got[11] == (None, "block", "alias") and got[13] == (None, "allow", "default")
    assert got[None] == ("net/fr/", "block", "rule")


def test_explicit_allow_goes_first(spark):
    got = verdicts(urls.judge(planted(spark)))
    # Page 14 joins an allowed and a blocked component.
    assert got[14] == got[1] == got[3] == (None, "allow", "alias")
    assert got[2][1] == "block"


def test_redirect_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1"), (2, "http://b.org/2")], "page_id long, url string")
    chain = [("http://a.org/1", "http://s.org/0")] + [(f"http://s.org/{i}", f"http://s.org/{i + 1}") for i in range(40)]
    chain.append(("http://s.org/40", "http://n.net/es/5"))
    redirects = spark.createDataFrame(chain, "source string, target string")
    ruled = pages.union(spark.createDataFrame([(3, "http://n.net/es/5")], pages.schema))
    assert verdicts(urls.judge(ruled, redirects=redirects))[1] == (None, "block", "alias")
    assert verdicts(urls.judge(ruled))[1] == (None, "allow", "default")


def test_planted_pages_against_sql(spark):
    con = connect(SMALL)
    frame = planted(spark).toPandas()
    con.register("planted", frame)
    con.execute("create or replace view pages as select page_id::bigint as page_id, url, html from planted")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert assert_same(urls.judge(pages), con, SQL[NAME]) == len(PAGES)


def test_against_sql(spark):
    con = connect(MEDIUM)
    result = REGISTRY[NAME](spark, MEDIUM)
    assert same_types(result, con, SQL[NAME]) == []
    assert assert_same(result, con, SQL[NAME]) == 250


def test_empty_and_long(spark):
    assert urls.judge(planted(spark).limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://a.com/" + "x" * 200_000, "<link " * 50_000)], "page_id long, url string, html string")
    row = urls.judge(long).first()
    assert len(row["path"]) == 200_001 and row["rule"] == "com/"
