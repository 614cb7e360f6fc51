"""The rules of op3 are those of its contract, and decide as it says."""

from quillspark.llm import urls

CONTRACT = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_rules_are_the_contracts(spark):
    assert sorted(urls.RULES) == sorted(CONTRACT)
    given = ["http://a.net/de/1", "http://example.net/de/7", "http://w.example.net/de/81", "http://a.com/en/7", "http://example.com/en/71", "http://o.org/es/", "http://notnet/de/"]
    alias = '<link rel="canonical" href="http://a.net/de/1">'
    rows = [(i, u, "") for i, u in enumerate(given)] + [(7, "http://b.io/x", alias), (8, "http://o.org/es/9", alias)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("com/en/", "block"), 4: ("example.com/en/7", "allow"), 5: ("org/es/", "block"),
        6: (None, "allow"), 7: (None, "allow"), 8: ("org/es/", "block"),
    }
