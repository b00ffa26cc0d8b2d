from rankwell.llm.url_filters import filter_urls

PAGES = "page_id long, url string, html string, host string, verdict int"


def canonical(url):
    return f'<html><head><LINK href="{url}" data-x=1 rel="canonical"></head>'


def refresh(url):
    return f"<meta http-equiv='refresh' content='0; URL={url}'>"


def judge(spark, rows, **more):
    pages = spark.createDataFrame([(i, url, html, "clash", 7) for i, (url, html) in enumerate(rows)], PAGES)
    out = filter_urls(pages, **more).collect()
    return {row.page_id: (row.host, row.path, row.rule, row.verdict) for row in out}


def test_rules(spark):
    got = judge(
        spark,
        [
            ("http://A.Example.org/es/1?x=1", None),
            ("http://example.org/en/12", ""),
            ("http://b.example.org/fr/", None),
            ("http://x.com/de/", None),
            ("http://x.com/fr/de/", None),
            ("http://xcom/de/", None),
            ("no url", None),
            (None, None),
            ("https://org", None),
            ("http://notexample.org/es/", None),
        ],
    )
    assert [got[i][2:] for i in range(10)] == [
        ("example.org/es/", "block"),
        ("example.org/en/1", "block"),
        ("org/", "allow"),
        ("com/de/", "block"),
        ("com/fr/", "allow"),
        (None, "allow"),
        (None, "allow"),
        (None, "allow"),
        (None, "allow"),
        ("org/", "allow"),
    ]
    assert got[0][:2] == ("a.example.org", "/es/1") and got[6][:2] == got[7][:2] == ("", "")


def test_of_rules_of_equal_length_an_allow_goes_first(spark):
    block, allow = ("block", "org", "/abc"), ("allow", "x.org", "/a")  # seven characters each
    rows = [("http://x.org/abc", None), ("http://y.org/abcd", None), ("http://x.org/ax", None), ("http://org/ab", None)]
    for rules in ([block, allow], [allow, block]):
        got = judge(spark, rows, rules=rules)
        assert [got[i][2:] for i in range(4)] == [("x.org/a", "allow"), ("org/abc", "block"), ("x.org/a", "allow"), (None, "allow")]


def test_blocks_reach_aliases_and_allow_goes_first(spark):
    got = judge(
        spark,
        [
            ("http://x.com/de/bad", None),
            ("https://a.net/1", canonical("http://x.com/de/bad")),
            ("http://b.net/2#top", refresh("https://a.net/1")),
            ("http://c.net/3", canonical("/4")),
            ("http://c.net/4", canonical("//d.net/deep/5")),
            ("http://d.net/deep/6", canonical("5")),
            ("http://d.net/7", canonical("http://c.net/3") + canonical("http://y.com/de/") + canonical("http://y.com/fr/")),
            ("http://e.net/", None),
            ("http://f.net/8", canonical("http://unseen.com/de/9")),
        ],
    )
    assert [got[i][3] for i in range(9)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow", "block"]


def test_redirect_table_chain_and_hub(spark):
    chain = [(f"http://n.net/{i}", f"http://n.net/{i + 1}", 0) for i in range(40)]
    hub = [(f"http://s.net/{i}", "http://x.com/de/hub", 0) for i in range(60)]
    redirects = spark.createDataFrame(chain + hub + [("http://n.net/40", "http://x.com/de/", 0)], "host string, key string, n int")
    rows = [(f"http://n.net/{i}", None) for i in range(41)] + [(f"http://s.net/{i}", None) for i in range(60)]
    got = judge(spark, rows + rows[:1], redirects=redirects)
    assert {v[3] for v in got.values()} == {"block"} and len(got) == 102


def test_components_match_union_find(spark):
    import random

    from rankwell.llm.components import connected_components

    dice = random.Random(5)
    edges = [(dice.randrange(300), dice.randrange(300)) for _ in range(220)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent}


def test_empty(spark):
    assert filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_a_hub_that_a_third_of_all_pages_points_to(spark):
    hub = "http://hub.example.org/es/"
    rows = [(i, f"http://site{i}.net/p", f'<link rel="canonical" href="{hub}">') for i in range(900)]
    rows += [(1000 + i, f"http://free{i}.net/", "") for i in range(300)] + [(5000 + i, rows[0][1], rows[0][2]) for i in range(400)]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert {v for i, v in got.items() if i < 1000 or i >= 5000} == {"block"} and {v for i, v in got.items() if 1000 <= i < 5000} == {"allow"}
