import random

from pagemill.llm import common
from pagemill.llm import url_rules as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, path[:stop]


def rule(host, path, rules=U.RULES):
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def test_rules_equal_brute_force(spark):
    draw = random.Random(6)
    hosts = ["example.org", "a.example.org", "x.com", "Y.COM", "org", "xorg", "com.net", "é.org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q#f", "/fr/x", "/de/#a", "?x=/de/", "#://", "/EN/1"]
    urls = [None, "", "no scheme", "://", "://org/", "http://a://b.org/c"]
    urls += [draw.choice(["http", "https"]) + "://" + draw.choice(hosts) + draw.choice(paths) for _ in range(200)]
    rows = [(i, u, None if i % 7 == 0 else "<html>canonical</html>", "x") for i, u in enumerate(urls)] + [(None, "http://q.com/de/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge(pages).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        host, path = parts(u)
        name, verdict = rule(host, path)
        assert got[i] == (host, path, name, verdict or "allow"), u
    assert U.judge(pages.limit(0)).count() == 0


def test_blocks_reach_aliases_and_allow_comes_first(spark):
    rows = [
        (1, "http://x.net/a", '<link rel="canonical" href="http://y.com/de/1">'),
        (2, "http://x.net/b", "<META HTTP-EQUIV=refresh content='0; URL=/a'>"),
        (3, "http://y.com/fr/1", "<link href=http://x.net/b rel='nofollow canonical'>"),
        (4, "http://x.net/c", "<!-- <link rel=canonical href=/a> --><link rel=stylesheet href=/a>"),
        (5, "http://x.net/d", '<script>"<link rel=canonical href=/a>"</script>'),
        (6, "http://X.net/b#top", None),
        (6, "http://X.net/b#top", None),
        (7, "http://x.net/e", None),
        (8, "http://x.net/f", "<link rel=canonical href=/g>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://x.net/e", "/b"), (None, "/b"), ("http://x.net/e", None)], "url string, target string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in U.judge(pages, redirects=redirects).select("page_id", "rule", "verdict").na.fill("").collect())
    assert got == [
        (1, "", "block"),
        (2, "", "block"),
        (3, "com/fr/", "allow"),
        (4, "", "allow"),
        (5, "", "allow"),
        (6, "", "block"),
        (6, "", "block"),
        (7, "", "block"),
        (8, "", "allow"),
    ]


def test_aliases_in_any_spelling(spark):
    link = lambda to: f'<link rel="canonical" href="{to}">'
    bad = "http://y.com/de/"
    rows = [
        (1, bad + "1", link("http://a.net/für")), (11, "http://a.net/f%C3%BCr", None), (12, "HTTP://A.net/für#x", ""),
        (2, bad + "2", link("http://b.net&#47;p")), (21, "http://b.net/p", "<p>"),
        (3, bad + "3", link("http://c.net/p?a=1&#38;b=2")), (31, "http://c.net/p?a=1&b=2", None), (32, "http://c.net/p?a=1", None),
        (4, bad + "4", link("http://d.net/")), (41, "http://d.net", None), (42, "http://d.net?q", None),
        (5, bad + "5", "<link rel=canon&#105;cal href=//e.net/x>"), (51, "http://e.net/x", None),
        (6, bad + "6", "<meta http-equiv=' Refresh ' content='3 ; url = &quot;http://f.net/ü?ü'>"), (61, "http://f.net/%C3%BC?ü", None),
        (7, bad + "7", "<title><link rel=canonical href=http://g.net/></title>"), (71, "http://g.net/", None),
        (8, bad + "8", "<link " * 5000 + "rel=canonical href='http://h.net/\n'>" + "&" * 20000), (81, "http://h.net/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages).collect()}
    assert {i for i, v in got.items() if i > 10 and v == "block"} == {11, 12, 21, 31, 41, 51, 61, 81}
    assert all(got[i] == "block" for i in range(1, 9))


def test_random_alias_graphs_equal_brute_force(spark):
    """Pages in random spellings that name each other: blocks reach what a plain union of the addresses says."""
    draw = random.Random(8)
    base = ["http://n{}.net/ü{}", "http://n{}.net/p{}?a=1&b=ü", "http://y.com/de/{}{}", "http://y.com/fr/{}{}", "http://n{}.net"]
    spots = [draw.choice(base).format(k, k) for k in range(60)]

    def spelled(url):
        url = url.replace("http", draw.choice(("http", "HTTP")), 1)
        host = url.split("://")[1].split("/")[0]
        url = url.replace(host, draw.choice((host, host.upper())), 1)
        url = draw.choice((url, url.replace("ü", "%C3%BC", 1) if "?" not in url else url))
        return url + draw.choice(("", "#f")) if "/" in url.split("://")[1] else url + draw.choice(("", "/"))

    def quoted(url):
        return url.replace("&", draw.choice(("&", "&amp;", "&#38;"))).replace("/", draw.choice(("/", "&#47;")))

    root = list(range(60))
    top = lambda x: x if root[x] == x else top(root[x])
    rows = []
    for k in range(90):
        at, to = draw.randrange(60), draw.randrange(60)
        html = draw.choice(("<link rel='x canonical' href='{}'>", '<meta http-equiv=refresh content="0;url={}">')).format(quoted(spelled(spots[to])))
        if draw.random() < 0.5:
            root[top(at)] = top(to)
        else:
            html = html.replace("canonical", "other").replace("refresh", "x-other")
        rows.append((k, spelled(spots[at]), html, at))
    blocked = {top(k) for k in range(60) if "/de/" in spots[k]}
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages).collect()}
    for k, url, _, at in rows:
        want = "allow" if "/fr/" in url else "block" if "/de/" in url or top(at) in blocked else "allow"
        assert got[k] == want, url


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB_ROWS", 20)
    edges = [(0, k) for k in range(1, 300)] + [(k, 1000 + k) for k in range(1, 300, 7)] + [(5000, k) for k in range(4000, 4100)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 0 if x < 4000 else 4000 for e in edges for x in e}


def test_components_equal_union_find(spark):
    draw = random.Random(12)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)] + [(2000, 2001 + i) for i in range(200)] + [(None, 3), (4, None)]
    root: dict = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}


def test_global_rank(spark):
    rows = [(i % 5, i) for i in range(1000)] + [(None, 7)]
    got = common.ordered_rank(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["_rank"])] == want
