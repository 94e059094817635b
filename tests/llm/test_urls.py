from collections import defaultdict

import pytest

from kernloom.llm import urls as U


def brute(rows):
    def parse(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        return host, rest.split("?")[0].split("#")[0]

    def rule(host, path):
        fits = [(r, k) for k, r in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fits, key=lambda x: len(x[0]), default=(None, None))

    import re

    edges, share = defaultdict(int), defaultdict(list)
    for _, url, html in rows:
        host, path = parse(url)
        share[host].append(rule(host, path)[1])
        for to in re.findall(U.LINK, html or ""):
            dst = parse(to)[0]
            if host and dst and host != dst:
                edges[host, dst] += 1
    value = {}
    for way, kind in ((0, "allow"), (1, "block")):
        e = {(b, a) if way else (a, b): n for (a, b), n in edges.items()}
        out = defaultdict(int)
        for (a, _), n in e.items():
            out[a] += n
        seed = {h: v.count(kind) / len(v) for h, v in share.items() if h}
        now = dict(seed)
        for _ in range(U.ROUNDS if edges else 0):
            new = defaultdict(float, seed)
            for (a, b), n in e.items():
                new[b] += now.get(a, 0.0) * n / out[a] * U.DAMPING
            now = new
        value[way] = now
    result = []
    for i, url, _ in rows:
        host, path = parse(url)
        r, k = rule(host, path)
        bad = bool(host) and value[1].get(host, 0) - value[0].get(host, 0) >= U.LIMIT
        result.append((i, host, path, r, k or ("block" if bad else "allow")))
    return result


ROWS = [
    (1, "http://A.Example.ORG/es/x?q#f", "<a href='https://bad.com/de/1'>"),
    (2, "https://bad.com/de/7", ""),
    (3, "https://friend.net/a", '<a href="https://bad.com/de/9">x</a><a href=https://bad.com/x>'),
    (4, "https://good.net", '<a href="http://a.org/"> <a href="/rel">'),
    (5, None, None),
    (6, "no scheme", "<p>"),
    (7, "http://a.org/", '<a href="http://good.net/z">'),
    (8, "http://a.org", None),
    (9, "x://sub.example.org/en/12", ""),
    (9, "x://sub.example.org/en/12", ""),
    (10, "http://shop.com/fr/", '<a href="http://good.net/z">'),
]


def test_brute(spark):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    got = [tuple(r) for r in U.op10_url_filter(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(ROWS)))
    assert dict((r[0], r[4]) for r in got)[3] == "block"
    assert U.op10_url_filter(df.limit(0)).count() == 0
    wide = df.selectExpr("*", "1 AS host", "'v' AS verdict")
    assert U.judge_urls(wide).columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]


@pytest.mark.parametrize("n", [3])
def test_testdata(spark, n):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    assert sorted(map(str, (tuple(r) for r in U.op10_url_filter(df).collect()))) == sorted(map(str, brute(rows)))
