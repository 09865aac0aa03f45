import math
from collections import Counter, defaultdict

from spindrift.llm import url_filter as uf

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/77?q#f", "https://example.com/en/8", "x://y://z/en/", "http://example.net/de/81", "http://a.b.example.net/de/9", "http://example.org/es/1", "http://notexample.com/en/7", "http://com/en/", "http://host?x=/en/", "http://ÉX.com/EN/"]


def table(spark):
    urls = URLS + [f"http://shop{i % 7}.example.net/de/{i}" for i in range(60)] + [f"https://spam-{i % 5}.example.org/es/{i}.html" for i in range(60)] + [f"http://spam-{i}.example.org/fr/{i}" for i in range(8)] + [f"http://shop{i}.example.net/fr/{i}" for i in range(8)]
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, *urls[-3:]])], "page_id long, url string, verdict string").repartition(3), [*urls, *urls[-3:]]


def parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
    path = rest[n:]
    return host, path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_against_plain(spark):
    """Hosts, paths, rules, and the models' scores by a plain implementation."""
    pages, urls = table(spark)
    got = {r.page_id: r for r in uf.judge(pages).collect()}
    assert len(got) == len(urls)
    import zlib

    texts = {}
    for i, u in enumerate(urls):
        host, path = parts(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule(host, path)[0])
        texts[host + path] = rule(host, path)[1]
    counts = {1: Counter(), 0: Counter()}
    grams = lambda t: [("\x02" * uf.ORDER + t + "\x03")[i : i + uf.ORDER + 1] for i in range(len(t) + 1)]
    held = {t: zlib.crc32(t.encode()) % uf.HOLD == 0 for t in texts}
    for t, v in texts.items():
        if v and not held[t]:
            counts[v == "block"].update(grams(t))
    tables = {s: [Counter() for _ in range(uf.ORDER + 1)] for s in (0, 1)}
    for s in (0, 1):
        for g, n in counts[s].items():
            for k in range(uf.ORDER + 1):
                tables[s][k][g[-k - 1 :]] += n
    heads = {s: [defaultdict(lambda: [0, 0]) for _ in range(uf.ORDER + 1)] for s in (0, 1)}
    for s in (0, 1):
        for k in range(uf.ORDER + 1):
            for g, n in tables[s][k].items():
                heads[s][k][g[:-1]][0] += n
                heads[s][k][g[:-1]][1] += 1

    def p(s, g):
        out = 1 / 65536
        for k in range(uf.ORDER + 1):
            n, t = heads[s][k].get(g[-k - 1 : -1], (0, 0))
            if n:
                out = (tables[s][k][g[-k - 1 :]] + t * out) / (n + t)
        return out

    for i, u in enumerate(urls):
        if got[i].rule is None:
            g = grams(got[i].host + got[i].path)
            assert abs(got[i].score - sum(math.log(p(1, x) / p(0, x)) for x in g) / len(g)) < 1e-5
            assert got[i].verdict in ("allow", "block")
        else:
            assert got[i].verdict == rule(got[i].host, got[i].path)[1]
    assert got[len(URLS) + 120].verdict == "block" and got[len(URLS) + 128].verdict == "allow"


def test_empty_and_unlabelled(spark):
    pages, _ = table(spark)
    assert uf.judge(pages.where("page_id < 0")).collect() == []
    assert {r.verdict for r in uf.judge(pages.where("page_id in (0, 1, 12)")).collect()} == {"allow"}


def test_no_python_on_executors(spark):
    plan = uf.judge(table(spark)[0])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
