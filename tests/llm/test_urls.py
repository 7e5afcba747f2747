"""URL rules and trust propagation against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from keelson.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def brute(pages, rules=urls.RULES):
    each = [(p, *split(u)) for p, u, _ in pages]
    ruled = [rule(h, path, rules) for _, h, path in each]
    n, allow, block = Counter(), Counter(), Counter()
    for (_, h, _), r in zip(each, ruled):
        if h:
            n[h] += 1
            allow[h] += r is not None and r.verdict == "allow"
            block[h] += r is not None and r.verdict == "block"
    edges = Counter()
    for (_, h, _), (_, _, html) in zip(each, pages):
        for x in re.findall(r"""(?i)href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+|//[^"'\s>]+)""", html or ""):
            d = split("http:" + x if x.startswith("//") else x)[0]
            if h and d and h != d:
                edges[h, d] += 1
    seeds = {"trust": {h: allow[h] for h in n if block[h] == 0 and allow[h]}, "distrust": {h: block[h] for h in n if block[h] == n[h]}}
    score = {}
    for kind, mass in seeds.items():
        total = sum(mass.values())
        start = {h: m / total for h, m in mass.items()}
        own = {(a, b) if kind == "trust" else (b, a): w for (a, b), w in edges.items()}
        out = defaultdict(int)
        for (a, _), w in own.items():
            out[a] += w
        s = dict(start)
        for _ in range(urls.ROUNDS if edges else 0):
            t = defaultdict(float, {h: m * (1 - urls.DAMPING) for h, m in start.items()})
            for (a, b), w in own.items():
                t[b] += s.get(a, 0) * w / out[a] * urls.DAMPING
            s = t
        score[kind] = s
    result = []
    for (p, h, path), r in zip(each, ruled):
        d, t = score["distrust"].get(h, 0), score["trust"].get(h, 0)
        by_host = "block" if d > urls.THRESHOLD / max(len(n), 1) and d > t else "allow"
        result.append((p, h, path, r.text if r else None, r.verdict if r else by_host))
    return sorted(result, key=repr)


PLAIN = [
    (0, "http://a.com/en/1", None), (1, "HTTPS://A.Example.COM/en/7x?q=//z", ""), (2, "http://example.com/en/8", "x"), (3, "http://x.net/de/", None), (4, "http://example.net/de/8#f", None), (5, "http://org/es/", None),
    (6, None, "x"), (7, "no scheme", None), (8, "http://", None), (9, "http://notcom/en/", None), (10, "http://b.org?es/", None), (11, "ftp://É.com:80/EN/", None), (11, "ftp://É.com:80/EN/", None), (None, "http://a.com/en/1", None), (12, "x\n://h.org/es/a", None),
]


def link(*hosts):
    return " ".join(f'<a href="http://{h}/p">x</a>' for h in hosts)


def test_rules(spark):
    df = spark.createDataFrame(PLAIN, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit("x"), "kind": F.lit(0)})
    assert sorted((tuple(r) for r in urls.judge(df).collect()), key=repr) == brute(PLAIN)
    assert urls.judge(df.where("false")).collect() == []


@pytest.mark.parametrize("hub", [1, 400])
def test_trust_flows(spark, hub):
    """farm.org only has blocked pages; who links to it is distrusted, unless trusted more."""
    pages = [(i, f"http://farm.org/es/{i}", link("shop.info")) for i in range(5)]
    pages += [(10, "http://spam.info/x", link("farm.org", "farm.org")), (11, "http://friend.info/", link("spam.info")), (12, "http://good.net/de/1", link("fine.info", "spam2.info"))]
    pages += [(13, "http://fine.info/", link("farm.org")), (14, "http://spam2.info/", ""), (15, "http://alone.info/", "")]
    pages += [(100 + i, f"http://fine.info/{i}", link("spam2.info") + "<a href='/relative'>") for i in range(hub)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(pages)
    verdict = {r.page_id: r.verdict for r in got}
    assert verdict[10] == "block" and verdict[15] == "allow" and verdict[14] == "allow"


def test_walk_is_whole(spark):
    """On a chain of 30 hosts the 13th link still brings 0.15 * 0.85^13 > 0.5 / 30, the 14th does not."""
    pages = [(i, f"http://h{i}.info/", link(f"h{i - 1}.info") if i else "") for i in range(30)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), blocked=("h0.info",)).collect()
    assert sorted(r.page_id for r in got if r.verdict == "block") == list(range(14))
