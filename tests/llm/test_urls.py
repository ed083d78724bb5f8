"""URL rules and reputations against plain Python."""

import random

from tidewatch.llm import urls
from tidewatch.llm.queries import RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def levels(host):
    name = host.rsplit("@", 1)[-1]
    head, _, port = name.rpartition(":")
    name = head if head and (port.isdigit() or not port) else name
    p = name.split(".")
    k = 2 if ".".join(p[-2:]) in urls.SECOND_LEVEL else 1
    return (name if len(p) < 2 else ".".join(p[-k - 1 :])), ".".join(p[-k:])


def bounds(pages, labels):
    bad = {}
    for d, q, t in labels:
        if d is not None and (q is not None or t is not None):
            bad[d] = max(bad.get(d, 0), int(q == 0 or t == 1))
    hosts = {}
    for page, url in pages:
        host = parts(url)[0]
        if host:
            h = hosts.setdefault(host, [0, 0])
            if page in bad:
                h[0] += 1
                h[1] += bad[page]

    def drawn(members):
        seen = [(n, x, m) for n, x, m in members.values() if n]
        more = sum(n - 1 for n, _, _ in seen)
        excess = sum(n * (x / n - m) ** 2 / (m * (1 - m)) for n, x, m in seen) - len(seen)
        r = min(max(excess / more, 0.001), 0.999) if more else 0.001
        k = 1 / r - 1
        return k, {key: (x + k * m) / (n + k) for key, (n, x, m) in members.items()}

    def grouped(key, towards):
        out = {}
        for host, (n, x) in hosts.items():
            g = out.setdefault(key(host), [0, 0, towards(host)])
            g[0] += n
            g[1] += x
        return out

    total = (sum(x for _, x in hosts.values()) + 0.5) / (sum(n for n, _ in hosts.values()) + 1.0)
    _, suffix = drawn(grouped(lambda h: levels(h)[1], lambda h: total))
    _, domain = drawn(grouped(levels, lambda h: suffix[levels(h)[1]]))
    k, own = drawn(grouped(lambda h: h, lambda h: domain[levels(h)]))
    return {h: m - urls.DEVIATIONS * (m * (1 - m) / (hosts[h][0] + k + 1)) ** 0.5 for h, m in own.items()}


def judge(url, known):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if known.get(host, 0) > urls.MAX_BAD else "allow"


def test_equals_plain_python(spark):
    r = random.Random(7)
    hosts = ["good.org", "a.bad.org", "b.bad.org", "x.co.uk", "y.x.co.uk", "WWW.Example.com", "example.com", "notexample.com", "k.net",
             "spam.net", "u@h.de:80", "localhost", "é.fr"]
    tails = ["", "/", "/en/1", "/es/2?x=/y", "/fr/#a", "?q", "#f", "/en"]
    pages = [(k, f"http{'s' * (k % 2)}://{r.choice(hosts)}{r.choice(tails)}") for k in range(400)]
    pages += [(400, None), (401, ""), (402, "no scheme/en/"), (403, "://"), (None, "http://good.org/"), (3, "http://spam.net/x"), (3, "http://spam.net/x")]
    labels = [(k, int(r.random() > (0.9 if "bad" in (u or "") or "spam" in (u or "") else 0.1)), r.choice([0, 0, None])) for k, u in pages if k and k % 2]
    labels += [(None, 0, 0), (1, None, None), (7, 0, 1), (7, 1, 0), (9999, 0, 1)]
    out = urls.filter_urls(
        spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'clash' as host", "1 as bad"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES)
    known = bounds(pages, labels)
    want = sorted([(p, *judge(u, known), parts(u)[0] in known and round(known[parts(u)[0]], 4)) for p, u in pages], key=str)
    got = sorted([(x.page_id, x.host, x.path, x.rule, x.verdict, x.bound is not None and round(x.bound, 4)) for x in out.collect()], key=str)
    assert got == want
    assert {v for _, _, _, rule, v, _ in got if rule is None} == {"allow", "block"}


def test_without_pages_or_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.filter_urls(pages, none, RULES).first().verdict == "allow"
    assert urls.filter_urls(pages.limit(0), none, []).count() == 0
