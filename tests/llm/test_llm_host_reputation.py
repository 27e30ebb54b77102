"""URL filter: parts of urls and rules by a plain version, posteriors by plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import host_reputation as HR

URLS = ["https://a.example.net/en/1?x=/de/", "http://example.net/en", "http://EXAMPLE.NET/en/", "https://x.example.com/de/p#q",
        "https://example.com/de", "http://org/fr/1", "http://www.site.org/fr/1", "http://www.site.org/fra", "ftp://host", "nothing", None, "",
        "http://notnet/", "http://net", "http://net/", "http://foo.net?x", "http://foo.net#/", "a://b://c/d", "http:///p", "http://u@h.net:80/x",
        "http://\u00c9X.net/\n/en/", "//x.net/"]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in HR.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def pages(spark, urls):
    d = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    for c in ("host", "path", "rule", "verdict", "n", "bad", "_d", "_salt", "mean"):
        d = d.withColumn(c, F.lit("x"))
    return d


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "host string, bad int")


def test_parts_and_rules(spark):
    got = {r.page_id: r for r in HR.filter_urls(pages(spark, [*URLS, URLS[0]]), outcomes(spark, [])).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate([*URLS, URLS[0]]):
        host, path = parts(u)
        text, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, text), u
        assert got[i].verdict == (verdict or "allow")  # without labels nothing is known against a host


def test_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "u@h.net:80": ("h.net", "net"),
             "notco.uk": ("notco.uk", "uk"), "localhost": ("localhost", "localhost"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "": ("", ""), "a.org.": ("a.org", "org")}
    d = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.d, r.s) for r in d.select("host", *[c.alias(n) for c, n in zip(HR.registered(F.col("host")), "ds", strict=True)]).collect()}
    assert got == hosts


def weight(groups):
    """groups: (n, bad, prior mean)."""
    use = [(n, b, min(max(m, 1e-6), 1 - 1e-6)) for n, b, m in groups if n >= 2]
    scale = sum(n * m * (1 - m) * (1 - 1 / n) for n, b, m in use)
    if not use or scale <= 0:
        return HR.PLAIN_WEIGHT
    rho = sum(n * ((b / n - m) ** 2 - m * (1 - m) / n) for n, b, m in use) / scale
    return 1 / min(max(rho, 1e-4), 0.95) - 1


def test_posteriors(spark):
    rng = random.Random(5)
    rate = {f"{h}.{d}.{s}": min(1, max(0, {"com": 0.1, "net": 0.5}[s] + 0.3 * (d == "bad") + rng.uniform(-0.1, 0.1)))
            for s in ("com", "net") for d in ("bad", "good", "mid") for h in "abcdefgh"}
    rows = [(h, int(rng.random() < p)) for h, p in rate.items() for _ in range(rng.randrange(1, 30))]

    def total(key):
        out = {}
        for h, b in rows:
            n, k = out.get(key(h), (0, 0))
            out[key(h)] = n + 1, k + b
        return out
    end, name, host = total(lambda h: h.split(".")[-1]), total(lambda h: h.split(".", 1)[1]), total(lambda h: h)
    overall = (sum(b for _, b in rows) + 0.5) / (len(rows) + 1)
    w = weight([(*c, overall) for c in end.values()])
    mean_end = {k: (b + w * overall) / (n + w) for k, (n, b) in end.items()}
    w = weight([(*c, mean_end[k.split(".")[-1]]) for k, c in name.items()])
    mean_name = {k: (b + w * mean_end[k.split(".")[-1]]) / (n + w) for k, (n, b) in name.items()}
    w = weight([(*c, mean_name[k.split(".", 1)[1]]) for k, c in host.items()])
    own, rest, got_w = HR.reputation(outcomes(spark, rows))
    assert got_w == pytest.approx(w, rel=1e-9)
    got = {r.host: r for r in own.collect()}
    assert set(got) == set(host)
    for k, (n, b) in host.items():
        mean = (b + w * mean_name[k.split(".", 1)[1]]) / (n + w)
        assert (got[k].n, got[k].bad) == (n, b) and got[k].mean == pytest.approx(mean, rel=1e-9)
        # the bound is exceeded with the stated probability, by simulation
        draws = sorted(rng.betavariate(mean * (n + w), (1 - mean) * (n + w)) for _ in range(4000))
        assert abs(sum(x < got[k].bound for x in draws) / 4000 - 0.05) < 0.02
    fall = {(r.domain, r.suffix): r.mean for r in rest.collect()}
    assert fall[None, "com"] == pytest.approx(mean_end["com"]) and fall["bad.net", "net"] == pytest.approx(mean_name["bad.net"])
    assert fall[None, None] == pytest.approx(overall)


def test_bad_hosts_are_blocked_and_few_labels_do_not_suffice(spark):
    rows = [("spam.example.org", 1)] * 40 + [("good.example.org", 0)] * 40 + [("one.example.org", 1)] + \
        [(f"h{i}.example.org", int(j < i % 3)) for i in range(30) for j in range(6)]
    urls = [f"http://{h}/x" for h in ("spam.example.org", "good.example.org", "one.example.org", "new.example.org")]
    for broadcast in (100, 0):  # the salted join gives the same
        got = {r.host: r.verdict for r in HR.filter_urls(pages(spark, urls * 3), outcomes(spark, rows), broadcast_hosts=broadcast).collect()}
        assert got == {"spam.example.org": "block", "good.example.org": "allow", "one.example.org": "allow", "new.example.org": "allow"}


def test_labels_through_shown_text(spark):
    line = "a line of text that is long enough to tell a document from another, number {}"
    docs = spark.createDataFrame([(i, "\n".join([line.format(i), "short", line.format(99)])) for i in range(4)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    html = [f"<p>{line.format(i)}</p><p>short</p>" for i in range(5)] + [None, "", f"<p>{line.format(0)}</p><p>{line.format(1)}</p><p>{line.format(2)}</p>"]
    p = spark.createDataFrame([(i, f"http://h{i}/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.host: r.bad for r in HR.outcomes_from_documents(p, docs, labels).collect()}
    assert got == {"h0": 0, "h1": 1, "h2": 1, "h7": 1}


def test_empty_table(spark):
    assert HR.filter_urls(pages(spark, URLS).limit(0), outcomes(spark, [])).count() == 0
