import re
from collections import defaultdict

import pytest

from tests.llm.conftest import order
from veilwright.llm import url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OP3_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def hosts_of(html):
    """Hosts of absolute and scheme-relative links, by cutting at ``href``."""
    out = set()
    for k, tail in enumerate(re.split(r"(?i)\shref", html or "")):
        tail = tail.lstrip()
        if k and tail.startswith("="):
            value = tail[1:].lstrip()
            value = value[1:].lstrip() if value[:1] in ("'", '"') else value
            head, sep, rest = value.partition("//")
            if sep and (head == "" or head.endswith(":") and head[0].isascii() and head[0].isalpha() and all(c.isascii() and (c.isalnum() or c in "+.-") for c in head[:-1])):
                host = re.split(r"""[/?#"'\s<>]""", rest, maxsplit=1)[0]
                out |= {host.translate(LOWER)} - {""}
    return out
SCHEMA = "page_id long, url string, html string, host string, path string, rule string, links string, fit string, src string, dst string"


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].translate(LOWER), m[2]


def rule_of(host, path, rules):
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = len(h) + len(p), verdict == "block"
            if best is None or rank > best[0]:
                best = rank, h + p, verdict
    return (None, None) if best is None else best[1:]


def spread(seeds, links):
    """Dense: rank = seed + 0.85 * what comes in, until nothing moves any more."""
    now = dict(seeds)
    for _ in range(400):
        new = dict(seeds)
        for a, out in links.items():
            for b in out:
                new[b] = new.get(b, 0.0) + 0.85 * now.get(a, 0.0) / len(out)
        now = new
    return now


def brute(pages, rules):
    cut = [(k, *split_url(u), hosts_of(h)) for k, u, h in pages]
    fits = [rule_of(host, path, rules) for _, host, path, _ in cut]
    out, back, all_of = defaultdict(set), defaultdict(set), defaultdict(list)
    for (_, host, _, links), (_, verdict) in zip(cut, fits, strict=True):
        if host:
            all_of[host].append(verdict)
            for x in links - {host}:
                out[host].add(x)
                back[x].add(host)
    seeds = lambda v: {h: x.count(v) / len(x) for h, x in all_of.items() if v in x}
    trust, doubt = spread(seeds("allow"), out), spread(seeds("block"), back)
    bad = {h for h, x in doubt.items() if x >= 0.5 and x > trust.get(h, 0.0)}
    return order((k, host, path, rule, verdict or ("block" if host in bad else "allow")) for (k, host, path, _), (rule, verdict) in zip(cut, fits, strict=True))


def result(df):
    return order((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect())


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)


EDGE = [
    (1, "http://bad.net/es/1", link("worse.org")),
    (2, "http://bad.net/es/2?x=/fr/", None),
    (3, "https://links-to-bad.org/a", link("bad.net", "bad.net")),
    (4, "https://links-to-links.org/a", link("links-to-bad.org")),
    (5, "https://fine.org/a", link("good.com")),
    (6, "https://good.com/a", link("fine.org", "links-to-bad.org")),
    (7, "HTTP://WWW.Example.COM/en/x#y", ""),
    (8, "http://example.com/en/", ""),
    (8, "http://example.com/en", ""),
    (9, "http://a.example.com/en/1", ""),
    (10, None, link("bad.net")),
    (11, "no scheme /en/", None),
    (12, "://", None),
    (13, "http://", link("bad.net")),
    (14, "http://notnet.xnet/es/", None),
    (15, "http://net/es/", None),
    (16, "http://é.net?/es/", '<a class=x HREF = \'//Bad.NET:80/\'>'),
    (17, "http://x.org:8080/../es/", "<a href='/local'><a href=mailto:a@b>"),
    (None, "http://null.org/", link("bad.net")),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", "r", "l", "f", "s", "d") for r in rows], SCHEMA).repartition(3)


def test_equals_brute_force(spark, smoke):
    assert result(url_filter.judge(frame(spark, EDGE), OP3_RULES)) == brute(EDGE, OP3_RULES)
    assert result(url_filter.judge(frame(spark, []), OP3_RULES)) == []
    pages = [tuple(r) for r in spark.read.parquet(f"{smoke}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(url_filter.op3(spark, smoke)) == brute(pages, OP3_RULES)


def test_distrust_goes_against_links(spark):
    rows = [(1, "http://bad.net/es/1", link("victim.org")), (2, "https://farm.org/a", link("bad.net", "farm2.org")), (3, "https://farm2.org/a", link("farm.org")), (4, "https://fine.org/a", link("good.com")), (5, "https://good.com/a", link("fine.org")), (6, "https://victim.org/", None)]
    got = {r.page_id: r.verdict for r in url_filter.judge(frame(spark, rows), OP3_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_a_long_chain_near_the_threshold(spark):
    """Distrust of a cycle that 60 hosts feed: it settles after some seventy rounds, and not before twenty."""
    ring = [(k, f"http://r{k}.org/", link(f"r{(k + 1) % 60}.org")) for k in range(60)]
    rows = [*ring, (100, "http://r0.org/", link("bad.net")), (101, "http://bad.net/es/1", None), (102, "http://two.org/", link("bad.net", "good.com")), (103, "http://good.com/", None)]
    assert result(url_filter.judge(frame(spark, rows), OP3_RULES)) == brute(rows, OP3_RULES)
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    got = {r.host: r.score for r in url_filter.propagate(spark.createDataFrame([("a", 1.0)], "host string, seed double"), links).collect()}
    assert got == pytest.approx({"a": 1 / (1 - 0.85**2), "b": 0.85 / (1 - 0.85**2)}, abs=1e-4)


@pytest.mark.parametrize("hub", [300])
def test_a_hub_host(spark, hub):
    rows = [(k, f"http://h{k}.org/", link("hub.net")) for k in range(hub)] + [(hub + k, f"http://hub.net/{'es' if k % 2 else 'de'}/{k}", link(f"h{k}.org")) for k in range(hub)]
    assert result(url_filter.judge(frame(spark, rows), OP3_RULES)) == brute(rows, OP3_RULES)


def test_plans_have_no_python(spark, smoke):
    plan = url_filter.op3(spark, smoke)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
