"""Hosts, paths, rules and the template tree against a plain version."""

import math
import re
from collections import defaultdict

import pytest

from tests.llm.conftest import SF
from tremor.llm import url_tree

PAGES = "page_id long, url string, html string, host string, path string, n long, template string"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain(rows):
    urls = [(i, *parsed(u)) for i, u in rows]
    rule = {(h, p): ruled(h, p) for _, h, p in urls}
    count = defaultdict(int)
    for _, h, p in urls:
        count[h, p] += 1
    split = lambda p: [x for x in p.split("/") if x]
    segs = {}
    for h, p in count:
        s = split(p)
        segs[h, p] = s if len(s) <= url_tree.DEPTH else s[: url_tree.DEPTH - 1] + ["/".join(s[url_tree.DEPTH - 1 :])]
    good = {k: n * (rule[k][0] == "allow") for k, n in count.items()}
    bad = {k: n * (rule[k][0] == "block") for k, n in count.items()}
    template = dict.fromkeys(count, "")
    for d in range(url_tree.DEPTH):
        child, node = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
        for k in count:
            if len(segs[k]) > d:
                c = child[k[0], template[k], segs[k][d]]
                for x, v in enumerate((count[k], good[k], bad[k])):
                    c[x] += v
                node[k[0], template[k]][0] += good[k]
                node[k[0], template[k]][1] += bad[k]
        new = {}
        for k in count:
            if len(segs[k]) <= d:
                new[k] = template[k]
                continue
            n, g, b = child[k[0], template[k], segs[k][d]]
            ng, nb = node[k[0], template[k]]
            a, o = g + b, ng + nb - g - b
            literal = False
            if a and o and ng and nb and n >= url_tree.SUPPORT and not re.search("[0-9]", segs[k][d]):
                q = nb / (a + o)
                literal = abs(b / a - (nb - b) / o) / math.sqrt(q * (1 - q) * (1 / a + 1 / o)) >= url_tree.Z
            new[k] = template[k] + "/" + (segs[k][d] if literal else "*")
        template = new
    lead = {k: "" if not segs[k] else "*" if re.search("[0-9]", segs[k][0]) else segs[k][0] for k in count}
    total = (sum(bad.values()) + 1) / (sum(bad.values()) + sum(good.values()) + 2)
    lsum, tsum = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k in count:
        for s in (lsum[lead[k]], tsum[k[0], template[k], lead[k]]):
            s[0] += good[k]
            s[1] += bad[k]
    out = []
    for i, h, p in urls:
        k = h, p
        lg, lb = lsum[lead[k]]
        tg, tb = tsum[h, template[k], lead[k]]
        over = (lb + 2 * total) / (lg + lb + 2)
        pure = (tb + 2 * over) / (tg + tb + 2)
        out.append((i, h, p, rule[k][1], rule[k][0] or ("block" if pure > 0.5 else "allow"), template[k], pure))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"], r["purity"]) for r in df.collect()), key=str)


def same(a, b):
    assert [x[:6] for x in a] == [x[:6] for x in b]
    assert [x[6] for x in a] == pytest.approx([x[6] for x in b], abs=1e-6)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_supplied_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    same(got(url_tree.op5_url_tree(spark, sf)), plain([(r["page_id"], r["url"]) for r in pages.collect()]))


def test_odd_urls(frame):
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "http://xorg/a", "http://a.Example.ORG/es/1?x=/en/1", "https://a.example.org/en/12#top", "http://example.org/en/2", "x://b.com/fr/", "x://b.com/de/?q", "x://b.com/de", "http://u:p@h.com:80/de/x://y/z", "a\nb://h.net/q\nr", "http://É.net/É/é", "http://n.net/" + "/".join("abcdefghij"), "http://n.net//a///b/", "http://n.net/" + "x" * 30_000]
    rows = list(enumerate(urls)) + [(None, "http://n.net/de/1"), (3, "http://n.net/de/1"), (3, "http://n.net/de/1")]
    rows += [(100 + i, f"http://m.com/{v}/{w}/{i}") for i, (v, w) in enumerate([("de", "shop"), ("fr", "news"), ("en", "shop")] * 12)]
    rows += [(300 + i, f"http://k.example.org/{v}/{i}") for i, v in enumerate(["es", "fr", "it"] * 10)]
    same(got(url_tree.judge(frame([(i, u, None, "h", "p", 1, "t") for i, u in rows], PAGES))), plain(rows))


def test_empty_table(frame):
    assert got(url_tree.judge(frame([], PAGES))) == []
