import itertools
import random
import re
import time

from pyspark.sql import functions as F

from tallybook.llm import url_rules

URLS = [
    "https://www.example.com/en/1", "http://EXAMPLE.com/en/", "http://a.example.com/en", "http://x.example.com/en/9?q=/es/",
    "https://foo.net/es/1", "https://foo.net/fr/", "https://foo.net/de/", "https://net/es/x", "http://com", "http://a.com/", "http://acom/x",
    "nothing", "", None, "ftp://H.COM#frag/", "x://y?z=1://w/", "http://İ.com/é",
]


def brute_rule(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in url_rules.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, max(fits)[1:] if fits else None


def pages_of(spark, urls):
    rows = [(i, u, "x", "clash") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_fixed_rules(spark):
    found = url_rules.judge(pages_of(spark, URLS), labels_of(spark, [])).collect()
    assert len(found) == len(URLS)
    for r in found:
        host, path, fixed = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == (fixed or (None, "allow"))


def brute_mined(spark, urls, blocked, support, confidence, least=url_rules.MIN_BLOCKED):
    """URLs blocked by any token set with enough support and confidence, by listing all sets of up to three."""
    frame = pages_of(spark, urls).select("page_id", url_rules.tokens_of(F.col("url")).alias("t"))
    tokens = {r["page_id"]: frozenset(r["t"]) for r in frame.collect()}
    items = [tokens[i] for i in range(len(urls))]
    out = set()
    for size in (1, 2, 3):
        for combo in {c for t in items for c in itertools.combinations(sorted(t), size)}:
            has = [i for i, t in enumerate(items) if t.issuperset(combo)]
            bad = [i for i in has if blocked[i]]
            if len(bad) >= max(least, support * len(urls) - 1e-9) and len(has) < len(urls) and len(bad) >= confidence * len(has) - 1e-9:
                out.update(has)
    return out


def test_mined_rules_match_brute_force(spark):
    hosts = ["spam.org", "good.org", "mixed.org"]
    urls, blocked = [], []
    for i in range(60):
        host, word = hosts[i % 3], ("pills", "news", "win")[i // 3 % 3]
        urls.append(f"http://{host}/{word}")
        blocked.append(host == "spam.org" or (host == "mixed.org" and word == "pills"))
    pages = pages_of(spark, [*urls, urls[0], None])
    labels = labels_of(spark, [(i, 0 if b else 1, 0) for i, b in enumerate(blocked)] + [(3, None, 1), (10**6, 0, 0), (None, 0, 0)])
    found = url_rules.judge(pages, labels, min_support=0.05, min_confidence=0.9).collect()
    expected = brute_mined(spark, urls, blocked, 0.05, 0.9)
    assert {r["page_id"] for r in found if r["verdict"] == "block" and r["page_id"] < 60} == expected == {
        i for i, b in enumerate(blocked) if b
    }
    assert [r["verdict"] for r in sorted(found, key=lambda r: r["page_id"])][60:] == ["block", "allow"]


def test_needless_rules_are_pruned(spark):
    rows = [("http://bad.org/a", True)] * 5 + [("http://ok.org/a", False)] * 5
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, blocked boolean"), 0.1, 0.9).collect()
    assert rules and all(len(r["tokens"]) == 1 for r in rules)


def test_random_urls_match_brute_force(spark):
    rng = random.Random(8)
    urls = [f"http://{rng.choice('abc')}.org/{rng.choice('defg')}/{rng.choice('hij')}" for _ in range(80)]
    blocked = [("a.org" in u and "/d" in u) or "/j" in u or rng.random() < 0.1 for u in urls]
    frame = spark.createDataFrame(list(zip(urls, blocked, strict=True)), "url string, blocked boolean")
    for least, confidence in ((1, 0.9), (4, 0.6), (9, 0.8)):
        rules = url_rules.mine(frame, 0.01, confidence, least)
        hits = {r["url"] for r in url_rules.matching(frame, rules).collect()}
        want = brute_mined(spark, urls, blocked, 0.01, confidence, least)
        assert {i for i, u in enumerate(urls) if u in hits} == want


def test_shared_tokens_do_not_multiply(spark):
    """One site's URLs share 40 words: they are one item, and any of them tells the site."""
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    rows = [("http://shop.net/" + "/".join(words) + f"/{'abcd'[i % 4]}", i % 4 < 3) for i in range(400)]
    rows += [(f"http://other{i % 7}.org/x", False) for i in range(100)]
    start = time.time()
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, blocked boolean"), 0.01, 0.7)
    found = rules.collect()
    assert time.time() - start < 60
    (site,) = [r["tokens"] for r in found if any("host:shop" in part for part in r["tokens"])]
    assert len(site) == 1 and {f"path:{w}" for w in words} <= set(site[0])
    asked = spark.createDataFrame([(f"http://elsewhere.com/{words[5]}",), ("http://elsewhere.com/x",)], "url string")
    assert [r["url"] for r in url_rules.matching(asked, rules).collect()] == [f"http://elsewhere.com/{words[5]}"]


def test_a_single_blocked_row_makes_no_rule(spark):
    rows = [("http://once.org/a", True)] + [(f"http://ok.org/{c}", False) for c in "abcdefgh"]
    frame = spark.createDataFrame(rows, "url string, blocked boolean")
    assert url_rules.mine(frame).collect() == []
    assert url_rules.mine(frame, min_blocked=1).count() > 0


def test_empty_tables(spark):
    assert url_rules.judge(pages_of(spark, []), labels_of(spark, [])).collect() == []


def test_tokens(spark):
    row = pages_of(spark, ["HTTP://www.Spam-farm.org/en/12-ab/x.html?utm=3&q=a#f"]).select(url_rules.tokens_of(F.col("url"))).first()
    assert set(row[0]) == {
        "scheme:http", "host:www", "host:spam-farm", "host:spam", "host:farm", "host:org", "path:en", "path:0-ab",
        "path:0", "path:ab", "path:x.html", "path:x", "path:html", "key:utm", "key:q",
    }
