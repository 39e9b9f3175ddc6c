import random

import pytest

from twinclock.llm import url_filter as U


def brute(host, path, rules):
    best = None
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        if ("." + host).endswith("." + name.lower()) and path.startswith(slash + rest):
            rank = (name.count("."), len(slash + rest), verdict == "block")
            if best is None or rank > best[0]:
                best = (rank, verdict, rule)
    return best and best[1:]


def test_trie_against_brute_force():
    r = random.Random(3)
    label, seg = ["a", "b", "net", "org", "x-y"], ["", "en", "e", "de", "den", "x"]
    for _ in range(300):
        rules = list({".".join(r.choice(label) for _ in range(r.randint(1, 3))) + r.choice(["", "/"]) + "/".join(r.choice(seg) for _ in range(r.randint(0, 3))): r.choice(["allow", "block"]) for _ in range(r.randint(0, 12))}.items())
        rules = [(v, k if "/" in k or k in label or "." in k else k) for k, v in rules if "/" in k or all(p in label for p in k.split("."))]
        trie = U.Trie(rules)
        for _ in range(30):
            host = ".".join(r.choice(label) for _ in range(r.randint(1, 4)))
            path = "".join("/" + r.choice(seg) for _ in range(r.randint(0, 4)))
            got = trie.match(host, path)
            assert (got and got[:2]) == brute(host, path, rules), (rules, host, path)


@pytest.mark.parametrize("url, want", [
    (None, ("", "")), ("", ("", "")), ("no scheme/x", ("", "")), ("http://", ("", "")), ("http://A.Net", ("a.net", "")), ("x://h?q/p", ("h", "")),
    ("x://h/p#f?q", ("h", "/p")), ("x://h/p?q#f", ("h", "/p")), ("x://h#f", ("h", "")), ("x://É.ORG:80/a/b", ("É.org:80", "/a/b")), ("a://b://c/d", ("b:", "//c/d"))])
def test_split(url, want):
    assert U.split_url(url) == want


def test_judge(spark, rows):
    urls = ["http://x.net/", "http://example.net/en/1", "http://www.example.net/en", "http://notexample.net/en/1", "http://example.com/de/x", "http://example.com/dex",
            "http://q.org/fr/1", "http://q.org/en/", None, "", "http://net", "http://NET/x", "http://evilnet/x", "http://x.net/" + "y" * 100_000]
    pages = spark.createDataFrame([(k, u, "best") for k, u in enumerate(urls)] + [(None, "http://x.net/", None)], "page_id bigint, url string, best string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(pages).collect()}
    block, allow = ("net/", "block"), (None, "allow")
    want = [block, ("example.net/en/", "allow"), block, block, ("example.com/de/", "block"), allow, ("org/fr/", "allow"), allow, allow, allow, allow, block, allow, block]
    assert [got[k] for k in range(len(urls))] == want and got[None] == block
    assert U.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in U.judge(pages, [], default="block").collect()} == {"block"}


def test_many_rules_in_blocks(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.example.net/en/{k}") for k in range(60)], "page_id bigint, url string")
    rules = U.RULES + [("allow", "h3.example.net/en/1"), ("block", "h4.example.net"), ("block", "h3.example.net/en/1")]
    want = sorted(map(tuple, U.judge(pages, rules).collect()))
    monkeypatch.setattr(U, "TRIE_RULES", 2)
    assert sorted(map(tuple, U.judge(pages, rules).collect())) == want
