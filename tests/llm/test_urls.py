"""Parts and rules against plain loops, and held-out accuracy of the trees."""

import re

import numpy as np

from tideline.llm import urls

SCHEMA = "page_id long, url string, html string, host string, f_length long"
ODD = [None, "", "nothing", "http://", "://", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://aexample.com/en/", "x://a.net/es/1", "x://a.net/ES/1",
       "ftp://com/a", "http://com", "http://a.com?x=/en/", "http://b.example.com#/en/", "http://u@net:80/fr/", "a://b://c/d", "http://É.net/fr/é", "http://www.example.com/en/a"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


def rows(n=600):
    rng = np.random.default_rng(2)
    made = list(ODD)
    for i in range(n):
        top, lang = rng.choice(["com", "net", "org"]), rng.choice(["en", "de", "fr", "es"])
        made.append(f"http{'s' * int(rng.integers(2))}://{rng.choice(['www.', 'm.', ''])}{rng.choice(['ab', 'cd'])}.example.{top}/{lang}/{rng.integers(9999)}{rng.choice(['', '?a=1&b=2', '#t', '.html'])}")
    return [(i, u, "h", "clash", 3) for i, u in enumerate(made)] + [(None, None, None, None, None), (5, ODD[5], "h", "c", 1), (5, ODD[5], "h", "c", 1)]


def test_parts_rules_and_held_out_accuracy(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    labelled = urls.labelled_by_rules(docs)
    model = urls.fit(labelled, sample_rows=300, trees=8)
    got = urls.judge(docs, model).collect()
    assert len(got) == len(rows())
    by_id = {i: u for i, u, *_ in rows()}
    for r in got:
        host, path, rule, verdict = brute(by_id[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    no_rules = {r.page_id: r for r in urls.judge(docs, model, rules=()).collect()}
    known = [(i, brute(u)[3]) for i, u, *_ in rows() if i is not None and i >= len(ODD) and brute(u)[3]]
    assert np.mean([no_rules[i].verdict == v for i, v in known]) > 0.95


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(rows(30), SCHEMA)
    one_kind = spark.createDataFrame([("http://a.com/x", "allow"), (None, "allow"), ("b", None)], "url string, verdict string")
    for labelled in (one_kind.limit(0), one_kind):
        assert {r.verdict for r in urls.judge(docs, urls.fit(labelled)).where("rule IS NULL").collect()} == {"allow"}
    assert urls.judge(docs.limit(0), urls.fit(one_kind.limit(0))).count() == 0


def test_every_site_counts(spark):
    """Five thousand sites, each wholly allowed or blocked; nothing but the site tells which."""
    rng = np.random.default_rng(5)
    sites = [f"s{i}.org" for i in range(5000)]
    blocked = dict(zip(sites, rng.random(5000) < 0.5))
    labelled = [(f"http://{s}/{rng.integers(10**6)}", "block" if b else "allow") for s, b in blocked.items() for _ in range(5)]
    model = urls.fit(spark.createDataFrame(labelled, "url string, verdict string"), sample_rows=8000, trees=4)
    asked = [(i, f"http://{s}/{rng.integers(10**6)}") for i, s in enumerate(sites)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(asked, "page_id long, url string"), model, rules=()).collect()}
    assert len(got) == 5000 and np.mean([(got[i] == "block") == blocked[s] for i, s in enumerate(sites)]) > 0.99


def test_a_hot_site_and_rare_ones_have_their_shares(spark):
    rows = [("http://hot.com/a", "block")] * 3000 + [(f"http://r{i}.net/b", "allow") for i in range(3000)]
    model = urls.fit(spark.createDataFrame(rows, "url string, verdict string"), sample_rows=100, trees=1)
    asked = urls.with_parts(spark.createDataFrame([("http://hot.com/x",), ("http://r7.net/x",), ("http://new.org/x",)], "url string"))
    found = {r.host: r.f_s_site for r in urls._with_shares(asked, model).collect()}
    share = {"hot.com": (3000 + urls.PRIOR * 0.5) / (3000 + urls.PRIOR), "r7.net": urls.PRIOR * 0.5 / (1 + urls.PRIOR), "new.org": 0.5}
    assert {h: round(v, 9) for h, v in found.items()} == {h: round(v, 9) for h, v in share.items()}


def test_entropy_of_whole_urls(spark):
    long = "http://a.com/" + "a" * 1_200_000 + "bé" * 300_000
    some = ["http://x.org/abc", long, "", None]
    made = urls.with_features(urls.with_parts(spark.createDataFrame([(u,) for u in some], "url string")))
    for r in made.collect():
        text = r.url or ""
        want = -sum(text.count(c) / len(text) * np.log2(text.count(c) / len(text)) for c in set(text))
        assert abs(r.f_entropy - want) < 1e-9
