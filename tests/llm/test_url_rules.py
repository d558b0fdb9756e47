import re

from geoloom.llm import url_rules as op

URLS = [
    "http://example.org/en/1", "https://WWW.Example.ORG/es/x", "http://example.org/en/2", "http://notexample.org/en/1", "http://a.com/fr/x", "http://a.com/de/x?q=1", "http://com/de/", "http://b.com/it/", "http://x.net/a#b", "http://x.net",
    "http://a.org", "http://a.org?x", "://org/", "a://b://c.org/x", "no scheme", "", None, "http:///x", "http://É.ORG/Ä\nb/", "http://a.com/de", "http://spam.biz/win/now?ref=1", "x" * 100_000, "http://" + "a" * 50_000 + ".com/fr/" + "b" * 50_000,
]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def fixed(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def tables(spark, urls, labels):
    pages = spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    return pages.withColumnRenamed("html", "toks"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_hosts_paths_and_fixed_rules(spark):
    got = {r["page_id"]: r for r in op.judge(*tables(spark, URLS, [])).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parts(u)
        rule, verdict = fixed(host, path)
        assert tuple(got[i])[1:] == (host, path, rule, verdict or "allow"), u


def test_mined_rules_decide_the_rest(spark):
    urls = [f"http://{'spam' if i % 3 == 0 else 'fine'}{i % 5}.{'biz' if i % 3 == 0 else 'net'}/p{i}/{'win' if i % 3 == 0 else 'news'}" for i in range(300)]
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(0, 200)] + [(1, None, None), (None, 1, 0), (0, 0, 1)]
    got = {r["page_id"]: r["verdict"] for r in op.judge(*tables(spark, urls, labels)).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(300)}


def test_mining_prunes(spark):
    rows = [("http://a.biz/x", True)] * 20 + [("http://b.net/y", False)] * 60 + [("http://c.biz/z", False)] * 3
    rules = op.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    assert all(c >= op.MIN_CONFIDENCE and s >= op.MIN_SUPPORT for _, _, c, s in rules)
    for i, (t, v, *_) in enumerate(rules):  # nothing that a shorter rule before it says too
        assert not any(set(x) < set(t) and w == v for x, w, *_ in rules[:i])
    assert (["suffix biz"], "block") in [r[:2] for r in rules] or any("suffix a.biz" in r[0] for r in rules)


def brute_rules(rows, least_share=op.MIN_SUPPORT):
    """All combinations of the tokens of each URL, counted one by one."""
    from itertools import combinations

    sets = []
    for url, bad in rows:
        host, path = parts(url)
        labels = host.split(".")
        toks = {f"suffix {'.'.join(labels[-k:])}" for k in (1, 2, 3)} | {f"host {x}" for x in labels} | {"path " + re.sub(r"\d+", "0", x) for x in path.split("/") if x} | {f"query {x}" for x in re.findall(r"[?&]([^=&#]+)", url)} | {"scheme " + url.split("://")[0][:16]}
        sets.append((frozenset(toks), bad))
    n = len(sets)
    count = {}
    for toks, bad in sets:
        for k in range(1, len(toks) + 1):
            for x in combinations(sorted(toks), k):
                own = count.setdefault(x, [0, 0])
                own[bad] += 1
    found = []
    for x, own in count.items():
        for bad, v in ((1, "block"), (0, "allow")):
            share = sum(b for _, b in sets) / n if bad else 1 - sum(b for _, b in sets) / n
            m = sum(own)
            c, z2 = own[bad] / m, op.SURE**2
            low = (c + z2 / (2 * m) - op.SURE * (c * (1 - c) / m + z2 / (4 * m * m)) ** 0.5) / (1 + z2 / m)
            if own[bad] >= max(least_share * n, min(op.LEAST_PAGES, n)) and c >= op.MIN_CONFIDENCE and c / share >= op.MIN_LIFT and low > share + 1e-9:
                found.append((x, v, c))
    return found


def test_mining_against_all_combinations(spark):
    import random

    rng = random.Random(8)
    rows = []
    for _ in range(160):
        host = rng.choice(["a.biz", "b.a.biz", "c.net", "d.net"])
        path = rng.choice(["win", "news", "p12", "p7"])
        rows.append((f"http://{host}/{path}?{rng.choice('xyz')}=1", rng.random() < (0.9 if host.endswith("biz") and path == "win" else 0.7 if path == "p12" else 0.1)))
    got = op.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    want = brute_rules(rows)
    assert len(want) > 20 and {v for _, v, _ in want} == {"block", "allow"}
    known = {(x, v): c for x, v, c in want}
    assert all(abs(known[tuple(t), v] - c) < 1e-9 for t, v, c, _ in got)  # no rule that is none
    for url, _ in rows:  # and the verdict on each URL is that of the best of all rules
        host, path = parts(url)
        labels = host.split(".")
        toks = {f"suffix {'.'.join(labels[-k:])}" for k in (1, 2, 3)} | {f"host {x}" for x in labels} | {"path " + re.sub(r"\d+", "0", x) for x in path.split("/") if x} | {f"query {x}" for x in re.findall(r"[?&]([^=&#]+)", url)} | {"scheme http"}
        every = [(c, v) for x, v, c in want if set(x) <= toks]
        mine = [(c, v) for t, v, c, _ in got if set(t) <= toks]
        assert (max(c for c, _ in every) if every else None) == (max(c for c, _ in mine) if mine else None)


def test_no_rule_is_lost_behind_redundant_ones(spark):
    # each of these hosts has many combinations of its tokens that say the same; the last rule is less confident than all of them
    rows = [(f"http://a{'bcdefgh'[i % 7]}.x{i % 7}.y{i % 7}.biz/p{'qrstuvw'[i % 7]}/s{'qrstuvw'[i % 7]}/t{'qrstuvw'[i % 7]}?k{i % 7}=1&l{i % 7}=2&m{i % 7}=3", True) for i in range(140)]
    rows += [("http://weak.net/deal", i % 10 != 0) for i in range(40)] + [("http://fine.net/news", False)] * 400
    rules = op.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    weak = [r for r in rules if r[0] == ["path deal"]]
    assert [r[1] for r in weak] == ["block"] and abs(weak[0][2] - 0.9) < 1e-9
    for t, v, c, _ in rules:
        assert not any(set(x) < set(t) and w == v and d >= c for x, w, d, _ in rules)


def test_tokens_anywhere_in_a_url(spark):
    urls = []
    for i in range(300):
        deep, query = "win" if i % 3 == 0 else "news", "&".join(f"q{k}=1" for k in range(5)) + f"&{'ref' if i % 3 == 1 else 'page'}=1"
        urls.append(f"http://h.a.net/s/t/u/v/{deep}?{query}")
    got = {r["page_id"]: r["verdict"] for r in op.judge(*tables(spark, urls, [(i, int(i % 3 == 2), 0) for i in range(200)])).collect()}
    assert got == {i: "allow" if i % 3 == 2 else "block" for i in range(300)}


def test_empty(spark):
    assert op.judge(*tables(spark, [], [])).collect() == []
    assert op.judge(*tables(spark, [], [(1, 1, 0)])).collect() == []
