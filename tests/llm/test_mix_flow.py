import random

import pytest

from geoloom.llm import mix_flow as op

from .helpers import DOCS, docs_df, prose


def sizes_of(rows):
    return {r["doc_id"]: r["size"] for r in rows}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        source = rng.choice(["big"] * 8 + ["mid", "mid", "mid", "tiny", None, "Ä", "z"])
        text = prose(rng, rng.randrange(1, 120)) if i % 50 else rng.choice(["", None, " \t\n"])
        rows.append((i, text, "en", source, 0))
    return spark.createDataFrame(rows, DOCS).cache()


def test_targets_and_taken(docs):
    rows = op.mixed_sizes(docs).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == 1200
    total = {}
    for r in rows:
        d = texts[r["doc_id"]]
        assert r["size"] == len((d["text"] or "").encode().split())
        total[d["source"]] = total.get(d["source"], 0) + r["size"]
    order = sorted(s for s in total if s is not None) + [None]
    want = op.fill(total, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(total.values()))
    assert order == ["big", "mid", "tiny", "z", "Ä", None]
    taken = dict.fromkeys(total, 0)
    largest = dict.fromkeys(total, 0)
    for r in rows:
        s = texts[r["doc_id"]]["source"]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in [k * r["size"] for k in range(4)]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in total:
        assert abs(taken[s] - min(want[s], 3 * total[s])) <= largest[s]
    assert sum(want.values()) == pytest.approx(sum(total.values()))


def test_reruns_agree_whatever_the_partitions(docs):
    one, two = (sorted(map(repr, op.mixed_sizes(d).collect())) for d in (docs, docs.repartition(7, "source")))
    assert one == two


def test_documents_as_often_as_taken(docs):
    clash = docs.withColumnRenamed("lang", "pattern").withColumnRenamed("n_chars", "total")
    uses = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in op.mixed_sizes(docs).collect()}
    out = op.mixed_documents(clash)
    assert out.columns == clash.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in uses.items() if n}


def test_fill():
    assert op.fill({"a": 10, "b": 10, "c": 80}, {"a": 5, "b": 2, "c": 1}, 100) == pytest.approx({"a": 30, "b": 30, "c": 40})
    assert op.fill({"a": 0, "b": 10}, {"a": 5, "b": 2}, 10) == pytest.approx({"a": 0, "b": 10})
    assert op.fill({}, {}, 0) == {}


def cost_of(patterns, given):
    total = 0
    for p, (m, _) in patterns.items():
        used = sum(x for (q, _), x in given.items() if q == p)
        total += sum(op.cost(k // m + 1) for k in range(used))
    return total


def best_cost(patterns, quotas, repeat):
    """Of all flows the most words, then the least cost, by trying every amount."""
    from itertools import product

    best = None
    arcs = [(p, s) for p, (_, own) in patterns.items() for s in own]
    for amounts in product(*(range(repeat * patterns[p][1][s] + 1) for p, s in arcs)):
        given = dict(zip(arcs, amounts))
        if all(sum(x for (_, s), x in given.items() if s == q) <= n for q, n in quotas.items()):
            found = (-sum(amounts), cost_of(patterns, given))
            best = min(best, found) if best else found
    return best


def test_flow_of_overlapping_sources_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(40):
        patterns = {"a": (rng.randrange(1, 3), {}), "ab": (1, {}), "bc": (rng.randrange(1, 3), {})}
        for p, (m, own) in patterns.items():
            own |= {s: m * rng.randrange(1, 3) if len(p) == 1 else m for s in p}
        quotas = {s: rng.randrange(0, 5) for s in "abc"}
        given = op.min_cost_flow(patterns, quotas, 2)
        assert all(0 <= x <= 2 * patterns[p][1][s] for (p, s), x in given.items())
        assert (-sum(given.values()), cost_of(patterns, given)) == best_cost(patterns, quotas, 2)


def test_patterns_of_the_query_reach_the_flow(spark):
    """Texts that two sources hold are used less than a source by itself would, and the words of each pattern are those of the cheapest flow."""
    rng = random.Random(9)
    rows, shared = [], [prose(rng, 10) for _ in range(300)]
    for i in range(900):
        rows.append((i, shared[i // 3] if i % 3 < 2 else prose(rng, 10), "en", ("b", "a", rng.choice("ab"))[i % 3], 0))
    rows += [(1000 + i, prose(rng, 10), "en", "c", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    slim = op.sized(docs, "doc_id", "text", "source")
    held, patterns = op.memberships(slim)
    assert {frozenset(own): m for m, own in patterns.values()}[frozenset("ab")] == 3000 and held.count() == 300
    got = {r["doc_id"]: r["taken"] for r in op.mixed_sizes(docs).collect()}
    uses = {k: [got[r[0]] // 10 for r in rows if (r[1] in set(shared)) == k and r[3] == "b"] for k in (True, False)}
    mean = {k: sum(v) / len(v) for k, v in uses.items()}
    assert mean[True] < mean[False] - 0.3  # by source alone all documents of b would be taken as often
    quotas = {s: round(t) for s, t in op.fill({s: sum(10 for r in rows if r[3] == s) for s in "abc"}, dict(a=5, b=2, c=1), 10000).items()}
    given = op.min_cost_flow(patterns, quotas)
    for (p, s), words in given.items():
        mine = sum(got[r[0]] for r in rows if r[3] == s and (r[1] in set(shared)) == (p[0] is not None))
        assert abs(mine - words) <= 30
    for s in "abc":
        assert abs(sum(got[r[0]] for r in rows if r[3] == s) - quotas[s]) <= 20


def test_patterns_beyond_the_bound_count_with_their_sources(spark):
    rng = random.Random(10)
    texts = [prose(rng, 7) for _ in range(60)]
    rows = [(6 * i + k, t, "en", s, 0) for i, t in enumerate(texts) for k, s in enumerate(rng.sample("abcdef", 3))]
    slim = op.sized(spark.createDataFrame(rows, DOCS), "doc_id", "text", "source")
    for most in (0, 3, 100):
        held, patterns = op.memberships(slim, most)
        assert len([p for p in patterns if p[0] is not None]) == min(most, len({frozenset(r[3] for r in rows if r[1] == t) for t in texts}))
        assert sum(n for _, own in patterns.values() for n in own.values()) == 7 * len(rows)


def test_all_patterns_are_planned_however_many(spark):
    """More than 20,000 sets of sources: each is a pattern of the flow with its own words, and the flow fills the quotas from them."""
    from itertools import combinations, islice

    names = [f"s{k:03}" for k in range(210)]
    pairs = list(islice(combinations(names, 2), 20_050))
    rows = [(2 * i + k, " ".join([f"w{i}"] * (1 + i % 3)), "en", s, 0) for i, pair in enumerate(pairs) for k, s in enumerate(pair)]
    slim = op.sized(spark.createDataFrame(rows, DOCS), "doc_id", "text", "source")
    held, patterns = op.memberships(slim)
    assert held.count() == len(pairs)
    assert {tuple(sorted(own)): (m, *own.values()) for m, own in patterns.values()} == {p: (1 + i % 3,) * 3 for i, p in enumerate(pairs)}
    sizes = dict.fromkeys(names, 0)
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    quotas = {s: round(t) for s, t in op.fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(sizes.values())).items()}
    given = op.min_cost_flow(patterns, quotas)
    taken = dict.fromkeys(names, 0)
    for (p, s), n in given.items():
        assert 0 <= n <= 3 * patterns[p][1][s]
        taken[s] += n
    assert taken == quotas


def test_ties_and_none(spark):
    same = docs_df(spark, ["a b c"] * 12, sources=("s", "t"))
    rows = op.mixed_sizes(same).collect()
    assert len(rows) == 12 and {r["target"] for r in rows} == {36 * 5 / 7, 36 * 2 / 7}
    twice = spark.createDataFrame([(1, "a b", "en", "s", 3)] * 4, DOCS)
    assert len({r["taken"] for r in op.mixed_sizes(twice).collect()}) == 1
    empty = docs_df(spark, [])
    assert op.mixed_sizes(empty).collect() == [] and op.mixed_documents(empty).collect() == []
    blank = docs_df(spark, ["", None])
    assert {(r["size"], r["taken"]) for r in op.mixed_sizes(blank).collect()} == {(0, 0)}
