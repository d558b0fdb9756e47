import random

from geoloom.llm.components import connected_components

from .helpers import components


def test_against_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)] + [(5, 5)]
    rows = connected_components(spark.createDataFrame([*links, (None, 3)], "u long, v long")).collect()
    want = components({x for ab in links for x in ab}, links)
    assert {r["node"]: r["comp"] for r in rows} == {a: c for a, c in want.items() if a != c or any(c == x and y != x for y, x in want.items())}
    assert len(rows) == len({r["node"] for r in rows})


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
