import random

from loomindex.llm.components import components


def plain(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def test_components_equal_a_plain_search(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    links += [(i, i + 1) for i in range(1000, 1040)]  # a chain
    links += [(5000, i) for i in range(5001, 5200)]  # a hub
    df = spark.createDataFrame([*links, (7, 7), (None, 3), (9000, 9000), links[0]], "x bigint, y bigint")
    got = {r.id: r.component for r in components(df).collect()}
    assert got == {k: v for k, v in plain([p for p in links if p[0] != p[1]]).items()}
    assert components(df.limit(0)).count() == 0
