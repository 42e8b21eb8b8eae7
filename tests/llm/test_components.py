"""Connected components against a plain union of sets."""

import random

from tidewheel.llm.components import components


def union(links):
    root = {}

    def of(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = of(a), of(b)
        root[max(x, y)] = min(x, y)
    return {x: of(x) for x in root}


def test_chains_stars_loops_and_nulls(spark):
    rng = random.Random(5)
    chain = [(k + 1, k) for k in range(100, 130)]
    star = [(1, k) for k in range(1000, 1200)]
    some = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    links = chain + star + [(a, b) for a, b in some if a != b]
    df = spark.createDataFrame([*links, (7, 7), (None, 3), (3, None)], "a long, b long")
    got = [tuple(r) for r in components(df).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == union(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
