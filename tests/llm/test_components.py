import random

import numpy as np
import pytest

from timelake.llm import components


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graphs():
    r = random.Random(2)
    path = [(i, i + 1) for i in range(300)]
    r.shuffle(path)
    star = [(5000, 5000 + i) for i in range(1, 200)]
    back = [(9000 + 3 * i, 9003 + 3 * i) for i in reversed(range(60))]
    some = [tuple(sorted(r.sample(range(20_000, 20_400), 2))) for _ in range(300)]
    return path + star + back + some + star[:5]


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_components_against_union_find(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    links = graphs()
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert {r.node: r.label for r in components.components(df).collect()} == brute(links)


def test_contraction_and_nothing(spark):
    links = graphs()
    node, low = components.smallest_of(*np.array(links).T)
    assert dict(zip(node.tolist(), low.tolist(), strict=True)) == brute(links)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
