import random

import pytest

from folioflux.llm import components as C


def plain(edges):
    up = {}

    def top(k):
        up.setdefault(k, k)
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {k: top(k) for k in up}


@pytest.mark.parametrize("bound", [500_000, 0])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(C, "TASK_EDGES", bound)
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)] + [(None, 3), (5, None), (7, 8), (8, 7)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {r.node: r.component for r in C.components(df).collect()}
    want = {k: v for k, v in plain([e for e in edges if e[0] != e[1]]).items()}
    assert got == want
    assert C.components(df.limit(0)).count() == 0
