"""Components against a plain union-find."""

import random

import pytest

from ledgerloom.llm import graph


@pytest.mark.parametrize("per_task", [250_000, 7])
def test_components_equal_union_find(spark, monkeypatch, per_task):
    """In one task, and in many whose forests must be tied by stars."""
    monkeypatch.setattr(graph, "PER_TASK", per_task)
    rng = random.Random(per_task)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300), (5, None)]
    edges += edges[:9]
    want = graph.forest([(a, b) for a, b in edges if b is not None])
    nodes = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(9)
    got = [tuple(r) for r in graph.components(frame).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: want.get(x, x) for x in nodes}
    for a, b in edges:
        if b is not None and a != b:
            assert dict(got)[a] == dict(got)[b] <= min(a, b)
    assert graph.components(frame.limit(0)).count() == 0
