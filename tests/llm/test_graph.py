import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inodelake.llm.graph import components


def plain(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in list(root)}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=30))
def test_equals_union_find(spark, edges):
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == plain(edges)


def test_long_chain(spark):
    order = random.Random(0).sample(range(40), 40)
    edges = list(zip(order, order[1:], strict=False))
    assert set(dict(components(spark.createDataFrame(edges, "a long, b long")).collect()).values()) == {0}
