import pytest

from inspectra.llm.common import Scratch


@pytest.fixture()
def scratch(spark):
    return Scratch(spark, "test")


def union_find(edges, nodes):
    """Brute force: smallest node of each component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
