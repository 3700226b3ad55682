"""Clustering of components of any size."""

import random

import numpy as np

from kgspark.llm import names


def test_sparse_linkage_equals_the_matrix():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(1, 25)
        sim = {(i, j): rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3}
        m = np.zeros((n, n))
        for (i, j), v in sim.items():
            m[i, j] = m[j, i] = v
        assert names.sparse_linkage(n, sim, 0.3) == names.average_linkage(m, 0.3)


def test_large_component():
    """5,000 spellings of one name in one component end in one cluster; a chain does not."""
    n = 5000
    edges = [(i, j, 0.9, 0) for i in range(n) for j in range(i + 1, min(n, i + 8))]
    hub = [(0, j, 0.9, 0) for j in range(8, n)]
    got = names._group(dict.fromkeys(range(n), 1), edges + hub)
    assert len(got) == n
    chain = names._group(dict.fromkeys(range(n), 1), [(i, i + 1, 0.9, 0) for i in range(n - 1)])
    assert len(set(chain.values())) > n / 20


def test_short_form_goes_with_the_one_mentioned_more():
    nodes = {1: 1, 2: 10, 3: 4}
    got = names._group(nodes, [(1, 2, 0.9, 1), (1, 3, 0.9, 1)])
    assert got[1] == got[2] != got[3]
    nodes[3] = 8
    assert len(set(names._group(nodes, [(1, 2, 0.9, 1), (1, 3, 0.9, 1)]).values())) == 3
