"""Packing: all three dimensions count, and classes of bins give exactly the bins of one piece at a time."""

from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tropelake.llm")
from test_texts import one_by_one
from tropelake.llm.pack import Bins, pack


def test_attention_cost_counts_where_it_cannot_be_exceeded(spark):
    df = spark.createDataFrame([(n, n) for n in (70, 45, 31, 20)], "doc INT, n INT")
    where = {r["doc"]: r["bin"] for r in pack(df, "doc", "n", capacity=100).collect()}
    assert where[45] == where[31] != where[70]  # 31 has no room beside 70
    assert where[20] == where[70]  # 45 and 31 leave less tokens, but far more of the attention cost


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity, weights", [((100, 7), (1.0, 0.5)), ((100, 64, 10_000), (1.0, 1.0, 1.0)), ((100, 7, 5000), (1.0, 1.0, 0.3))])
def test_classes_of_bins_are_exactly_single_bins(rule, capacity, weights):
    capacity, weights = np.array(capacity), np.array(weights)
    for seed in range(6):
        sizes = np.sort(np.random.default_rng(seed).integers(1, 60, 250))[::-1]
        items = np.stack([sizes, np.ones_like(sizes), sizes * sizes], axis=1)[:, : len(capacity)]
        bins, names = Bins(capacity, rule, weights), []
        for n in dict.fromkeys(sizes.tolist()):
            names += bins.put(items[sizes == n][0], int((sizes == n).sum())).tolist()
        left = np.tile(capacity, (max(names) + 1, 1))
        np.subtract.at(left, names, items)
        assert Counter(map(tuple, left.tolist())) == Counter(tuple(b.astype(int).tolist()) for b in one_by_one(capacity, list(items.astype(float)), rule, weights)), seed
