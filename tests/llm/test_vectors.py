"""Clusters and nearest vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tropelake.llm")
from tropelake.llm.birch import Tree, cluster_members, cluster_report, label_of, ward
from tropelake.llm.similar import Cells, chi_square_quantile, kd_order, most_similar, most_similar_to

D = 64
SCHEMA = "idx INT, emb ARRAY<FLOAT>, f STRING, g STRING, id STRING, cluster STRING, similarity STRING"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def clustered(rng, sizes, spread=0.09):
    centres = unit(rng.standard_normal((len(sizes), D)))
    return np.vstack([unit(c + spread * rng.standard_normal((n, D))) for c, n in zip(centres, sizes)]), np.repeat(np.arange(len(sizes)), sizes)


def frame(spark, vectors, feats, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], f, g, "a", "b", "c") for i, v, (f, g) in zip(ids, vectors, feats)], SCHEMA)


def found(df, **more):
    rows = cluster_members(df, "idx", "emb", [label_of(F.col("f")), label_of(F.col("g"))], D, **more).collect()
    out = {}
    for r in rows:
        out.setdefault(r["first"], set()).add(r["idx"])
    assert all(first == min(ids) and {r["size"] for r in rows if r["first"] == first} == {len(ids)} for first, ids in out.items())
    return sorted(map(sorted, out.values()))


def test_planted_clusters_come_out(spark):
    rng = np.random.default_rng(1)
    x, label = clustered(rng, [60, 25, 12, 10])
    noise = unit(rng.standard_normal((20, D)))
    order = rng.permutation(len(x) + len(noise))
    both = np.vstack([x, noise])[order] * rng.uniform(0.1, 9, (len(order), 1))
    where = np.argsort(order)
    got = found(frame(spark, both, [("Person: of some kind", "a")] * len(both)))
    assert got == sorted(sorted(where[: len(x)][label == k].tolist()) for k in range(4))


def test_features_part_clusters_and_nulls_join(spark):
    rng = np.random.default_rng(2)
    x, _ = clustered(rng, [36])
    feats = [(" Place ", "a") if i % 3 == 0 else ("thing: x", "a") if i % 3 == 1 else (None, None) for i in range(36)]
    feats = [f if f[0] or i < 12 else ("place", None) for i, f in enumerate(feats)]
    got = found(frame(spark, x, feats))
    places = {i for i, f in enumerate(feats) if f[0] and f[0].strip().lower() == "place"}
    things = {i for i, f in enumerate(feats) if f[0] and f[0].startswith("thing")}
    assert len(got) == 2 and any(places <= set(c) and not things & set(c) for c in got) and any(things <= set(c) for c in got)


def test_unusable_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    x, _ = clustered(rng, [10, 9])
    bad = [None, [], [1.0] * (D - 1), [0.0] * D, [float("nan")] * D, [float("inf")] + [1.0] * (D - 1)]
    vectors = [*x, *bad, *x[10:13]]
    ids = [*range(19), *range(100, 106), 10, 11, 12]
    got = found(frame(spark, vectors, [("p", "q")] * len(vectors), ids))
    assert got == [list(range(10))]  # nine distinct records are no cluster, however often they come
    assert found(frame(spark, [], [])) == []


def test_report_lists_typical_members(spark):
    rng = np.random.default_rng(4)
    x, _ = clustered(rng, [30])
    members = cluster_members(frame(spark, x, [("p", None)] * 30), "idx", "emb", [F.col("f")], D)
    (r,) = cluster_report(members, "idx", 3).collect()
    near = np.argsort(-(x @ unit(x.mean(axis=0))))[:3].tolist()
    assert (r["first"], r["size"], r["typical"]) == (0, 30, near)


def test_trees_merge_and_bound_their_size():
    rng = np.random.default_rng(5)
    x, _ = clustered(rng, [200, 200, 50])
    whole, part = Tree(D, 0.6), [Tree(D, 0.6) for _ in range(3)]
    for k, p in enumerate(part):
        p.add(np.ones(len(x[k::3])), x[k::3])
        whole.add(*p.entries())
    weight, sums = whole.entries()
    assert weight.sum() == len(x) and np.allclose(sums.sum(axis=0), x.sum(axis=0))
    assert len(np.unique(ward(weight, sums, 0.65))) == 3
    lone = Tree(D, 0.9)
    lone.add(np.ones(500), unit(rng.standard_normal((500, D))))
    assert lone.least == 0.9 and lone.size == len(lone.entries()[0]) == 500


def apart(rng, cosine, sizes, low=0.72, high=0.86):
    """Clusters around centres of the same mutual cosine; each member at a cosine from low to high to its centre."""
    base = np.linalg.qr(rng.standard_normal((D, len(sizes) + 1)))[0].T
    centres = unit(np.sqrt(cosine) * base[:1] + np.sqrt(1 - cosine) * base[1:])
    out = []
    for c, n in zip(centres, sizes):
        side = rng.standard_normal((n, D))
        side = unit(side - (side @ c)[:, None] * c)
        side = unit(side - side.mean(axis=0)) if n > 9 else side
        cos = rng.uniform(low, high, (n, 1))
        out.append(cos * c + np.sqrt(1 - cos**2) * side)
    return np.vstack(out), np.repeat(np.arange(len(sizes)), sizes)


@pytest.mark.parametrize("more", [{}, {"max_entries": 60}, {"max_entries": 60, "cell_entries": 128}])
def test_many_lone_rows_keep_near_clusters_apart(spark, more):
    """Trees far under the number of lone rows, and cells, change nothing."""
    rng = np.random.default_rng(9)
    x, label = apart(rng, 0.55, [40, 24, 14, 12])
    lone = unit(rng.standard_normal((6000, D)))
    lone = lone[(lone @ unit(np.array([x[label == k].mean(axis=0) for k in range(4)])).T).max(axis=1) < 0.5][:1200]
    order = rng.permutation(len(x) + len(lone))
    where = np.argsort(order)
    got = found(frame(spark, np.vstack([x, lone])[order], [("p", None)] * len(order)), **more)
    assert got == sorted(sorted(where[: len(x)][label == k].tolist()) for k in range(4))


def test_thresholds_follow_from_the_parameters(spark):
    """Four records, one for each pattern of nulls, are a cluster of four."""
    rng = np.random.default_rng(10)
    x, _ = clustered(rng, [4])
    feats = [("p", "q"), ("p", None), (None, "q"), (None, None)]
    assert found(frame(spark, x, feats), min_members=4) == [[0, 1, 2, 3]] and found(frame(spark, x, feats), min_members=5) == []


def test_ward_joins_cheapest_first():
    sums = np.array([[1, 0.0], [0.99, 0.1], [0, 1.0], [0.1, 0.99]])
    label = ward(np.ones(4), sums, 0.5)
    assert label[0] == label[1] != label[2] == label[3]
    assert ward(np.ones(1), sums[:1], 0.5).tolist() == [0]


def brute(x, ids, k, least):
    sims = unit(x.astype(float)) @ unit(x.astype(float)).T
    out = {}
    for i in range(len(x)):
        best = sorted((-round(sims[i, j], 9), ids[j]) for j in range(len(x)) if j != i and sims[i, j] >= least)[:k]
        out[ids[i]] = [(j, -s) for s, j in best]
    return {i: v for i, v in out.items() if v}


def listed(df, **more):
    out = {}
    for r in most_similar(df, "idx", "emb", D, **more).orderBy("idx", "rank").collect():
        out.setdefault(r["idx"], []).append((r["other"], r["similarity"]))
    return out


@pytest.mark.parametrize("cell_rows", [40, 10_000])
def test_neighbours_match_brute_force(spark, cell_rows):
    rng = np.random.default_rng(6)
    base = unit(rng.standard_normal((150, D)))
    x = np.vstack([base, unit(base[:60] + 0.04 * rng.standard_normal((60, D))), unit(base[:9] + 0.02 * rng.standard_normal((9, D))), base[:30] * 3, np.repeat(base[:1], 12, axis=0)]).astype(np.float32)
    ids = rng.permutation(1000)[: len(x)].tolist()
    got, want = listed(frame(spark, x, [("", "")] * len(x), ids), min_similarity=0.9, cell_rows=cell_rows), brute(x, ids, 5, 0.9)
    pairs = lambda d: {(i, j) for i, v in d.items() for j, _ in v}
    assert len(pairs(got) & pairs(want)) >= 0.97 * len(pairs(want))
    assert all(abs(s - dict(want[i])[j]) < 1e-8 for i, v in got.items() for j, s in v if j in dict(want.get(i, [])))
    hot = [i for i, row in zip(ids, x) if np.array_equal(row, x[0])]
    for i in hot:
        assert got[i] == want[i]


def test_copies_unusable_rows_and_empty_tables(spark):
    x = [[1.0] * D] * 8 + [None, [], [0.0] * D, [float("nan")] * D]
    ids = [5, 5, 3, 9, 7, 1, 2, 8, 20, 21, 22, 23]
    got = listed(frame(spark, x, [("", "")] * len(x), ids))
    assert set(got) == {1, 2, 3, 5, 7, 8, 9} and [j for j, _ in got[9]] == [1, 2, 3, 5, 7] and [j for j, _ in got[1]] == [2, 3, 5, 7, 8]
    assert listed(frame(spark, [], [])) == {}
    assert listed(frame(spark, [[1.0] * D], [("", "")])) == {}


@pytest.mark.parametrize("cell_rows", [60, 10_000])
def test_neighbours_without_a_least_similarity(spark, cell_rows):
    rng = np.random.default_rng(8)
    x, _ = clustered(rng, [200, 100, 60])
    x = np.vstack([x, unit(rng.standard_normal((40, D))), np.repeat(x[:1], 9, axis=0), x[5:15] * 7]).astype(np.float32)
    ids = rng.permutation(2000)[: len(x)].tolist()
    df = frame(spark, [*x, None, [0.0] * D], [("", "")] * (len(x) + 2), [*ids, 5000, 5001])
    got = {}
    for r in most_similar_to(df, "idx", "emb", D, lambda i: i % 5 == 0, cell_rows=cell_rows).orderBy("idx", "rank").collect():
        got.setdefault(r["idx"], []).append((r["other"], r["similarity"]))
    want = {i: v for i, v in brute(x, ids, 5, -2).items() if i % 5 == 0}
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits >= 0.93 * 5 * len(want)
    for i in want:
        if np.array_equal(x[ids.index(i)], x[0]):
            assert got[i] == want[i]
    few = frame(spark, np.eye(3, D), [("", "")] * 3, [5, 6, 7])
    assert [(r["other"], r["similarity"]) for r in most_similar_to(few, "idx", "emb", D, lambda i: i == 5).collect()] == [(6, 0.0), (7, 0.0)]
    assert most_similar_to(frame(spark, [], []), "idx", "emb", D, lambda i: i == 5).count() == 0


def test_chi_square_quantiles():
    assert abs(chi_square_quantile(0.99, 8) - 20.090) < 1e-3 and abs(chi_square_quantile(0.95, 2) - 5.991) < 1e-3


def test_cells_and_trees_hold_every_row_once():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 4))
    row, cell, own = Cells(x[:500], 4).visits(x, np.full(3000, 0.3), 0.004)
    assert sorted(row[own].tolist()) == list(range(3000)) and cell.max() < 16
    assert len(set(zip(row.tolist(), cell.tolist()))) == len(row)
    order, starts = kd_order(x)
    assert sorted(order.tolist()) == list(range(3000)) and starts[0] == 0 and (np.diff(starts) > 0).all()
    same, _ = kd_order(np.zeros((500, 4)))
    assert same.tolist() == list(range(500))  # equal rows keep their order
    assert len(kd_order(x[:0])[1]) == 0
