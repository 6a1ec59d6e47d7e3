"""Operators and queries do the whole job: no row is dropped, sampled or cut unasked."""

import numpy as np
import pytest

from tropelake.operators import aggregates, metrics, regression, sampling


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_clusters_outside_the_matrix_raise(spark):
    mets = df(spark, [("a", 0), ("a", 3), ("b", None)], "d STRING, c INT")
    with pytest.raises(Exception, match="cluster outside 0..2: 3"):
        aggregates.document_cluster_matrix(mets, mets, "d", "c", 3).collect()
    assert aggregates.document_cluster_matrix(mets, mets, "d", "c", 4).where("d = 'a'").first()["counts"] == [1, 0, 0, 1]


def test_vectors_hold_every_cluster(spark):
    mets = df(spark, [("a", 7), ("a", 7), ("a", 16_893), ("b", 2), ("c", None)], "d STRING, c INT")
    rows, clusters = aggregates.document_cluster_vectors(mets, mets, "d", "c")
    assert clusters == [2, 7, 16_893]
    assert {r["d"]: r["x"].toArray().tolist() for r in rows.collect()} == {"a": [0, 2, 1], "b": [1, 0, 0], "c": [0, 0, 0]}


def test_regression_sees_clusters_of_large_numbers(spark):
    mets = df(spark, [(f"d{i}", 9000 + i % 2, "right" if i % 2 else "left") for i in range(120)], "d STRING, c INT, side STRING")
    rows, clusters = aggregates.document_cluster_vectors(mets, mets, "d", "c")
    fit = regression.regression(rows.join(mets.select("d", "side"), "d"), "d", "side", folds=2, repeats=1, vector=("x", [f"Cluster {c}" for c in clusters]))
    w = {r["feature"]: r["weight"] for r in fit.weights.collect()}
    assert fit.metrics["test_accuracy"] == 1 and w["Cluster 9001"] > 0 > w["Cluster 9000"]


def test_regressions_of_the_queries_have_every_cluster(spark):
    from tropelake.plans import casestudy, models

    facts = df(spark, [("e1", 3, "left"), ("e2", 2_000, "right"), ("e2", 16_893, "right")], "episode STRING, cluster INT, polarity STRING")
    held, casestudy.pod = casestudy.pod, lambda spark, sf: facts
    try:
        rows, (column, names) = models._regression_input(spark, "")
    finally:
        casestudy.pod = held
    assert names == ["Cluster 3", "Cluster 2000", "Cluster 16893"]
    assert {r["episode"]: r[column].toArray().tolist() for r in rows.collect()} == {"e1": [1, 0, 0], "e2": [0, 1, 1]}


def exact_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    own = (label[:, None] == label).sum(axis=1) - 1
    a = np.where(label[:, None] == label, d, 0).sum(axis=1) / np.maximum(own, 1)
    b = np.min([np.where(label == k, np.inf, d[:, label == k].mean(axis=1)) for k in np.unique(label)], axis=0)
    return np.where(own > 0, (b - a) / np.maximum(a, b), 0).mean()


def test_silhouette_is_exact_in_blocks(spark):
    rng = np.random.default_rng(6)
    x, label = rng.standard_normal((90, 3)), rng.integers(0, 7, 90)
    x[:, 0] += label
    label[-1] = 99  # a lone member
    v = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(90)], "i INT, label INT, v ARRAY<DOUBLE>")
    assert metrics.silhouette(v, "i", "label", "v", block=16).first()[0] == pytest.approx(exact_silhouette(x, label))
    assert metrics.silhouette(v, "i", "label", "v", sample=20).first()[0] is not None
    assert metrics.silhouette(v.limit(0), "i", "label", "v").first()[0] is None


def test_silhouette_takes_no_sample_by_itself(spark):
    rng = np.random.default_rng(8)
    x, label = rng.standard_normal((5600, 2)), rng.integers(0, 3, 5600)
    x[:, 0] += label
    v = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(len(x))], "i INT, label INT, v ARRAY<DOUBLE>")
    a = np.zeros(len(x))
    for at in np.array_split(np.arange(len(x)), 8):
        d = np.sqrt(((x[at][:, None] - x) ** 2).sum(axis=2))
        mean = np.stack([d[:, label == k].sum(axis=1) / ((label == k).sum() - (label[at] == k)) for k in range(3)], axis=1)
        own = mean[np.arange(len(at)), label[at]]
        mean[np.arange(len(at)), label[at]] = np.inf
        other = mean.min(axis=1)
        a[at] = (other - own) / np.maximum(own, other)
    assert metrics.silhouette(v, "i", "label", "v").first()[0] == pytest.approx(a.mean(), abs=1e-9)


def test_jaccard_compares_every_dataset(spark, tmp_path):
    from tropelake.plans import text

    sentences = [("d", "d_0", "red house big wall stone", "podcasts"), ("d", "d_1", "stone red house big wall fire", "podcasts"), ("d", "d_2", "big wall red stone house", "x"), ("d", "d_3", "sea", "x"), ("e", "e_0", "red house big wall stone", "tweets_immigration"), ("e", "e_1", "the", "x")]
    df(spark, sentences, "doc_id STRING, id STRING, sentence STRING, dataset STRING").write.parquet(f"{tmp_path}/llm_met_scores.parquet")
    assert [tuple(r) for r in text.jaccard_pairs(spark, str(tmp_path)).collect()] == [("d_0", "d_1", 2, 1, pytest.approx(5 / 6))]


def test_similar_sets_lose_no_pair(spark):
    import random

    from tropelake.operators import intrusion

    rng = random.Random(4)
    sets = list({(g, tuple(sorted(rng.sample("abcdefgh", rng.randrange(0, 8))))) for g in "xyz" for _ in range(60)})
    rows = df(spark, [(g, i, list(w)) for i, (g, w) in enumerate(sets)], "g STRING, i INT, w ARRAY<STRING>")
    for least in (0.5, 0.8, 1.0):
        want = {(i, j) for i, (g, a) in enumerate(sets) for j, (h, b) in enumerate(sets) if i < j and g == h and a and b and len({*a} & {*b}) >= least * len({*a} | {*b})}
        assert {(r["id_a"], r["id_b"]) for r in intrusion.similar_sets(rows, "g", "i", "w", least).collect()} == want


def test_overlaps_come_from_all_events(spark, tmp_path):
    from tropelake.plans import relational as plans

    events = df(spark, [("u", t, us) for t, us in (("click", 7), ("click", 13), ("view", 12), ("view", 20))], "user_id STRING, event_type STRING, us LONG")
    events.selectExpr("user_id", "event_type", "CAST(timestamp_micros(us) AS TIMESTAMP_NTZ) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in plans.interval_overlap(spark, str(tmp_path)).collect()] == [("u", "click", "view")]


def test_every_shuffled_row_has_a_place(spark):
    rows = df(spark, [(f"s{i % 9}", i) for i in range(700)], "source STRING, doc_id INT")
    got = sampling.shuffled_places(rows, "source", ["doc_id"]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 701))
    assert [(r["source"], r["doc_id"]) for r in got] == [tuple(r) for r in sampling.shuffled_documents(rows, "source", ["doc_id"]).collect()]
