"""Operators on small tables: hand-computed answers and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tropelake.operators import aggregates, annotate, clustering, constraints, features, intrusion, metrics, nlp, ranking, regression, relational, sampling


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


POINTS = [(i, c, g) for i, (c, g) in enumerate(zip([0, 0, 0, 1, 1, 1], "aabbba"))]


@pytest.fixture
def points(spark):
    return df(spark, [*POINTS, (6, 1, None)], "i INT, c INT, g STRING")


def test_constraints(points):
    assert constraints.cannot_link_count(points, ["g"]).first()[0] == 9
    by = {r["c"]: r["violations"] for r in constraints.violations_by_cluster(points, "c", ["g"]).collect()}
    assert by == {0: 2, 1: 2} and constraints.violation_count(points, "c", ["g"]).first()[0] == 4
    assert relational.different_pairs(points, "i", ["c"], ["g"]).count() == 4 and relational.different_pairs(points, "i", [], ["g"]).count() == 9


def test_purity(spark, points):
    six = points.where("g IS NOT NULL")
    assert metrics.exact_purity(six, "c", ["g"]).first()[0] == pytest.approx(4 / 6)
    assert metrics.exact_purity(six, "i", ["g"]).first()[0] == 1.0
    assert metrics.feature_purity(points, "c", ["g"]).first()[0] == pytest.approx(4 / 7)


def test_top_share_rounding(spark):
    rows = df(spark, [(0, i) for i in range(6)] + [(1, i) for i in range(3)], "c INT, i INT")
    n = lambda **o: {r["c"]: r["count"] for r in ranking.top_share(rows, "c", ["i"], 25, **o).groupBy("c").count().collect()}
    assert n() == {0: 1, 1: 1} and n(rounding="ceil") == {0: 2, 1: 1} and n(at_least_one=False) == {0: 1}


RATED = [(1, 1), (1, 1), (0, 0), (0, 1)]


def test_agreement(spark):
    r = df(spark, [*RATED, (None, 1)], "a INT, b INT")
    assert metrics.krippendorff_alpha(r, "a", "b").first()[0] == pytest.approx(0.5333, abs=1e-4)
    assert metrics.gwet_ac1(r, "a", "b").first()[0] == pytest.approx(0.5294, abs=1e-4)
    assert metrics.percent_agreement(r, "a", "b").first()[0] == 0.75
    assert metrics.krippendorff_alpha(r, "a", "a").first()[0] == 1.0
    same = df(spark, [(1, 1)] * 3, "a INT, b INT")
    assert metrics.gwet_ac1(same, "a", "b").first()[0] is None and metrics.krippendorff_alpha(same, "a", "b").first()[0] is None


def test_classification(spark):
    r = df(spark, [("x", "x"), ("x", "y"), ("y", "y"), ("z", "y")], "t STRING, p STRING")
    rows = {x["class"]: x for x in metrics.class_report(r, "t", "p").collect()}
    assert rows["y"]["precision"] == pytest.approx(1 / 3) and rows["y"]["recall"] == 1 and rows["z"]["f1"] == 0
    assert rows["accuracy"]["f1"] == 0.5 and rows["macro avg"]["recall"] == pytest.approx(0.5)
    b = df(spark, [(0.1, True), (0.6, True), (0.8, True), (0.2, False), (None, True)], "s DOUBLE, p BOOLEAN")
    t = {x["threshold"]: x for x in metrics.threshold_report(b, "s", "p", [0.5, 0.9]).collect()}
    assert (t[0.5]["tp"], t[0.5]["fp"], t[0.5]["tn"], t[0.5]["fn"], t[0.5]["precision"]) == (2, 1, 1, 0, 66.67) and t[0.9]["recall"] == 0
    auc = df(spark, [(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "s DOUBLE, y BOOLEAN")
    assert metrics.roc_auc(auc, "s", "y").first()[0] == pytest.approx(3.5 / 4)
    assert metrics.roc_auc(auc.where("y"), "s", "y").first()[0] is None
    assert metrics.binary_report(auc.withColumn("p", F.col("s") > 0.3), "y", "p").first()["f1"] == pytest.approx(0.8)


def test_judgements(spark):
    r = df(spark, [("true", 1), (" UNSURE", 0), ("4", 4), (None, None), ("Not Metaphorical", 0)], "x STRING, want INT")
    assert all(a == b for a, b in r.select(metrics.normalize_judgement(F.col("x")), "want").collect())
    with pytest.raises(Exception):
        df(spark, [("maybe",)], "x STRING").select(metrics.normalize_judgement(F.col("x"))).collect()


def test_sums_of_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 3))
    v = df(spark, [(i, i % 4, x[i].tolist()) for i in range(40)], "i INT, label INT, v ARRAY<DOUBLE>")
    w, b = metrics.within_ss(v, "label", "v").first()[0], metrics.between_ss(v, "label", "v").first()[0]
    assert w + b == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    line = df(spark, [(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [5.0]), (3, 1, [7.0])], "i INT, label INT, v ARRAY<DOUBLE>")
    assert metrics.silhouette(line, "i", "label", "v").first()[0] == pytest.approx(0.7203, abs=1e-3)
    assert metrics.silhouette(line.withColumn("label", F.lit(1)), "i", "label", "v").first()[0] == 0


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    centers = np.array([[0, 0], [10, 0], [0, 10]])
    rows = [(i, (centers[i % 3] + rng.standard_normal(2)).tolist(), "ab"[i % 2] if i % 5 else None) for i in range(60)]
    return df(spark, rows, "i INT, v ARRAY<DOUBLE>, g STRING").persist()


def test_kmeans_finds_separate_clouds(spark, cloud):
    labelled, centers, cost = clustering.kmeans(cloud, "v", 3, restarts=2)
    assert labelled.groupBy("label").count().where("count = 20").count() == 3 and cost < 300
    own, moved = clustering.lloyd(cloud, "i", "v", np.array([[1.0, 1], [9, 1], [1, 9]]))
    assert np.allclose(sorted(map(tuple, moved.round(6))), sorted(map(tuple, centers.round(6))), atol=1e-5) and own.count() == 60
    assert clustering.best_k(cloud, "i", "v", range(2, 5), 1)[0] == 3


def naive_labels(x, groups, centers, w, percent=None, gate=None):
    near = ((x[:, None] - centers) ** 2).sum(axis=2)
    ok = near.min(axis=1) <= (np.inf if percent is None else np.percentile(near.min(axis=1), percent))
    label = []
    for i in range(len(x)):
        cost = near[i].copy()
        for j in range(i):
            apart = groups[i] is not None and groups[j] is not None and groups[i] != groups[j]
            if apart and ok[i] and ok[j] and (gate is None or np.linalg.norm(x[i] - x[j]) <= gate):
                cost[label[j]] += w
        label.append(int(cost.argmin()))
    return label, ok


@pytest.mark.parametrize("w, percent, gate", [(0.0, None, None), (0.7, None, None), (5.0, None, None), (5.0, 40, None), (2.0, None, 1.5), (2.0, 60, 1.5)])
def test_constrained_labels_match_pair_enumeration(spark, cloud, w, percent, gate):
    rows = cloud.orderBy("i").collect()
    x, groups = np.array([r["v"] for r in rows]), [r["g"] for r in rows]
    centers = x[[0, 1, 2]]
    limit = None if percent is None else float(np.percentile(((x[:, None] - centers) ** 2).sum(axis=2).min(axis=1), percent))
    got = [r["label"] for r in clustering.constrained_labels(cloud, "i", "v", "g", centers, w, limit, gate).orderBy("i").collect()]
    assert got == naive_labels(x, groups, centers, w, percent, gate)[0]
    if percent:
        assert constraints.thresholds(clustering.nearest_center(cloud, "i", "v", centers), "d2", percent).first()[0] == pytest.approx(limit)


def naive_rounds(x, groups, centers, w, percent, rounds, parallel):
    """Round by round over all pairs: inertia and violations."""
    out = []
    near = lambda c: ((x[:, None] - c) ** 2).sum(axis=2)
    eligible = lambda c: near(c).min(axis=1) <= np.percentile(near(c).min(axis=1), percent)
    last, last_ok = near(centers).argmin(axis=1), eligible(centers)
    for _ in range(rounds):
        d, ok = near(centers), eligible(centers)
        if parallel:
            label = d.argmin(axis=1)
            for i in range(len(x)):
                if groups[i] is not None and ok[i]:
                    cost = d[i].copy()
                    for j in range(len(x)):
                        if last_ok[j] and groups[j] is not None and groups[j] != groups[i]:
                            cost[last[j]] += w
                    label[i] = cost.argmin()
            last, last_ok = label, ok
        else:
            label = np.array(naive_labels(x, groups, centers, w, percent)[0])
        pairs = [(i, j) for i in range(len(x)) for j in range(i) if ok[i] and ok[j] and groups[i] and groups[j] and groups[i] != groups[j] and label[i] == label[j]]
        out.append((d[np.arange(len(x)), label].sum(), len(pairs)))
        centers = np.array([x[label == k].mean(axis=0) if (label == k).any() else c for k, c in enumerate(centers)])
    return out


@pytest.mark.parametrize("parallel", [False, True])
def test_pckmeans_matches_its_twin(spark, cloud, monkeypatch, parallel):
    rows = cloud.orderBy("i").collect()
    x, groups = np.array([r["v"] for r in rows]), [r["g"] for r in rows]
    monkeypatch.setattr(clustering, "spread_centers", lambda *a: x[[0, 1, 2]].copy())
    for percent in (10, 70):
        labels, _, history = clustering.pckmeans(cloud, "i", "v", "g", 3, w_cl=0.8, start="spread", centroid_percentile=percent, max_iter=3, tol=0, parallel=parallel)
        got = [(r["inertia"], r["violations"]) for r in history.orderBy("iteration").collect()]
        want = naive_rounds(x, groups, x[[0, 1, 2]], 0.8, percent, len(got), parallel)
        assert [v for _, v in got] == [v for _, v in want] and np.allclose([i for i, _ in got], [i for i, _ in want])
        assert labels.count() == 60
    with pytest.raises(ValueError):
        clustering.pckmeans(cloud, "i", "v", "g", 3, start="spread", pairwise_percentile=10, parallel=True)


def test_pckmeans_history_and_start(spark, cloud):
    labels, centers, history = clustering.pckmeans(cloud, "i", "v", "g", 3, w_cl=0.1, max_iter=4, pairwise_percentile=30)
    h = history.orderBy("iteration").collect()
    assert labels.count() == 60 and len(centers) == 3 and all(r["total_cost"] == pytest.approx(r["inertia"] + 0.1 * r["violations"]) for r in h)
    spread = clustering.spread_centers(cloud, "i", "v", "g", 5, 1.0)
    assert len({tuple(c) for c in spread}) == 5
    assert clustering.spread_centers(cloud.limit(2), "i", "v", None, 5, 0.0).shape == (2, 2)


def test_violation_statistics(spark):
    history = df(spark, [(0, 1, 2), (0, 1, 3), (1, 1, 2), (2, 1, 2), (2, 4, 5)], "iteration INT, i INT, j INT")
    assert {(r["i"], r["j"]): r["frequency"] for r in constraints.violation_frequency(history).collect()} == {(1, 2): 1.0, (1, 3): pytest.approx(1 / 3), (4, 5): pytest.approx(1 / 3)}
    assert [(r["i"], r["j"]) for r in constraints.most_violated(history, 2).collect()] == [(1, 2), (1, 3)]
    trend = lambda *v: constraints.violation_trend(df(spark, list(enumerate(v)), "iteration INT, violations LONG")).first()[0]
    assert [trend(*v) for v in ((5, 4, 4), (1, 2, 2), (5, 1, 3), (1, 5, 3), (5, 4), (2, 2, 2))] == ["consistently decreasing", "consistently increasing", "decreasing", "increasing", "decreasing", "consistently increasing"]


def test_percentiles_interpolate(spark):
    rng = np.random.default_rng(5)
    data = {"a": rng.integers(0, 9, 50).astype(float), "b": rng.standard_normal(31), "c": np.array([4.0])}
    table = df(spark, [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("d", None)], "g STRING, v DOUBLE")
    got = {r["g"]: r for r in ranking.percentiles(table, ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == set(data)
    for g, v in data.items():
        assert np.allclose([got[g]["low"], got[g]["mid"], got[g]["top"]], np.percentile(v, [10, 50, 100]))


def test_sparse_weights_and_word_clusters(spark):
    docs = df(spark, [("p", ["red", "wall"]), ("q", ["red", "red", "sea"]), ("r", [])], "id STRING, w ARRAY<STRING>")
    got = {(r["id"], r["word"]): r["weight"] for r in clustering.tfidf(docs, "id", "w").collect()}
    red, rare = np.log(4 / 3) + 1, np.log(4 / 2) + 1
    assert got["p", "wall"] == pytest.approx(rare / np.hypot(red, rare)) and got["q", "red"] == pytest.approx(2 * red / np.hypot(2 * red, rare))
    words = df(spark, [("Big wall",), (" big wall ",), ("high wall",), ("open sea",), ("the open sea",), (None,)], "w STRING")
    clusters = {}
    for r in clustering.word_clusters(words, "w", 2).collect():
        clusters.setdefault(r["label"], set()).add(r["word"])
    assert sorted(map(sorted, clusters.values())) == [["big wall", "high wall"], ["open sea", "the open sea"]]
    assert clustering.elbow(df(spark, [([0.0],), ([2.0],), ([4.0],)], "v ARRAY<DOUBLE>"), "v", range(1, 3)).where("k = 1").first()["inertia"] == pytest.approx(8)


def test_components_are_removed(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 5)) + 5 * rng.standard_normal((80, 1)) * np.array([1, 0, 0, 0, 0])
    got = clustering.without_top_components(df(spark, [(i, r.tolist()) for i, r in enumerate(x)], "i INT, v ARRAY<DOUBLE>"), "i", "v", 2)
    y = np.array([r["vector"] for r in got.orderBy("i").collect()])
    assert np.linalg.matrix_rank(y, tol=1e-6) == 3 and np.allclose(y.mean(axis=0), 0, atol=1e-9)


def test_regression_learns_a_rule(spark):
    rows = [(f"d{i}", i % 2 * 3 + i % 3, i % 5, "right" if i % 2 else "left") for i in range(120)]
    fit = regression.regression(df(spark, rows, "d STRING, `Cluster 0` INT, `Cluster 1` INT, side STRING"), "d", "side", folds=2, repeats=1)
    assert fit.metrics["test_accuracy"] > 0.9 and fit.labels == ["left", "right"]
    w = {r["feature"]: r["weight"] for r in fit.weights.collect()}
    assert w["Cluster 0"] > 0 and abs(w["Cluster 0"]) > abs(w["Cluster 1"])


def test_relational(spark):
    a = df(spark, [(1, "x"), (2, None)], "k INT, v STRING")
    with pytest.raises(Exception):
        relational.require_complete(a, "v").collect()
    with pytest.raises(Exception):
        relational.require_domain(a, "v", ("y",)).collect()
    with pytest.raises(ValueError):
        relational.require_columns(a, "z")
    assert relational.keep_unlisted_or(a, df(spark, [(1, "advertisement")], "k INT, c STRING"), ["k"], "c", "podcast").first()["k"] == 2
    assert {(r["k"], r["v"]) for r in relational.overlay([a, df(spark, [(2, "z")], "k INT, v STRING")], ["k"]).collect()} == {(1, "x"), (2, "z")}
    tree = relational.adjacency(df(spark, [(1, 2), (2, 3)], "i INT, j INT"), "i", "j")
    more = relational.merge_adjacency(tree, relational.adjacency(df(spark, [(2, 9)], "i INT, j INT"), "i", "j"))
    assert {r["node"]: r["neighbours"] for r in more.collect()}[2] == [1, 3, 9]


def test_samples(spark):
    rows = df(spark, [(i, i % 3, i % 2) for i in range(90)], "i INT, g INT, p INT")
    assert sampling.draw(rows, "i", 10).count() == 10 and sampling.draw(rows, "i", 500).count() == 90
    preferred = sampling.draw_each(rows, ["g"], "i", 10, prefer=F.col("p")).collect()
    assert len(preferred) == 30 and all(r["p"] == 0 for r in preferred)
    assert sampling.draw_each(rows, ["g"], "i", 31, full_only=True).count() == 0
    used = sampling.inverse_usage(rows.limit(7), "i", 17).groupBy("i").count().collect()
    assert {r["count"] for r in used} == {2, 3}
    assert sampling.draw_stratified(rows, "g", "i", 40, 3).count() == 40


def test_document_features(spark):
    mets = df(spark, [("a", 0, "x"), ("a", 0, ""), ("a", 2, "y"), ("b", 1, None)], "d STRING, c INT, t STRING")
    docs = df(spark, [("a",), ("b",), ("c",)], "d STRING")
    m = {r["d"]: r["counts"] for r in aggregates.document_cluster_matrix(mets, docs, "d", "c", 3).collect()}
    assert m == {"a": [2, 0, 1], "b": [0, 1, 0], "c": [0, 0, 0]}
    g = {r["d"]: (r["Target x"], r["Target y"]) for r in aggregates.document_group_wide(mets, docs, "d", "t", ["x", "y"]).collect()}
    assert g == {"a": (1, 1), "b": (0, 0), "c": (0, 0)}
    i = features.dense_index(mets.withColumn("k", F.monotonically_increasing_id()), "k").select("idx").collect()
    assert sorted(r["idx"] for r in i) == [0, 1, 2, 3]


def test_paths_of_a_small_sentence(spark):
    toks = df(spark, [("d", 0, 0, "They", "PRON", 1, "nsubj"), ("d", 0, 1, "flood", "VERB", -1, "root"), ("d", 0, 2, "borders", "NOUN", 1, "dobj")], "doc_id STRING, sent_idx INT, tok_idx INT, text STRING, pos STRING, head INT, dep STRING")
    found = nlp.match_paths(nlp.paths(nlp.tokens_by_sentence(toks).where(nlp.is_candidate(F.col('t')))), nlp.grammar(spark, verbs_only=False))
    assert {(r["source"], r["target"], r["path_id"]) for r in found.collect()} == {(1, 0, 2), (1, 2, 1)}
    (pair,) = nlp.candidate_pairs(found.where("path_id = 1")).collect()
    assert pair["met_id"] == "d_0_1_2" and pair["met_paths"] == [1]


def test_three_slot_paths_and_both_directions(spark):
    toks = df(spark, [("d", 0, 0, "driven", "VERB", -1, "root"), ("d", 0, 1, "by", "ADP", 0, "agent"), ("d", 0, 2, "fear", "PROPN", 1, "pobj"), ("d", 1, 0, "tax", "NOUN", 1, "compound"), ("d", 1, 1, "burden", "NOUN", -1, "root")], "doc_id STRING, sent_idx INT, tok_idx INT, text STRING, pos STRING, head INT, dep STRING")
    found = nlp.match_paths(nlp.paths(nlp.tokens_by_sentence(toks)), nlp.grammar(spark, verbs_only=False)).collect()
    assert {(r["sent_idx"], r["source"], r["target"], r["path_id"]) for r in found} == {(0, 0, 2, 6), (1, 1, 0, 3), (1, 0, 1, 8)}


def test_parser_offsets_and_mentions(spark):
    text = "We stopped the flood. It moved on!"
    toks = nlp.tokens(nlp.parse(df(spark, [("d", text), ("e", None), ("f", "")], "id STRING, text STRING"), "id", "text")).collect()
    assert all(text[t["start_char"] : t["end_char"]] == t["text"] for t in toks) and {t["doc_id"] for t in toks} == {"d"}
    mentions = df(spark, [("d", "c1", 0, 2, 10), ("d", "c1", 0, 8, 9), ("d", "c2", 0, 9, 12)], "doc_id STRING, chain_id STRING, sent_idx INT, start_tok INT, end_tok INT")
    targets = df(spark, [("m1", "d", 0, 9), ("m2", "d", 0, 10), ("m3", "d", 0, 99)], "met_id STRING, doc_id STRING, sent_idx INT, target INT")
    chains = df(spark, [("c1", "one"), ("c2", "two")], "chain_id STRING, representative_text STRING")
    got = {r["met_id"]: r["representative_text"] for r in nlp.representative(targets, mentions, chains).collect()}
    assert got == {"m1": "two", "m2": "two", "m3": None}
    assert [(r["chain_id"], r["mention_idx"]) for r in nlp.one_mention_per_sentence(mentions).orderBy("chain_id").collect()] == [("c1", 0), ("c2", 0)]


def test_annotation_resumes_and_gives_up(spark):
    def flaky(frames):
        import json

        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "answer": [None if i == "b" else "{bad" if i == "c" else json.dumps({"noun_classification": "place"}) for i in frame["id"]]})

    items = df(spark, [("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")], "id STRING, t STRING")
    done = df(spark, [("d",)], "id STRING")
    got = {r["id"]: r["annotation"] for r in annotate.annotate(items, "id", F.col("t"), "noun_type", flaky, done, retries=2).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["noun_classification"] == "place" and got["b"] is None and got["c"] is None
    for task in annotate.ANSWERS:
        out = annotate.annotate(items, "id", F.col("t"), task, annotate.stub_provider(task))
        assert annotate.drop_failed(out).count() == 4
    with pytest.raises(ValueError):
        annotate.answer_schema("nothing")
    demos = [{"text": "T", "answer": {"a": 1}}] * 3
    assert items.select(annotate.with_demos(F.col("t"), demos, 2).alias("p")).first()["p"].count("T\n") == 2
    assert items.select(annotate.with_demos(F.col("t"), demos, 0).alias("p")).first()["p"] == "x"


def naive_pair(members, limit):
    """Nested loops over the nearest quarter, then over all; else the two nearest."""
    from tropelake.functions.text import STOP_WORDS

    words = [{w for w in t.lower().split() if len(w) > 1 and w not in STOP_WORDS} for _, _, t in members]
    for n in (max(1, len(members) // 4), len(members)):
        for i in range(n):
            for j in range(i + 1, n):
                alike = len(words[i] & words[j]) / max(1, len(words[i] | words[j]))
                if members[i][1] != members[j][1] and alike < limit:
                    return members[i][0], members[j][0], True
    return members[0][0], members[1][0], False


def test_first_pairs_match_nested_loops(spark):
    import random

    rng = random.Random(2)
    rows = []
    for c in range(40):
        n, wide = rng.randrange(1, 30), rng.random() < 0.5
        rows += [(c * 100 + i, c, float(i), f"d{rng.randrange(9 if wide else 2)}", " ".join(rng.choice(["wall", "flood", "fire", "sea", "the"]) for _ in range(rng.randrange(0, 4)))) for i in range(n)]
    rng.shuffle(rows)
    got = {r["label"]: (r["first"], r["second"], r["diverse"]) for r in intrusion.first_pair(df(spark, rows, "i INT, label INT, d2 DOUBLE, doc STRING, t STRING"), "label", "d2", "i", "doc", "t").collect()}
    want = {}
    for c in range(40):
        members = [(i, d, t) for i, _, _, d, t in sorted(r for r in rows if r[1] == c)]
        if len(members) > 1:
            want[c] = naive_pair(members, 0.6)
    assert got == want


def test_intrusion_examples(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 6, (np.eye(6)[i % 6] * 9 + rng.standard_normal(6)).tolist(), f"doc{i % 40}", f"word{i} other{i}") for i in range(120)]
    base = metrics.with_distance(df(spark, rows, "i INT, label INT, v ARRAY<DOUBLE>, doc STRING, t STRING"), "label", "v")
    found = intrusion.examples(base, metrics.centroids(base, "label", "v"), "i", "label", "d2", "doc", "t", {"easy": 5, "medium": 4, "hard": 4})
    got = {r["example_id"]: r for r in found.collect()}
    assert len(got) == 13 and all(r["intruder_index"] % 6 != r["source_cluster"] and all(p % 6 == r["source_cluster"] for p in r["positive_indices"]) and 1 <= r["answer"] <= 3 for r in got.values())
    for r in intrusion.shown(found, base, "i", "t").collect():  # the intruder stands where the solution says
        right = got[r["example_id"]]
        assert r[str(right["answer"])] == f"word{right['intruder_index']} other{right['intruder_index']}"
        assert {r["1"], r["2"], r["3"]} == {f"word{i} other{i}" for i in [*right["positive_indices"], right["intruder_index"]]}
