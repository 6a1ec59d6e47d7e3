"""Commands end to end on small tables, and the grid evaluation."""

import numpy as np
import pytest

from tropelake import cli
from tropelake.operators import experiments

CORPUS = [("a", "They stopped the flood of people. We flooded the border."), ("b", "Voters burned the bridge. It was raised by fear."), ("c", None)]


@pytest.fixture
def run(spark, tmp_path):
    def go(command, rows, schema, *options, out="out", read=None):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "in"))
        cli.main([command, str(tmp_path / "in"), str(tmp_path / out), *map(str, options)], spark)
        return spark.read.parquet(str(tmp_path / (read or out))).collect()

    return go


def test_candidates_and_annotation(run, tmp_path):
    got = run("candidates", CORPUS, "id STRING, text STRING")
    assert len(got) > 1 and all(r["met_id"].startswith(("a-0_", "b-0_")) for r in got)
    items = [("m1", "flood", "people", "s"), ("m2", "burn", "bridge", "t")]
    schema = "id STRING, source_word STRING, target_word STRING, sentence STRING"
    assert {r["id"] for r in run("annotate-task", items, schema, "--workers", 2, out="ann")} == {"m1", "m2"}
    cli_done = str(tmp_path / "ann")
    again = run("annotate-task", [*items, ("m3", "x", "y", "z")], schema, "--done", cli_done, out="ann")
    assert sorted(r["id"] for r in again) == ["m1", "m2", "m3"]


def test_vectors_and_clusters(run):
    assert {r["idx"] for r in run("embed", CORPUS[:2], "id STRING, text STRING", "--dim", 8)} == {0, 1}
    rng = np.random.default_rng(0)
    rows = [(i, (np.eye(3)[i % 3] * 5 + rng.standard_normal(3)).tolist(), "ab"[i % 2]) for i in range(30)]
    schema = "id INT, emb ARRAY<DOUBLE>, g STRING"
    assert run("cannot-link", rows, schema, "--feature-key", "g")[0][0] == 225
    assert len(run("cannot-link", rows[:6], schema, "--feature-key", "g", "--pairs", out="pairs")) > 0
    assert len({r["label"] for r in run("cluster", rows, schema, "--k", 3, out="fit", read="fit/assignments")}) == 3
    got = run("cluster", rows, schema, "--k", 3, "--use-pckmeans", "--skip-init", "--feature-key", "g", "--max-iter", 2, out="fit", read="fit/assignments")
    assert len(got) == 30
    assert sorted(r["k"] for r in run("elbow", rows, schema, "--k", 3)) == [2, 3]


def test_small_commands(run):
    assert len(run("sample", [(i, i % 2) for i in range(40)], "id INT, g INT", "--n", 3, "--by", "g")) == 6
    episode = "5ad0c1e7-00ff-4b7e-9d42-77c0ffee1234"
    assert run("fix-ids", [(episode + "-3_1_2_3",)], "id STRING")[0][0] == episode + "_1_2_3"
    assert len(run("remove-null-results", [("a", "x"), ("b", None)], "id STRING, annotation STRING")) == 1


def test_grid_evaluation(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"d{i % 30}", (np.eye(4)[i % 4 if i % 30 < 15 else (i + 1) % 2] * 6 + rng.standard_normal(4)).tolist(), "ab"[i % 2], "xy"[i % 4 // 2]) for i in range(240)]
    df = spark.createDataFrame(rows, "i INT, doc STRING, v ARRAY<DOUBLE>, f STRING, h STRING")
    labels = spark.createDataFrame([(f"d{k}", "left" if k < 15 else "right") for k in range(30)], "doc STRING, side STRING")
    out = experiments.evaluate_grid(df, "i", "v", ["f", "h"], "doc", labels, "side", experiments.Grid((4,), (0.01,)), folds=2, repeats=1).collect()
    assert [(r["k"], r["w_cl"]) for r in out] == [(4, None), (4, 0.01)]
    assert all(r["calinski_harabasz"] > 0 and 0 <= r["purity_all"] <= 1 and 0 <= r["test_accuracy"] <= 1 for r in out)
    assert len(experiments.Grid().configurations()) == 48


def test_combined_inputs(spark):
    texts = spark.createDataFrame([("a", [2.0, 0.0], 0), ("b", [0.0, 2.0], 1)], "doc STRING, v ARRAY<DOUBLE>, label INT")
    mets = spark.createDataFrame([("a", [1.0, 1.0], 1, "t"), ("a", [3.0, 1.0], 1, "")], "doc STRING, v ARRAY<DOUBLE>, label INT, g STRING")
    got = {r["doc"]: r["vector"] for r in experiments.combined_vectors(texts, mets, "doc", "v", 2, "mean").collect()}
    assert got == {"a": [2.0, 0.5], "b": [0.0, 1.0]}
    wide = {r["doc"]: r for r in experiments.combined_counts(mets, texts, texts, "doc", 2, 2, "g", ["t"]).collect()}
    assert wide["a"]["Met Cluster 1"] == 2 and wide["a"]["Text Cluster 0"] == 1 and wide["a"]["Target t"] == 1 and wide["b"]["Met Cluster 0"] == 0
