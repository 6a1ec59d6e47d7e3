"""Joins and samples of the evaluation, providers by name, saved rounds, sources, classifier, target groups, and their commands."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tropelake import cli
from tropelake.functions import text as T
from tropelake.operators import annotate, classifier, features, groups, metrics, nlp, providers, regression, relational, sampling
from tropelake.sources import results


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def answers(task="noun_type", **options):
    """A provider that tests name by module and function."""

    def run(frames):
        import json

        import pandas as pd

        for frame in frames:
            said = {"groups": {"groups": ["Migrants", "Towns "]}, "clean_groups": {"clean_groups": {"migrants": "immigrants"}}, "noun_type": {"noun_classification": "place"}}[task]
            yield pd.DataFrame({"id": frame["id"], "answer": [json.dumps(said)] * len(frame)})

    return run


def test_checked_and_suffixed_joins(spark):
    a = df(spark, [(1, "x", "x"), (2, None, None)], "k INT, s STRING, t STRING")
    assert relational.require_equal(a, [("s", "t")]).count() == 2
    with pytest.raises(Exception, match="s and t differ: x / y"):
        relational.require_equal(df(spark, [("x", "y")], "s STRING, t STRING"), [("s", "t")]).collect()
    b = df(spark, [(1, "z"), (None, "w")], "k INT, s STRING")
    got = relational.suffix_join(b, b.withColumn("s", F.upper("s")), ["k"]).collect()
    assert {(r["k"], r["s_x"], r["s_y"]) for r in got} == {(1, "z", "Z"), (None, "w", "W")}
    assert relational.suffix_join(b.limit(0), b, ["k"]).count() == 0


def test_lookups_labels_and_orders(spark):
    rows = df(spark, [("person", 1), ("place", 1), ("thing", 2), (None, 3)], "kind STRING, i INT")
    tables = {"person": df(spark, [(1, "a")], "i INT, g STRING"), "place": df(spark, [(1, "b")], "i INT, g STRING")}
    assert {(r["kind"], r["g"]) for r in relational.lookup_by_kind(rows, "kind", "i", tables, ["g"]).collect()} == {("person", "a"), ("place", "b"), ("thing", None), (None, None)}
    names = {r["i"]: r["kind"] for r in relational.relabel(rows.where("i > 1"), "kind", {"thing": "Thing"}).collect()}
    assert names == {2: "Thing", 3: None} and relational.relabel(rows, "kind", {}, F.lit("?")).where("kind = '?'").count() == 4
    keys = df(spark, [("10",), ("9",), ("x",), ("1.5",), (None,)], "k STRING")
    assert [r["k"] for r in relational.numeric_order(keys, "k").collect()] == ["1.5", "9", "10", None, "x"]
    assert relational.first_rows(rows, ["i"], None).count() == 4 and [r["i"] for r in relational.first_rows(rows, ["i", "kind"], 2).collect()] == [1, 1]
    both = relational.attach_by_position(df(spark, [("b",), ("a",), ("c",)], "k STRING"), "k", df(spark, [(2, "y"), (1, "x")], "n INT, v STRING"), "n", ["v"]).collect()
    assert {(r["k"], r["v"]) for r in both} == {("a", "x"), ("b", "y"), ("c", None)}


def test_annotated_pairs_and_judgements(spark):
    pairs = df(spark, [("p", "d", " Flood", "Border"), ("q", "d", "wall", "border"), ("r", "e", "x", "y")], "id STRING, doc STRING, s STRING, t STRING")
    human = df(spark, [("d", "flood ", "BORDER"), ("e", None, "y")], "doc STRING, hs STRING, ht STRING")
    assert [r["id"] for r in relational.agreeing_pairs(pairs, human, "doc", {"s": "hs", "t": "ht"}).collect()] == ["p"]
    scores = df(spark, [(-1,), (0,), (1,), (3,), (None,)], "score INT")
    assert sorted(r[0] for r in relational.judged_only(scores, "score").collect()) == [0, 1, 3]
    assert sorted(r[0] for r in relational.judged_only(scores, "score", binary=True).collect()) == [0, 0, 1]


def test_quota_of_a_sample(spark):
    rows = df(spark, [(f"m{i}", i % 10 / 10) for i in range(400)] + [("n", float("nan")), ("o", None)], "id STRING, score DOUBLE")
    got = sampling.draw_quota(rows, "id", "score", 50, 0.4).collect()
    low = [r for r in got if r["score"] < 0.4]
    assert len(got) == 50 and len(low) == 4 and len({r["id"] for r in got}) == 50  # 5 over 4 scores
    each = [sum(r["score"] == s / 10 for r in got) for s in (4, 5, 6, 7, 8, 9)]
    assert min(each) >= 7 and sum(each) == 46  # 45 over 6 scores, and four to fill
    done = df(spark, [(r["id"],) for r in got], "id STRING")
    assert not {r["id"] for r in sampling.draw_quota(rows, "id", "score", 50, 0.4, done).collect()} & {r["id"] for r in got}
    assert sampling.draw_quota(rows.limit(0), "id", "score", 50, 0.4).count() == 0


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first()["r"]
    assert tuple(one(F.struct(*T.relative_span(F.lit("a flood"), F.lit(10), F.lit(12), F.lit(17), F.lit("flood"))))) == (2, 7)
    with pytest.raises(Exception, match="span and token differ"):
        one(F.struct(*T.relative_span(F.lit("a flood"), F.lit(10), F.lit(11), F.lit(16), F.lit("flood"))))
    assert one(T.clean_group(F.lit(" U.S country "), ["u.s. country"])) == "u.s. country" and one(T.clean_group(F.lit("x"), ["y"])) == "other"
    assert [one(T.parse_score(F.lit(x))) for x in ("-0.5", "-1.9", "2.9", "nan")] == [0, -1, 2, None]
    assert [one(T.year_of(F.lit(x))) for x in ("20240131", "1/31/2024", "January 3, 2024", "3 Feb 2023", "2024-13-01", "x")] == [2024, 2024, 2024, 2023, None, None]
    assert one(T.joined_values(F.struct(F.lit("b").alias("x"), F.lit(None).cast("string").alias("y"), F.lit("a").alias("z")), ["z", "y", "x"])) == "a b"
    assert one(T.wrapped(5)(F.lit("one two"))) == "one\ntwo"
    values = {"source_word": F.lit("flood"), "target_word": F.lit("border"), "sentence": F.lit("s")}
    assert one(annotate.candidate_prompt(**values)) == "Specified Verb: 'flood'\n Sentence: 's'" and "Target Word: 'border\n" in one(annotate.candidate_prompt(False, True, **values))


def test_scores_of_thresholds_and_rubrics(spark):
    rng = np.random.default_rng(1)
    rows = df(spark, [(float(rng.integers(0, 6)), float(rng.random())) for _ in range(80)] + [(None, 0.5)], "s DOUBLE, h DOUBLE")
    got = {r["threshold"]: r["auc"] for r in metrics.roc_auc_thresholds(rows, "s", "h", [0.2, 0.5, 2.0]).collect()}
    for t in (0.2, 0.5):
        assert got[t] == pytest.approx(metrics.roc_auc(rows.withColumn("y", F.col("h") >= t), "s", "y").first()[0])
    assert got[2.0] is None
    truth = df(spark, [("x", "x"), ("x", "y"), ("y", "y"), ("z", "y")], "t STRING, p STRING")
    s = metrics.overall_scores(truth, "t", "p").first()
    assert s["accuracy"] == s["micro_f1"] == 0.5 and s["recall"] == pytest.approx(0.5)
    swapped = metrics.threshold_report(df(spark, [(0.9, False), (0.9, True), (0.1, True)], "s DOUBLE, y BOOLEAN"), "s", "y", [0.5], predicted=True).first()
    assert (swapped["tp"], swapped["fp"], swapped["fn"], swapped["precision"]) == (1, 1, 1, 50.0)
    means = metrics.rubric_means(df(spark, [("TRUE", "2"), ("false", "4"), (None, None)], "`a?` STRING, b STRING"), {"sum": ["b"]}).first()
    assert means["sum"] == 3 and means["a?"] == pytest.approx(1 / 3)


def test_providers_by_name(spark):
    items = df(spark, [("a", "x"), ("b", "y")], "id STRING, t STRING")
    named = providers.provider("answers", "test_more:answers", task="noun_type")
    assert {r["annotation"]["noun_classification"] for r in annotate.annotate(items, "id", F.col("t"), "noun_type", named).collect()} == {"place"}
    with pytest.raises(ValueError):
        providers.provider("answers", "test_more")
    assert nlp.path_scores(items, "id", "t", providers.provider("scores")).where("score BETWEEN 0 AND 1").count() == 2
    tokens = nlp.retokenized(df(spark, [("a", "We go. They stay."), ("b", None)], "id STRING, t STRING"), "id", "t").collect()
    assert [t["text"] for t in sorted(tokens, key=lambda t: t["tok_idx"])] == ["We", "go", "."]
    words = df(spark, [("a", "the wall stands", "Wall"), ("b", "the wall stands", "sea"), ("c", None, "x")], "id STRING, t STRING, w STRING")
    assert [r["id"] for r in features.word_vectors(words, "id", "t", "w", providers.provider("words", dim=8)).collect()] == ["a"]


def test_saved_rounds_go_on(spark, tmp_path):
    items = df(spark, [(f"i{k}", "x") for k in range(40)], "id STRING, t STRING")
    path, provider = str(tmp_path / "out"), annotate.stub_provider("noun_type")
    assert annotate.annotate_saved(items.limit(25), "id", F.col("t"), "noun_type", provider, path, every=5, workers=2).count() == 25
    both = annotate.annotate_saved(items, "id", F.col("t"), "noun_type", provider, path, every=5).collect()
    assert sorted(r["id"] for r in both) == sorted(f"i{k}" for k in range(40))


def test_pair_errors_are_counted_without_pairs(spark):
    #  a tree of three, a lone token, and a sentence whose token is its own head
    sents = [("d", 0, [(0, "N", 1, "x"), (1, "V", -1, "root"), (2, "N", 1, "x"), (3, "N", -1, "root")]), ("d", 1, [(0, "N", 0, "x"), (1, "V", -1, "root")])]
    rows = df(spark, sents, "doc_id STRING, sent_idx INT, t ARRAY<STRUCT<tok_idx: INT, pos: STRING, head: INT, dep: STRING>>")
    assert {r["error"]: r["n"] for r in nlp.pair_errors(rows).collect()} == {"pairs": 7, "no path between parts": 4, "sentences with a loop": 1}


def test_texts_of_embeddings(spark):
    rows = df(spark, [("a", ("w", "b", None, "c"), "x Sentence: we go"), ("a", ("w", "b", None, "c"), "x Sentence: we go"), ("b", None, "")], "id STRING, annotation STRUCT<problem_def: STRING, cause: STRING, moral_eval: STRING, treatment_rec: STRING>, text STRING")
    got = lambda kind: {r["id"]: r["text"] for r in features.embedding_texts(kind, rows).collect()}
    assert got("entailments") == {"a": "w b c"} and got("sentence") == {"a": "we go"} and got("document") == {"a": "x Sentence: we go"}
    with pytest.raises(ValueError):
        features.embedding_texts("nothing", rows)


def test_written_maps_and_tables(spark, tmp_path):
    path = str(tmp_path / "map")
    results.map_json(df(spark, [("a", 1, "x"), ("b", None, "y"), (None, 3, "z")], "id STRING, n INT, t STRING"), "id", path)
    assert {(r["id"], r["n"], r["t"]) for r in results.read_map_json(spark, "id", "n INT, t STRING", path).collect()} == {("a", 1, "x"), ("b", None, "y")}
    assert json.loads(sorted(spark.read.text(path).collect())[0][0]) == {"a": {"n": 1, "t": "x"}}
    results.create_tables(spark, str(tmp_path / "db"))
    results.create_tables(spark, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/tokens")).columns[0] == "id"
    docs, notes = df(spark, [("d",), ("e",)], "id STRING"), df(spark, [("d", "polarity", "left")], "document_id STRING, annotation_type STRING, annotation_value STRING")
    kept = str(tmp_path / "kept")
    assert {(r["id"], r["polarity"]) for r in results.annotated_documents(spark, docs, notes, ["polarity"], kept).collect()} == {("d", "left"), ("e", None)}
    assert results.annotated_documents(spark, docs.limit(0), notes, ["polarity"], kept).count() == 2  # not made again
    assert results.load_or_make(spark, kept, lambda: docs.limit(1), renew=True).count() == 1


def test_classifier_learns_and_leaves_groups_out(spark):
    rng = np.random.default_rng(2)
    rows = [(f"i{k}", (np.eye(4)[k % 2] * 3 + rng.standard_normal(4) * 0.3).tolist(), k % 2, "gh"[k % 4 // 2]) for k in range(120)]
    table = df(spark, [*rows, ("z", None, 1, "g")], "id STRING, v ARRAY<DOUBLE>, y INT, c STRING")
    reports, scores = classifier.evaluate(table, "id", "v", "y", folds=3)
    assert scores.count() == 3 and all(r["accuracy"] == 1 for r in scores.collect()) and reports.where("class = 'accuracy'").count() == 3
    assert {r["fold"] for r in classifier.evaluate(table, "id", "v", "y", group="c")[1].collect()} == {"g", "h"}
    with pytest.raises(ValueError):
        classifier.evaluate(table.limit(0), "id", "v", "y")


def test_target_groups_from_clusters_to_names(spark):
    places = ["the river runs by the mill", "the old river town", "the wide river bank"] * 6 + ["a bill in congress today", "congress voted on a bill", "the congress floor bill"] * 6
    mets = df(spark, [(f"m{k}", "Person", "river" if "river" in s else "congress", f"{s} {k}") for k, s in enumerate(places)] + [("x", "thing", "wall", "a wall")], "id STRING, noun_classification STRING, target_word STRING, sentence STRING")
    words = providers.provider("words", dim=16)
    clusters = groups.noun_clusters(mets, "person", words, range(2, 4), 2, components=1)
    assert clusters.count() == 36
    prompts = groups.group_prompts(clusters, "person", "podcasts").collect()
    assert all(p["id"].startswith("person_") and p["text"].startswith("ISSUE: U.S. Politics\nNOUNS:") for p in prompts)
    named = groups.create_groups(mets, "person", "podcasts", words, answers("groups"), ks=range(2, 3), restarts=1, components=1)
    assert {r["group"] for r in named.collect()} == {"Migrants", "Towns "}
    assert [tuple(r) for r in groups.clean_groups(named, answers("clean_groups")).collect()] == [("migrants", "immigrants")]


def test_regressions_from_clusters(spark, tmp_path):
    docs = df(spark, [(f"d{i}", "right" if i % 2 else "left") for i in range(100)], "d STRING, side STRING")
    mets = df(spark, [(f"d{i}", 7000 + i % 2, "g" if i % 3 else "") for i in range(100)], "d STRING, label INT, t STRING")
    texts = df(spark, [(f"d{i}", i % 5) for i in range(100)], "d STRING, label INT")
    out = str(tmp_path / "lr")
    got = {r["metric"]: r["value"] for r in regression.run_clusters(mets, docs, "d", ["side"], texts, "t", out, folds=2, repeats=1).collect()}
    assert got["test_accuracy"] == 1.0
    weights = {r["feature"] for r in results.collect_reports(spark, f"{out}/weights").collect()}
    assert {"Met Cluster 7001", "Text Cluster 4", "Target g"} <= weights


def test_new_commands(spark, tmp_path):
    def run(command, rows, schema, *options, out="out"):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "in"))
        cli.main([command, str(tmp_path / "in"), str(tmp_path / out), *map(str, options)], spark)
        return spark.read.parquet(str(tmp_path / out)).collect()

    scores = [(f"m{i}", i % 10 / 10) for i in range(60)]
    assert len(run("sample-scores", scores, "id STRING, llm_met_score DOUBLE", "--n", 20)) == 20
    assert all(r["llm_met_score"] >= 0.4 for r in run("export-metaphors", scores, "id STRING, llm_met_score DOUBLE", "--sample", 7))
    assert {r["word"] for r in run("word-clusters", [("Big wall",), ("sea",), ("old wall",)], "word STRING", "--k", 2)} == {"big wall", "sea", "old wall"}
    spark.createDataFrame([("a", "left"), ("b", "right")] * 20, "doc_id STRING, polarity STRING").distinct().write.parquet(str(tmp_path / "labels"))
    spark.createDataFrame([("m1", "g1")], "id STRING, target_group STRING").write.parquet(str(tmp_path / "person"))
    got = run("sample-targets", [("m1", "person"), ("m2", "place")], "id STRING, noun_classification STRING", "--groups", f"person={tmp_path}/person")
    assert {(r["id"], r["target_group"]) for r in got} == {("m1", "g1"), ("m2", None)}
    run("annotate-task", [("m1", "flood", "s", "people")], "id STRING, source_word STRING, sentence STRING, target_word STRING", "--task", "noun_type", "--provider", "test_more:answers", "--save-every", 1, out="ann")
    assert spark.read.parquet(str(tmp_path / "ann")).first()["annotation"]["noun_classification"] == "place"
    (tmp_path / "model.yaml").write_text("model: none\nworkers: 2\nmax_retries: 1  # few\nsave_interval: 3\n")
    two = [("m1", "flood", "s", "people"), ("m2", "burn", "t", "x")]
    schema = "id STRING, source_word STRING, sentence STRING, target_word STRING"
    got = run("annotate-task", two, schema, "--after", str(tmp_path / "ann"), "--only", "noun_classification=Place", "--config", str(tmp_path / "model.yaml"), out="chained")
    assert [r["id"] for r in got] == ["m1"]
    rng = np.random.default_rng(0)
    rows = [(i, (np.eye(3)[i % 3] * 5 + rng.standard_normal(3)).tolist(), f"d{i}", f"word{i} w{i}") for i in range(36)]
    spark.createDataFrame([(i, v, i % 3, d, t) for i, v, d, t in rows], "id INT, emb ARRAY<DOUBLE>, label INT, doc_id STRING, text STRING").write.parquet(str(tmp_path / "placed"))
    cli.main(["intrusion-examples", str(tmp_path / "placed"), str(tmp_path / "intrusion"), "--total", "6"], spark)
    texts = {str(r["id"]): r["text"] for r in spark.read.parquet(str(tmp_path / "placed")).collect()}
    right = {r["example_id"]: r for r in spark.read.parquet(str(tmp_path / "intrusion/solutions")).collect()}
    shown = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "intrusion/examples")).collect()
    assert len(shown) == 6
    for r in shown:  # the sheet and its solution fit
        s = right[int(r["example_id"])]
        assert json.loads(r["example"])[str(s["answer"])] == texts[str(s["intruder_index"])]
