"""Readers and writers on files written here."""

import json
import pickle

import pytest
from pyspark.sql import functions as F

from tropelake.operators import annotate
from tropelake.sources import corpora, results
from tropelake.streaming.resume import annotate_available


def test_podcasts(spark, tmp_path):
    meta, texts = tmp_path / "meta", tmp_path / "texts"
    meta.mkdir(), texts.mkdir()
    (meta / "left-open_air.json").write_text(json.dumps({"title": "T", "author": "A", "episodes": {"e-1": {"file_path": "x/y/0001.mp3", "episode_date": "2023-01-02T00:00:00Z", "duration": 12.5}}}, indent=1))
    (texts / "0001.json").write_text(json.dumps({"text": "hello"}))
    (r,) = corpora.podcasts(spark, str(meta), str(texts)).collect()
    assert (r["episode"], r["polarity"], r["channel"], r["year"], r["duration"], r["text"]) == ("e-1", "left", "open_air", 2023, 12.5, "hello")
    assert corpora.load_raw(spark, "podcasts", metadata=str(meta)).count() == 1


def test_tweets(spark, tmp_path):
    raw, marks, labels = tmp_path / "raw.tsv", tmp_path / "marks.tsv", tmp_path / "labels.tsv"
    raw.write_text("id_str\ttext\tideology\n1234567890123456789\tone\t-0.5\n2\ttwo\t0.5\n2\ttwo\t0.5\n3\tthree\t\n")
    marks.write_text("id_str\tHate Speech\n2\tno\n")
    labels.write_text("id_str\ttext\tpercent_yes\n2\ttwo\t0.9\n3\tthree\t0.1\n")
    got = {r["id_str"]: r["hate_speech"] for r in corpora.tweets(spark, str(raw), [str(marks)]).collect()}
    assert got == {"1234567890123456789": None, "2": "no", "3": None}
    sides = {r["id_str"]: r["polarity"] for r in corpora.tweets_frame(spark, str(raw)).collect()}
    assert sides == {"1234567890123456789": "left", "2": "right", "3": "right"}
    assert [r["id_str"] for r in corpora.tweets_frame(spark, str(raw), str(labels), 0.3).collect()] == ["2"]
    marks.write_text("id_str\tx\n9\tno\n")
    with pytest.raises(Exception):
        corpora.tweets(spark, str(raw), [str(marks)]).collect()


def test_subframes(spark, tmp_path):
    with open(tmp_path / "a.pkl", "wb") as f:
        pickle.dump([{}, {}, {1: "H", 2: "I"}, {1: "text", 2: "more"}, {2: "left", 1: "right"}], f)
    got = {r["article_id"]: r["polarity"] for r in corpora.subframes(spark, str(tmp_path / "a.pkl"), str(tmp_path / "out")).collect()}
    assert got == {"1": "right", "2": "left"}
    assert corpora.load_raw(spark, "subframes_guns", articles=str(tmp_path / "out")).count() == 2
    with pytest.raises(NotImplementedError):
        corpora.load_raw(spark, "lcc-small")
    with pytest.raises(ValueError):
        corpora.load_raw(spark, "nothing")


def test_lcc(spark, tmp_path):
    inst = '<LmInstance id="{}" targetConcept="T"><TextContent><Prev>{}</Prev><Current>They <LmSource>flood</LmSource> the <LmTarget>border</LmTarget> .</Current><Next></Next></TextContent><Annotations><MetaphoricityAnnotations><MetaphoricityAnnotation score="{}"/><MetaphoricityAnnotation score="{}"/></MetaphoricityAnnotations></Annotations></LmInstance>'
    (tmp_path / "x.xml").write_text("<all>" + inst.format(1, "", "2.0", "2.0") + inst.format(2, "Before.", "1.0", "3.0") + "</all>")
    a, b = corpora.lcc(spark, str(tmp_path / "x.xml")).orderBy("id").collect()
    assert (a["source_string"], a["source_char_start"], a["source_char_end"], a["target_char_start"], a["target_char_end"], a["score"]) == ("flood", 5, 10, 15, 21, 2)
    assert b["score"] is None and b["text"][b["target_char_start"] : b["target_char_end"]] == "border"


def test_chunks_and_annotations(spark):
    docs = spark.createDataFrame([("d", "One two. Three four", "left", None)], "id STRING, text STRING, polarity STRING, other STRING")
    assert [(r["chunk_idx"], r["text"]) for r in corpora.chunked(docs, "id", "text", 12).collect()] == [(0, "One two."), (1, "Three four")]
    (r,) = corpora.annotations(docs, "id", ["polarity", "other"]).collect()
    assert tuple(r) == ("d_polarity", "d", "polarity", "left")


def test_results(spark, tmp_path):
    data = {"d-1_2_3_4": {"text": "t", "source_word": " Flood ", "target_word": "Border", "annotation": {"classification": "Metaphorical", "explanation": "e"}}, "d_1_1_1": {"text": "t", "source_word": "a", "target_word": "b", "annotation": None}}
    (tmp_path / "podcasts.json").write_text(json.dumps({"config": {}, "data": data}))
    got = {r["id"]: r for r in results.classification_results(spark, str(tmp_path), "podcasts").collect()}
    a, b = got["d-1_2_3_4"], got["d_1_1_1"]
    assert (a["doc_id"], a["sent_idx"], a["source_word"], a["target_word"], a["llm_met_class"], a["invalid"]) == ("d-1", 2, "flood", "border", True, False)
    assert (b["llm_met_class"], b["invalid"]) == (False, True)
    assert results.classification_results(spark, str(tmp_path), "podcasts", metaphors_only=True).count() == 1
    with pytest.raises(ValueError):
        results.classification_results(spark, str(tmp_path), "lcc-small", with_ads=True)
    scores = {"x_1_2_3": {"text": "", "source_word": "s", "target_word": "t", "annotation": {"metaphor_salience_score": 0.5, "explanation": ""}}}
    (tmp_path / "scores.json").write_text(json.dumps({"data": scores}))
    (r,) = results.scored_results(spark, str(tmp_path / "scores.json"), True).collect()
    assert r["target_word"] == "t" and r["llm_met_score"] == 0.5


def test_reports_and_pairs(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "feature STRING, weight DOUBLE")
    results.store_report(df, str(tmp_path / "r"), "polarity", 25, 0.1)
    results.store_report(df, str(tmp_path / "r"), "polarity", 50)
    assert {(r["k"], r["w_cl"]) for r in results.collect_reports(spark, str(tmp_path / "r")).collect()} == {(25, 0.1), (50, None)}
    results.write_pairs(spark.createDataFrame([(3, 1), (1, 3), (2, 2)], "i INT, j INT"), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert [tuple(r) for r in stored.collect()] == [(1, 3)]
    assert results.has_pairs(spark.createDataFrame([(3, 1), (4, 5)], "i INT, j INT"), stored).count() == 1
    for name in ("weights_k25_w0.1.csv", "weights_50.csv"):
        (tmp_path / "c").mkdir(exist_ok=True)
        (tmp_path / "c" / name).write_text("feature,weight\na,1\n")
    assert {r["k"] for r in results.by_file_name(spark, str(tmp_path / "c"), "feature STRING, weight DOUBLE").collect()} == {25, 50}
    examples = spark.createDataFrame([(1, "a", "b")], "example_id INT, one STRING, two STRING")
    results.separate_export(examples, examples.select("example_id"), str(tmp_path / "x"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "x/examples")).count() == 1


def test_experiment(tmp_path):
    e = results.Experiment("tweets_immigration", "/r", "llm", "met", labeled_only=True, options={"k": 3})
    e.save(str(tmp_path / "e.json"))
    assert results.Experiment.load(str(tmp_path / "e.json")) == e and e.out_name == "tweets_immigration_labeled" and e.out == "/r/llm/met"
    with pytest.raises(ValueError):
        results.Experiment("podcasts", "/r", "a", "b", labeled_only=True)
    (tmp_path / "m.yaml").write_text("model: 'some:model'\noptions:\n  temperature: 0.5\n  workers: 4  # few\n")
    assert results.ProviderOptions.from_yaml(str(tmp_path / "m.yaml")) == results.ProviderOptions("some:model", 0.5, 4)


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    run = lambda: annotate_available(spark, src, "id STRING, t STRING", "id", lambda: F.col("t"), "noun_type", annotate.stub_provider("noun_type"), out, ck)
    spark.createDataFrame([("a", "x"), ("b", "y")], "id STRING, t STRING").write.parquet(src)
    run()
    spark.createDataFrame([("b", "y"), ("c", "z")], "id STRING, t STRING").write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
