"""Parsing in bounded portions, and mentions resolved inside their sentences."""

import os

import pandas as pd
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tropelake.operators import nlp
from tropelake.plans import core

TEXTS = ["It walked by the house. They ended!", None, "", " \n", "... !? a.b", "x" * 300, "İ _x ed by.\n\nOf who", "who fell"] * 20


def texts(spark):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(TEXTS)], "id STRING, text STRING").coalesce(1)


def test_a_parser_is_given_portions(spark, monkeypatch):
    monkeypatch.setattr(nlp, "PARSED_AT_ONCE", 400)

    def parser(frames):
        for f in frames:
            n = f["text"].str.len().fillna(0)
            yield pd.DataFrame({"doc_id": f["doc_id"], "sentences": [[{"sent_idx": int(n.sum()), "text": t} for t in x] for x in f["text"].map(lambda t: [t])]})

    got = nlp.parse(texts(spark), "id", "text", parser).select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.sent_idx", "s.text").collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(str(k), t) for k, t in enumerate(TEXTS)} and len(got) == len(TEXTS)
    assert max(r["sent_idx"] for r in got) <= 400


def test_portions_do_not_change_what_is_parsed(spark, monkeypatch):
    whole = next(nlp.stub_parser([pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS})]))["sentences"]
    monkeypatch.setattr(nlp, "PARSED_AT_ONCE", 50)
    got = {int(r["doc_id"]): [s.asDict(True) for s in r["sentences"]] for r in nlp.parse(texts(spark), "id", "text").collect()}
    assert got == dict(enumerate(whole))


def test_representatives_inside_a_row(spark):
    rows = spark.createDataFrame([("d", 0, [0, 1, 2, 5], [(0, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 2, None)], {"a": "A", "b": "B", "c": "C"}), ("d", 1, [0], [(0, 0, "z")], {"a": "A"}), ("e", 0, [3], [], {})], "doc_id STRING, sent_idx INT, targets ARRAY<INT>, mentions ARRAY<STRUCT<start_tok: INT, end_tok: INT, chain_id: STRING>>, chains MAP<STRING, STRING>")
    targets = rows.select("doc_id", "sent_idx", F.explode("targets").alias("target")).withColumn("met_id", F.concat_ws("_", "doc_id", "sent_idx", "target"))
    mentions = rows.select("doc_id", "sent_idx", F.explode("mentions").alias("m")).select("doc_id", "sent_idx", "m.*")
    chains = rows.select(F.explode("chains").alias("chain_id", "representative_text")).distinct()
    want = {r["met_id"]: r["representative_text"] for r in nlp.representative(targets, mentions, chains).collect()}
    got = rows.select("doc_id", "sent_idx", F.explode(nlp.representatives(F.col("targets"), F.col("mentions"), F.col("chains"))).alias("r")).select("doc_id", "sent_idx", "r.*").collect()
    assert {f"{r['doc_id']}_{r['sent_idx']}_{r['target']}": r["representative_text"] for r in got} == want and len(got) == 6
    assert want == {"d_0_0": "A", "d_0_1": "C", "d_0_2": None, "d_0_5": None, "d_1_0": None, "e_0_3": None}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_coref_parses_once_and_joins_nothing(spark):
    plan = core.queries()["coref_representative"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1 and "Join" not in plan and "InMemoryRelation" not in plan
