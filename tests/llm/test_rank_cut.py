"""Top N, cutoffs and splitting against brute force."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tropelake.llm")
from tropelake.llm.cutoff import cutoffs
from tropelake.llm.split import Boundaries, balanced_pieces, distinct_pieces, full_pieces, split_texts
from tropelake.llm.top_n import latest, top_n_per_group

RANK = "g INT, s DOUBLE, i STRING, score STRING, rank STRING, grp STRING"


def test_top_n_matches_brute_force_with_ties_and_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(30), rng.randrange(6) / 2, f"m{rng.randrange(4000):04d}", "x", "y", "z") for _ in range(5000)]
    got = top_n_per_group(spark.createDataFrame(rows, RANK).repartition(7), "g", "s", "i", 4).collect()
    want = []
    for g in {r[0] for r in rows}:
        want += [(g, i, s, n + 1) for n, (s, i) in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == g)[:4])]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_n_descending_keeps_smaller_identifier_first(spark):
    rows = [(1, 2.0, x, "", "", "") for x in "cab"] + [(1, 3.0, "z", "", "", "")]
    got = top_n_per_group(spark.createDataFrame(rows, RANK), "g", "s", "i", 3, descending=True).orderBy("rank").collect()
    assert [r["i"] for r in got] == ["z", "a", "b"]


def test_top_n_batches_do_not_restart_counts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k % 3, float(k), f"{k:03d}", "", "", "") for k in range(60)]
        got = top_n_per_group(spark.createDataFrame(rows, RANK).coalesce(1), "g", "s", "i", 5).collect()
        assert sorted((r["g"], r["rank"], r["s"]) for r in got) == sorted((g, n + 1, float(g + 3 * n)) for g in range(3) for n in range(5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_top_n_drops_nulls_and_nan_and_takes_empty_tables(spark):
    rows = [(None, 1.0, "a", "", "", ""), (1, None, "b", "", "", ""), (1, float("nan"), "c", "", "", ""), (1, 1.0, None, "", "", ""), (1, -0.0, "e", "", "", ""), (1, 0.0, "d", "", "", "")]
    got = top_n_per_group(spark.createDataFrame(rows, RANK), "g", "s", "i", 5).orderBy("rank").collect()
    assert [(r["i"], r["rank"]) for r in got] == [("d", 1), ("e", 2)]
    assert top_n_per_group(spark.createDataFrame([], RANK), "g", "s", "i", 5).count() == 0


def test_latest_prefers_later_stamps_and_takes_nulls(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", None, 1), ("a", t, 2), ("a", datetime(2023, 1, 1), 3), ("b", None, 4), (None, t, 5)]
    got = latest(spark.createDataFrame(rows, "k STRING, at TIMESTAMP_NTZ, v INT"), "k", "at", ["v"]).collect()
    assert sorted((r["k"], r["v"]) for r in got) == [("a", 2), ("b", 4)]


def brute_cutoff(scores, percent):
    n = len(scores)
    return max(c for c in scores if 100 * sum(s >= c for s in scores) >= percent * n)


@pytest.mark.parametrize("salt_rows", [7, 65_536])
def test_cutoffs_match_brute_force(spark, monkeypatch, salt_rows):
    monkeypatch.setattr("tropelake.llm.cutoff.SALT_ROWS", salt_rows)
    rng = random.Random(5)
    data = {
        "one": [0.5], "same": [0.25] * 40, "two": [0.1, 0.9], "ties": [rng.randrange(4) / 4 for _ in range(200)],
        "skewed": [rng.random() ** 9 for _ in range(500)], "edge": [0.0] * 30 + [1.0] * 3, "tiny": [1e-300 * k for k in range(50)], "wide": [-1e6, 3.0, 3.0 + 1e-12, 1e6],
    }
    rows = [(s, x, p, "clash") for k, (s, xs) in enumerate(data.items()) for p in [(10, 25, 30, 50, 100, 0, 33, 75)[k]] for x in xs]
    got = {r["src"]: r for r in cutoffs(spark.createDataFrame(rows, "src STRING, score DOUBLE, pct INT, n STRING"), "src", "score", "pct").collect()}
    assert set(got) == set(data)
    for k, (s, xs) in enumerate(data.items()):
        p = (10, 25, 30, 50, 100, 0, 33, 75)[k]
        want = brute_cutoff(xs, p)
        assert (got[s]["cutoff"], got[s]["n_rows"], got[s]["n_kept"]) == (want, len(xs), sum(x >= want for x in xs)), s


def test_cutoffs_close_over_all_magnitudes(spark):
    xs = [s * 10.0**e for e in range(-300, 300, 7) for s in (1, -1)] + [0.0, 5e-324, -5e-324, 1.7e308]
    rows = [(f"p{p}", x, p) for p in (1, 20, 49, 50, 51, 80, 99) for x in xs]
    got = {r["src"]: r for r in cutoffs(spark.createDataFrame(rows, "src STRING, score DOUBLE, pct INT"), "src", "score", "pct").collect()}
    assert all(got[f"p{p}"]["cutoff"] == brute_cutoff(xs, p) for p in (1, 20, 49, 50, 51, 80, 99)) and max(r["n_rounds"] for r in got.values()) < 100


def test_cutoffs_drop_unusable_rows_and_take_empty_tables(spark):
    schema = "src STRING, score DOUBLE, pct INT"
    rows = [("a", float("nan"), 50), ("a", float("inf"), 50), ("a", None, 50), (None, 0.5, 50), ("b", 0.5, None), ("a", 0.5, 50)]
    got = cutoffs(spark.createDataFrame(rows, schema), "src", "score", "pct").collect()
    assert [(r["src"], r["cutoff"], r["n_kept"]) for r in got] == [("a", 0.5, 1)]
    assert cutoffs(spark.createDataFrame([], schema), "src", "score", "pct").count() == 0


WS = " \t\n\r"


def literal_pieces(text, limit=5000, overlap=250):
    """The rule in its own words, one character at a time."""
    start, out = 0, []
    while True:
        if len(text) - start <= limit:
            return [*out, (start, len(text))]
        window = text[start : start + limit]
        end = None
        for marks in (".!?", ",;:-"):
            for p in range(1, limit):
                if window[p] in WS and window[p - 1] in marks:
                    q = p
                    while q < limit and window[q] in WS:
                        q += 1
                    if q > overlap:
                        end = start + q
            if end:
                break
        if not end:
            spaces = [p + 1 for p in range(limit) if window[p] == " " and p + 1 > overlap]
            end = start + (spaces[-1] if spaces else limit)
        out.append((start, end))
        start = next((p for p in range(end - overlap, end) if text[p] not in WS and text[p - 1] in WS), end - overlap)


def random_text(rng, size):
    kinds = ["word", "Слово", "😀", "a", " ", "x" * 40]
    out = []
    while sum(map(len, out)) < size:
        out.append(rng.choice(kinds) + rng.choice(["", ".", "!", ",", "-", ";"]) + rng.choice([" ", " ", "", "\n", "\t ", " " * 30, "."]))
    return "".join(out)


def test_full_pieces_follow_the_rule():
    rng = random.Random(11)
    for trial in range(120):
        text = random_text(rng, rng.randrange(50, 900))
        assert full_pieces(text, 100, 15) == literal_pieces(text, 100, 15), repr(text)
    assert full_pieces("y" * 950, 100, 15) == literal_pieces("y" * 950, 100, 15)
    assert full_pieces("", 100, 15) == [(0, 0)]


def test_balanced_pieces_are_few_equal_and_cover_the_text():
    rng = random.Random(12)
    for _ in range(150):
        text = random_text(rng, rng.randrange(10, 3000))
        got = balanced_pieces(text, 200, 20)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(0 < b - a <= 200 for a, b in got)
        assert all(c < b and a < c for (a, b), (c, _) in zip(got, got[1:]))
    plain = "Some words here. " * 300
    got = balanced_pieces(plain, 500, 50)
    assert len(got) <= -(-(len(plain) - 50) // 450) + 1
    assert all(plain[:b].rstrip().endswith(".") for _, b in got)
    assert max(b - a for a, b in got) < 1.3 * min(b - a for a, b in got)


def test_split_texts_edge_cases(spark):
    rows = [("a", None, 1), ("b", "", 2), ("c", "short. ", 3), ("d", "Long enough. " * 20, 4), ("d", "Long enough. " * 20, 4), (None, "z" * 300, 5)]
    df = spark.createDataFrame(rows, "id STRING, text STRING, piece_no INT")
    got = distinct_pieces(split_texts(df, "id", "text", 100, 10, "full"), "id").collect()
    assert {r["id"] for r in got} == {"d", None}
    assert len([r for r in got if r["id"] == "d"]) == len(full_pieces("Long enough. " * 20, 100, 10))
    all_ = split_texts(df, "id", "text", 100, 10, oversized_only=False)
    assert {r["id"] for r in all_.collect()} == {"c", "d", None}
    assert split_texts(df.limit(0), "id", "text", 100, 10).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "id", "text", 100, 60)


def test_boundaries_know_their_strength():
    at = Boundaries("One two, three. four five")
    last = lambda low, high, base: at.snap(high, low, high, base)
    assert last(0, 25, 0) == 16 and last(0, 14, 0) == 9 and last(0, 7, 0) == 4 and last(16, 20, 16) == 20
    assert at.snap(12, 10, 20) == 16 and at.snap(12, 3, 15) == 9 and at.snap(20, 16, 25) == 21 and at.snap(2, 0, 3) == 2


def test_balanced_pieces_fit_under_any_limits():
    """A word longer than a piece, and an overlap of almost half the limit."""
    rng = random.Random(13)
    for text in ("y" * 1003, ("z" * 70 + " ") * 20, random_text(rng, 900), " " * 500, ("a b. " * 9 + "w" * 80) * 9):
        for limit, overlap in ((51, 25), (100, 49), (100, 0), (60, 7)):
            got = balanced_pieces(text, limit, overlap)
            assert got[0][0] == 0 and got[-1][1] == len(text) and all(0 < b - a <= limit for a, b in got)
            assert all(a < c and (c < b or c == b and not overlap) for (a, b), (c, _) in zip(got, got[1:]))


def test_pieces_come_with_or_without_their_text(spark):
    df = spark.createDataFrame([("d", "Long enough. " * 20)], "id STRING, text STRING")
    rows = split_texts(df, "id", "text", 100, 10).collect()
    assert all(r["piece"] == ("Long enough. " * 20)[r["start_char"] : r["end_char"]] for r in rows)
    assert [r[:4] for r in rows] == [tuple(r) for r in split_texts(df, "id", "text", 100, 10, with_text=False).collect()]


def test_score_columns_may_be_decimal_free(spark):
    got = top_n_per_group(spark.createDataFrame([(1, 3, "a"), (1, 2, "b")], "g INT, s INT, i STRING"), "g", "s", "i", 1).collect()
    assert [tuple(r) for r in got] == [(1, "b", 2, 1)] and not math.isnan(got[0]["s"])
    assert F is not None
