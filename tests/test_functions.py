"""Functions on small literals with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tropelake.functions import ids, vectors
from tropelake.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x INT"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


def s(value):
    return ("STRING", value)


@pytest.mark.parametrize("text, want", [("  It's  GOOD,\tok! ", "its good ok"), ("", ""), ("...", ""), (None, None), ("a  b c", "a b c")])
def test_clean_text(spark, text, want):
    assert one(spark, T.clean_text(F.col("t")), t=s(text)) == want


def test_word_bounds_are_strict(spark):
    assert [one(spark, T.words_between(F.col("t"), 2, 4), t=s(x)) for x in ("a b", "a b c", "a b c d", "")] == [False, True, False, False]


def test_collapse_nbsp(spark):
    assert one(spark, T.collapse_nbsp(F.col("t")), t=s("a&#160; &#160;&#160;b &#160;c")) == "a&#160;b &#160;c"


def test_jaccard(spark):
    def j(a, b):
        return one(spark, T.jaccard(T.word_set(F.col("a")), T.word_set(F.col("b"))), a=s(a), b=s(b))

    assert abs(j("the big wall", "a big red wall") - 2 / 3) < 1e-12
    assert j("the a of", "and to") == 0.0 and j("Big WALL", "wall big") == 1.0


def test_labels(spark):
    def clean(x):
        return one(spark, T.sanitize_label(F.col("t"), ["Immigrants"]), t=s(x))

    assert [clean(x) for x in ("Immigrants: people who move", "Immigrants (e.g., x)", "Unclear", "who", None)] == ["Immigrants", "Immigrants", "Other", "Other", None]
    assert one(spark, T.first_contained(F.col("t"), ["pro", "neutral", "anti"]), t=s("rather anti it")) == "anti"
    assert one(spark, T.first_contained(F.col("t"), ["pro"]), t=s("x")) == "invalid"


def test_markers_and_scores(spark):
    assert one(spark, T.after_marker(F.col("t"), "Sentence: '", True), t=s("x\n Sentence: 'we go'")) == "we go"
    assert one(spark, T.after_marker(F.col("t"), "Sentence: "), t=s("none")) is None
    assert [one(spark, T.parse_score(F.col("t")), t=s(x)) for x in ("2.0", "3", "x", None)] == [2, 3, None, None]
    assert one(spark, T.unanimous(F.array(F.lit(1), F.lit(1)))) == 1 and one(spark, T.unanimous(F.array(F.lit(1), F.lit(2)))) is None


@pytest.mark.parametrize("date, year", [("2023-05-14", 2023), ("2023-05-14T06:30:00Z", 2023), ("2025/12/08", 2025), ("unknown", None), (None, None), ("", None)])
def test_years(spark, date, year):
    assert one(spark, T.year_of(F.col("t")), t=s(date)) == year


def test_spans(spark):
    word, start, end = T.span_of(F.col("t"), "LmTarget")
    text = "They <LmSource>flood</LmSource> the <LmTarget>border</LmTarget> ."
    assert one(spark, F.struct(word, start, end), t=s(text)) == ("border", 15, 21)
    assert one(spark, F.struct(*T.span_of(F.col("t"), "Lm")), t=s("none")) == (None, None, None)
    df = spark.createDataFrame([("A wall, the Wall; walls", "wall"), (None, "x"), ("x", None)], "a STRING, b STRING")
    assert [[tuple(x) for x in r[0]] for r in df.select(T.word_spans("a", "b")).collect()] == [[(2, 6), (12, 16)], [], []]


def test_chunks(spark):
    def cut(text, limit):
        return one(spark, T.chunks(limit)(F.col("t")), t=s(text))

    assert cut("Hello abc. Next one", 10)[0] == "Hello"
    assert cut("One. Two three", 10) == ["One.", "Two three"] and cut("a, bcdefghij", 10) == ["a,", "bcdefghij"]
    assert cut("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and cut("short", 10) == ["short"] and cut(None, 10) is None


def test_ids(spark):
    i = F.col("t")
    parts = F.struct(ids.document(i), ids.sentence(i), ids.source_token(i), ids.target_token(i), ids.part(i, 4), ids.parent(i))
    assert tuple(one(spark, parts, t=s("d-1_2_3_4"))) == ("d-1", 2, 3, 4, None, "d-1_2_3")
    assert [one(spark, ids.strip_chunk(i), t=s(x)) for x in ("a-b-3", "plain")] == ["a-b", "plain"]
    episode = "5ad0c1e7-00ff-4b7e-9d42-77c0ffee1234"
    assert [one(spark, ids.strip_episode_chunk(i), t=s(x)) for x in (episode, episode + "-12", "12-3")] == [episode, episode, "12-3"]
    assert one(spark, ids.compose(F.lit("d"), F.lit(1), F.lit(2))) == "d_1_2"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.dot(a, b)) == 3 and one(spark, vectors.norm(a)) == 5 and one(spark, vectors.squared_distance(a, b)) == 20
    assert one(spark, vectors.normalized(a)) == [0.6, 0.8] and one(spark, vectors.mean_of_two(a, b)) == [2.0, 2.0]
    assert one(spark, vectors.normalized(F.array(F.lit(0.0)))) == [0.0]


def test_templates(spark):
    assert one(spark, T.fill("{a} and {b}.", a=F.lit("x"), b=F.lit(None))) == "x and ."
