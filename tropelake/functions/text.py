"""Text functions, as column expressions wherever Spark can express them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))

#: Unicode whitespace, in a notation that Java and RE2 share.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Slips in group labels.
REPAIRS = {"u.s country": "u.s. country"}
#: The forms of dates, slashes as dashes.
DATE_FORMS = ("yyyy-MM-dd", "yyyyMMdd", "M-d-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")

#: Stop words of the word-set similarity.
STOP_WORDS = (
    "a an and are as at be by for from has he "
    "in is it its of on that the to was will with "
    "i you we they them their this these those have "
    "had been being do does did can could should would "
    "may might must shall not no nor but or yet so "
    "if when where why how what which who whom whose"
).split()


def collapse(text: Column) -> Column:
    """Runs of whitespace as one space, none outside."""
    return F.btrim(F.regexp_replace(text, SPACE, " "))


def clean_text(text: Column) -> Column:
    """Lower case without ASCII punctuation, whitespace collapsed; null stays null."""
    return collapse(F.translate(F.lower(text), PUNCTUATION, ""))


def words(text: Column) -> Column:
    """Words between whitespace; an empty text has none."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def words_between(text: Column, low: int, high: int) -> Column:
    """Whether the number of words is strictly between ``low`` and ``high``."""
    return (word_count(text) > low) & (word_count(text) < high)


def collapse_nbsp(text: Column) -> Column:
    """Repeated ``&#160;`` entities, whatever marks stand between them, become one."""
    return F.regexp_replace(text, r"(?i)(&#160;)\W*\1+", "&#160;")


def word_set(text: Column) -> Column:
    """Distinct lower-case words of more than one letter that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.filter(words(F.lower(text)), lambda w: F.char_length(w) > 1), stop)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two word sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def sanitize_label(label: Column, accepted: list[str]) -> Column:
    """A label without its definition (from a colon) and example (from ``" (e.g.,"``); what isn't accepted is ``Other``, null stays null."""
    short = F.substring_index(F.substring_index(label, ":", 1), " (e.g.,", 1)
    return F.when(label.isNull(), F.lit(None)).when(short.isin(accepted), short).otherwise("Other")


def clean_group(label: Column, accepted: list[str], repairs: dict[str, str] | None = None, other: str = "other") -> Column:
    """A label in lower case without outer blanks, with known slips repaired; ``other`` if it isn't accepted then.  Null stays null."""
    short = F.lower(F.btrim(label))
    for wrong, right in (repairs or REPAIRS).items():
        short = F.replace(short, F.lit(wrong), F.lit(right))
    return F.when(label.isNull(), F.lit(None)).when(short.isin(accepted), short).otherwise(other)


def first_contained(text: Column, options: list[str], otherwise: str = "invalid") -> Column:
    """The text if it is an option, else the first option contained in it."""
    out = F.when(text.isin(options), text)
    for o in options:
        out = out.when(F.contains(text, F.lit(o)), F.lit(o))
    return out.otherwise(otherwise)


def after_marker(text: Column, marker: str, drop_quote: bool = False) -> Column:
    """What follows the first ``marker``; null without one.  ``drop_quote``: without a closing quote."""
    at = F.instr(text, marker)
    rest = F.when(at > 0, F.substring(text, at + len(marker), F.char_length(text)))
    return F.regexp_replace(rest, "'$", "") if drop_quote else rest


def parse_score(score: Column) -> Column:
    """The whole part of a number in text, without its fraction; null if it is none."""
    return score.try_cast("double").try_cast("int")


def unanimous(scores: Column) -> Column:
    """The value all annotators gave, else null."""
    return F.when(F.size(F.array_distinct(scores)) == 1, F.element_at(scores, 1))


def year_of(date: Column) -> Column:
    """Year of a date in one of the forms of the metadata: an ISO date, with time or slashes, without marks, month first, or with the month's name; null if it is none."""
    day = F.btrim(F.translate(F.substring_index(date, "T", 1), "/", "-"))
    return F.year(F.coalesce(*[F.try_to_date(day, form) for form in DATE_FORMS]))


def span_of(text: Column, tag: str) -> tuple[Column, Column, Column]:
    """First text inside ``<tag>``, and its start and end in the text without any tags."""
    opening = f"(?s)^(.*?)<{tag}[^>]*>(.*?)</{tag}>"
    inner = F.nullif(F.regexp_extract(text, opening, 2), F.lit(""))
    plain = F.regexp_replace(F.regexp_extract(text, opening, 1), "<[^>]*>", "")
    bare = F.regexp_replace(inner, "<[^>]*>", "")
    start = F.when(inner.isNotNull(), F.char_length(plain))
    return bare, start, start + F.char_length(bare)


def relative_span(text: Column, text_start: Column, start: Column, end: Column, token: Column) -> tuple[Column, Column]:
    """Start and end of a token in its sentence, from places in the document; raises when the sentence doesn't have the token there."""
    a, b = start - text_start, end - text_start
    there = F.substring(text, a + 1, b - a)
    checked = F.when(there.eqNullSafe(token), a).otherwise(F.raise_error(F.concat(F.lit("span and token differ: "), F.coalesce(there, F.lit("null")), F.lit(" / "), F.coalesce(token, F.lit("null")))).cast("int"))
    return checked, checked + (b - a)


def joined_values(answer: Column, fields: list[str]) -> Column:
    """An answer's values as one paragraph, in the order of its fields; missing ones leave nothing."""
    return F.concat_ws(" ", *[answer[f] for f in fields])


def wrapped(width: int):
    """A function from a text to its lines of at most ``width`` characters."""

    @F.pandas_udf(StringType())
    def wrap(texts: pd.Series) -> pd.Series:
        import textwrap

        return texts.map(lambda t: None if t is None else textwrap.fill(t, width))

    return wrap


def fill(template: str, **values: Column) -> Column:
    """A prompt: ``{name}`` in the template stands for a column; null values leave nothing."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


@F.pandas_udf(_SPANS)
def word_spans(texts: pd.Series, sought: pd.Series) -> pd.Series:
    """Places where a word stands by itself, whatever its case."""
    out = []
    for text, word in zip(texts, sought):
        whole = re.compile(rf"\b{re.escape(word)}\b", re.IGNORECASE) if text and word else None
        out.append([{"start": m.start(), "end": m.end()} for m in whole.finditer(text)] if whole else [])
    return pd.Series(out, dtype=object)


def chunks(limit: int = 42_000):
    """A function from a text to its chunks of at most ``limit`` characters, without their outer blanks.

    A chunk ends at the last end of a sentence in the window, else at the last soft mark, else at the last space, else
    at the limit.  A null text has no chunks.
    """
    marks = [re.compile(p) for p in (r"[.!?]\s+", r"[,;:\-]\s+", r" ")]

    def ends(text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > limit:
            stop = at + limit
            for mark in marks:
                found = [m.end() for m in mark.finditer(text, at, stop)]
                if found:
                    stop = found[-1]
                    break
            out.append(text[at:stop].strip())
            at = stop
        return [*out, text[at:].strip()] if len(text) > limit else [text]

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else ends(t))

    return cut
