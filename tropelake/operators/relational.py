"""Lookups, restrictions, interval joins, reshaping and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(left: DataFrame, right: DataFrame, keys: list[str], default: dict | None = None) -> DataFrame:
    """Left equi-join; ``default`` gives values where the lookup misses.  The right side must have unique keys."""
    out = left.join(right, keys, "left")
    return out.fillna(default) if default else out


def require_complete(df: DataFrame, column: str) -> DataFrame:
    """Raises when a value of ``column`` is missing, while the rows are read."""
    checked = F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(F.lit(f"missing value in {column}")).cast(df.schema[column].dataType))
    return df.withColumn(column, checked)


def require_domain(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Raises on a value outside of ``domain``; nulls pass."""
    bad = F.raise_error(F.concat(F.lit(f"value outside the domain of {column}: "), F.col(column))).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(F.col(column).isNull() | F.col(column).isin(*domain), F.col(column)).otherwise(bad))


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def only(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return df.join(keys, on, "left_semi")


def remaining(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't in ``done``: what a resumed stage still has to do."""
    return df.join(done, on, "left_anti")


def keep_unlisted_or(df: DataFrame, classes: DataFrame, on: list[str], column: str, value: str) -> DataFrame:
    """Rows without a class, or of class ``value``."""
    return df.join(classes.select(*on, column), on, "left").where(F.coalesce(F.col(column), F.lit(value)) == value).drop(column)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def overlay(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which the last frame that has a key wins."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("__p", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return keep_first(out, keys, [F.desc("__p")]).drop("__p")


def attributes_wide(annotations: DataFrame, key: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """Entity-attribute-value rows as one row per entity with a column for each kind (of several values, the smallest)."""
    return annotations.where(F.col(kind).isin(kinds)).groupBy(key).pivot(kind, kinds).agg(F.min(value))


def containing(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Points joined with the spans of the same ``on`` that hold them, ends included."""
    same = [points[k] == spans[k] for k in on]
    inside = points[at].between(spans[start], spans[end])
    joined = points.join(spans, [*same, inside], how)
    for k in on:
        joined = joined.drop(spans[k])
    return joined


def overlapping(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs of spans of the same ``on`` that have a place in common; ends are exclusive."""
    same = [a[k] == b[k] for k in on]
    meet = (a[a_span[0]] < b[b_span[1]]) & (a[a_span[1]] > b[b_span[0]])
    joined = a.join(b, [*same, meet])
    for k in on:
        joined = joined.drop(b[k])
    return joined


def overlapping_spread(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """Overlap join without an equal key: spans go to all the cells of ``width`` they touch, and a pair is kept in the cell where its common part starts."""
    cells = lambda df, s: F.explode(F.sequence(F.floor(df[s[0]] / width), F.floor((df[s[1]] - 1) / width)))
    left, right = a.withColumn("__c", cells(a, a_span)), b.withColumn("__d", cells(b, b_span))
    meet = (left[a_span[0]] < right[b_span[1]]) & (left[a_span[1]] > right[b_span[0]])
    first = F.floor(F.greatest(left[a_span[0]], right[b_span[0]]) / width) == F.col("__c")
    return left.join(right, (F.col("__c") == F.col("__d")) & meet & first).drop("__c", "__d")


def different_pairs(df: DataFrame, index: str, within: list[str], differ: list[str]) -> DataFrame:
    """Pairs ``i`` < ``j`` of one ``within`` group that differ in any of ``differ``; rows with a null there are in none.

    Pair listings grow with the square of a group; counts have a closed form in ``constraints``.
    """
    rows = df.dropna(subset=differ).select(*within, F.col(index).alias("i"), F.struct(*differ).alias("f"))
    other = rows.withColumnsRenamed({"i": "j", "f": "g"})
    joined = rows.join(other, within) if within else rows.join(other, F.col("i") < F.col("j"))
    return joined.where("i < j AND f <> g").select(*within, "i", "j")


def full_coverage(df: DataFrame, group: str, unit: str) -> DataFrame:
    """Groups that occur with every ``unit`` of the table (relational division)."""
    every = df.agg(F.countDistinct(unit).alias("__all"))
    return df.groupBy(group).agg(F.countDistinct(unit).alias("__n")).crossJoin(F.broadcast(every)).where("__n = __all").select(group)


def nested(parent: DataFrame, child: DataFrame, key: str, foreign: str, order: list[str], name: str) -> DataFrame:
    """Each parent with the list of its children in a stated order; one without children has an empty list."""
    items = child.groupBy(foreign).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in child.columns if c not in order and c != foreign]))).alias(name))
    out = parent.join(items.withColumnRenamed(foreign, key), key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(items.schema[name].dataType)))


def adjacency(pairs: DataFrame, i: str, j: str) -> DataFrame:
    """Both directions of the pairs as sorted sets of neighbours."""
    both = pairs.select(F.col(i).alias("node"), F.col(j).alias("n")).unionByName(pairs.select(F.col(j).alias("node"), F.col(i).alias("n")))
    return both.groupBy("node").agg(F.sort_array(F.collect_set("n")).alias("neighbours"))


def merge_adjacency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two adjacency tables."""
    both = a.unionByName(b)
    return both.groupBy("node").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("neighbours")))).alias("neighbours"))


def unzip(df: DataFrame, *columns: str) -> DataFrame:
    """Lists of equal length exploded together."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode(F.arrays_zip(*columns)).alias("__z")).select(*others, *[F.col(f"__z.{c}").alias(c) for c in columns])


def long_form(df: DataFrame, keys: list[str], names: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, names, name, value)


def require_equal(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Raises when two columns of a pair differ in a row, while the rows are read; two nulls are equal."""
    for a, b in pairs:
        bad = F.raise_error(F.concat(F.lit(f"{a} and {b} differ: "), F.coalesce(F.col(a).cast("string"), F.lit("null")), F.lit(" / "), F.coalesce(F.col(b).cast("string"), F.lit("null"))))
        df = df.withColumn(a, F.when(F.col(a).eqNullSafe(F.col(b)), F.col(a)).otherwise(bad.cast(df.schema[a].dataType)))
    return df


def suffix_join(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join of two sheets with the same columns: all but the keys come twice, with a suffix.  Null keys meet each other."""
    left = a.select(*keys, *[F.col(c).alias(c + suffixes[0]) for c in a.columns if c not in keys])
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(c + suffixes[1]) for c in b.columns if c not in keys])
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])


def relabel(df: DataFrame, column: str, names: dict, otherwise: Column | None = None) -> DataFrame:
    """Values by a small map of names; what isn't in it stays, or becomes ``otherwise``."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.try_element_at(table, F.col(column)) if names else F.lit(None)
    return df.withColumn(column, F.coalesce(found, otherwise if otherwise is not None else F.col(column)))


def lookup_by_kind(df: DataFrame, kind: str, ident: str, tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """A lookup whose table depends on the row's kind: one join on kind and identifier.  Rows of other kinds get nulls."""
    every = None
    for name, t in tables.items():
        part = t.select(F.lit(name).alias(kind), ident, *columns)
        every = part if every is None else every.unionByName(part)
    return df.join(every, [kind, ident], "left")


def agreeing_pairs(pairs: DataFrame, annotations: DataFrame, doc: str, same: dict[str, str]) -> DataFrame:
    """Pairs whose words are those annotated for their document, whatever their case and outer blanks: ``same`` maps columns of pairs to columns of annotations (one row per document)."""
    clean = lambda c: F.lower(F.btrim(F.col(c)))
    asked = annotations.select(doc, *[clean(b).alias(f"__{a}") for a, b in same.items()])
    out = pairs.join(asked, doc)
    for a in same:
        out = out.where(clean(a) == F.col(f"__{a}"))
    return out.drop(*[f"__{a}" for a in same])


def judged_only(df: DataFrame, score: str, unknown: int = -1, binary: bool = False) -> DataFrame:
    """Rows with a score other than ``unknown``; ``binary``: 1 for scores over 1, else 0."""
    rows = df.where(F.col(score).isNotNull() & (F.col(score) != unknown))
    return rows.withColumn(score, (F.col(score) > 1).cast("int")) if binary else rows


def first_rows(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """The first ``n`` rows in a stated order (a top-k), or all without ``n``."""
    return df.orderBy(*order).limit(n) if n else df


def numeric_order(df: DataFrame, column: str, *more: str) -> DataFrame:
    """Sorted by the number that a text stands for; texts that are none come last, in their own order."""
    number = F.col(column).try_cast("double")
    return df.orderBy(number.isNull(), number, column, *more)


def attach_by_position(a: DataFrame, a_order: str, b: DataFrame, b_order: str, columns: list[str]) -> DataFrame:
    """Columns of the row at the same place: both tables are numbered in order of a column without ties."""
    from .features import dense_index

    other = dense_index(b.select(F.col(b_order).alias("__o"), *columns), "__o").drop("__o")
    return dense_index(a, a_order).join(other, "idx", "left").drop("idx")
