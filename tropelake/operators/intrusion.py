"""Intrusion tests: two typical members of a cluster and an intruder from another; all choices by rank and lot."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, word_set
from ..functions.vectors import squared_distance
from .ranking import top_share
from .sampling import inverse_usage


def cluster_distances(centers: DataFrame, label: str = "label", center: str = "center") -> DataFrame:
    """``label``, ``other``, ``near_rank``: the other centres of each cluster from the nearest; k² rows of centres, not of data."""
    other = centers.select(F.col(label).alias("other"), F.col(center).alias("__o"))
    pairs = centers.select(label, center).join(other, F.col(label) != F.col("other")).withColumn("d2", squared_distance(F.col(center), F.col("__o")))
    return pairs.withColumn("near_rank", F.row_number().over(Window.partitionBy(label).orderBy("d2", "other"))).select(label, "other", "d2", "near_rank")


def far_or_near(distances: DataFrame, label: str = "label", percent: float = 25) -> DataFrame:
    """``kind`` easy (the farthest quarter of the other clusters), medium (the nearest quarter) or hard (the nearest)."""
    n = F.count("*").over(Window.partitionBy(label))
    m = distances.withColumn("n", n).withColumn("m", F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100)))
    easy, medium, hard = F.col("near_rank") > F.col("n") - F.col("m"), F.col("near_rank") <= F.col("m"), F.col("near_rank") == 1
    kinds = F.filter(F.array(F.when(easy, "easy"), F.when(medium, "medium"), F.when(hard, "hard")), lambda x: x.isNotNull())
    return m.select(label, "other", F.explode(kinds).alias("kind"))


def similar_sets(sets: DataFrame, within: str, ident: str, words: str, least: float, more: list[str] | None = None) -> DataFrame:
    """Pairs of word sets of one ``within`` with a Jaccard similarity of ``least`` or more: ``id_a`` < ``id_b``, ``jaccard`` and the columns ``more`` of both.  Sets are sorted lists, each once in its group; empty ones have no pairs.

    Two such sets of n and m words share at least least * max(n, m) of them, so they share one of the first
    n - ceil(least * n) + 1 words of each in any common order.  Only sets that do are compared.  Long words come first, as
    they are rarer.
    """
    more = more or []
    order = F.array_sort(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("l"), w.alias("w"))))
    head = F.size(words) - F.ceil(least * F.size(words) - 1e-9).cast("int") + 1
    rows = sets.where(F.size(words) > 0).select(F.col(within).alias("g"), F.col(ident).alias("i"), F.col(words).alias("w"), *more, F.explode(F.slice(order["w"], F.lit(1), head)).alias("p"))
    other = rows.select("g", "p", F.col("i").alias("i2"), F.col("w").alias("w2"), *[F.col(c).alias(f"{c}_b") for c in more])
    fits = (F.col("i") < F.col("i2")) & (F.least(F.size("w"), F.size("w2")) >= least * F.greatest(F.size("w"), F.size("w2")) - 1e-9)
    pairs = rows.withColumnsRenamed({c: f"{c}_a" for c in more}).join(other, ["g", "p"]).where(fits).withColumn("jaccard", jaccard(F.col("w"), F.col("w2"))).where(F.col("jaccard") >= least)
    return pairs.select(F.col("i").alias("id_a"), F.col("i2").alias("id_b"), "jaccard", *[f"{c}{s}" for c in more for s in ("_a", "_b")]).distinct()


def typical(df: DataFrame, label: str, distance: str, ident: str, percent: float = 25) -> DataFrame:
    """The nearest quarter of each cluster with two members or more."""
    big = df.groupBy(label).agg(F.count("*").alias("__n")).where("__n > 1").select(label)
    return top_share(df.join(big, label, "left_semi"), label, [F.col(distance), F.col(ident)], percent)


def first_pair(members: DataFrame, label: str, distance: str, ident: str, doc: str, text: str, limit: float = 0.6, percent: float = 25) -> DataFrame:
    """``label``, ``first``, ``second``, ``diverse``: of each cluster with two members or more the first two, in order of distance, of different documents and with word sets less alike than ``limit``.

    The nearest ``percent`` are looked at first, then all members; where no pair fits, the two nearest are taken and
    ``diverse`` is false.  Members stream by in order and a cluster ends with its first pair: held are only the members
    without a partner yet, each document and word set once, as a later copy has no partner that the earlier one hasn't.
    """
    rows = members.select(F.col(label).alias("c"), F.col(ident).alias("i"), F.col(doc).cast("string").alias("d"), F.array_sort(word_set(F.col(text))).alias("w"), F.col(distance).alias("far"))
    rows = rows.withColumn("near", F.row_number().over(Window.partitionBy("c").orderBy("far", "i")) <= F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("c")) * percent / 100)))
    kinds = dict(members.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        held: list = []
        two: list = []
        done = True

        def best() -> tuple | None:
            return next(((h[0], h[3]) for h in held if h[3] is not None), None)

        def close() -> None:
            pair = best()
            if not done and len(two) > 1:
                out.append((now, *(pair or two), pair is not None))

        for batch in batches:
            for c, i, d, w, near in zip(*[batch.column(n).to_pylist() for n in ("c", "i", "d", "w", "near")]):
                if c != now:
                    close()
                    now, held, two, done = c, [], [], False
                if done:
                    continue
                if not near and best():  # a pair among the nearest
                    close()
                    done = True
                    continue
                words = frozenset(w or ())
                if len(two) < 2:
                    two.append(i)
                for h in held:
                    if h[3] is None and h[1] != d and len(h[2] & words) < limit * max(1, len(h[2] | words)):
                        h[3] = i
                if held and held[0][3] is not None:
                    close()
                    done = True
                elif all((h[1], h[2]) != (d, words) for h in held):
                    held.append([i, d, words, None])
        close()
        if out:
            columns = [pa.array([r[j] for r in out], t) for j, t in enumerate((batch.schema.field("c").type, batch.schema.field("i").type, batch.schema.field("i").type, pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "first", "second", "diverse"])

    ordered = rows.repartition("c").sortWithinPartitions("c", "far", "i").select("c", "i", "d", "w", "near")
    return ordered.mapInArrow(run, f"c {kinds[label]}, first {kinds[ident]}, second {kinds[ident]}, diverse BOOLEAN").withColumnRenamed("c", label)


def examples(df: DataFrame, centers: DataFrame, ident: str, label: str, distance: str, doc: str, text: str, counts: dict[str, int], limit: float = 0.6, seed: int = 42) -> DataFrame:
    """``example_id``, ``difficulty``, ``source_cluster``, ``positive_indices``, ``intruder_index``, ``answer``: place 1 to 3 of the intruder; ``diverse``, whether the positives' documents and words differ.

    ``counts`` says how many examples of each difficulty; clusters are used as evenly as possible.  The intruder is a
    typical member, by lot, of a cluster of the difficulty's kind, also by lot.
    """
    close = typical(df, label, distance, ident)
    pairs = first_pair(df, label, distance, ident, doc, text, limit)
    kinds = far_or_near(cluster_distances(centers.join(pairs.select(label), label, "left_semi"), label), label)
    plan, at = None, 0
    for kind, n in counts.items():
        part = inverse_usage(pairs, label, n, seed + at).select((F.col("draw_no") + at).alias("example_id"), F.lit(kind).alias("difficulty"), label)
        plan = part if plan is None else plan.unionByName(part)
        at += n
    lot = lambda *c: F.md5(F.concat_ws("|", *[F.col(x).cast("string") for x in c], F.lit(str(seed))))
    target = plan.join(kinds.withColumnRenamed("kind", "difficulty"), [label, "difficulty"]).withColumn("__l", lot("example_id", "other"))
    target = target.groupBy("example_id", "difficulty", label).agg(F.min_by("other", F.struct("__l", "other")).alias("other"))
    intruder = target.join(close.select(F.col(label).alias("other"), F.col(ident).alias("intruder_index")), "other").withColumn("__l", lot("example_id", "intruder_index"))
    intruder = intruder.groupBy("example_id", "difficulty", label).agg(F.min_by("intruder_index", F.struct("__l", "intruder_index")).alias("intruder_index"))
    place = (F.pmod(F.xxhash64("example_id", F.lit(seed)), F.lit(3)) + 1).cast("int")
    return intruder.join(pairs, label).select(F.col("example_id").cast("int"), "difficulty", F.lit("method 0").alias("method"), F.col(label).alias("source_cluster"), F.array("first", "second").alias("positive_indices"), "intruder_index", place.alias("answer"), "diverse")


def shown(found: DataFrame, df: DataFrame, ident: str, text: str) -> DataFrame:
    """What an annotator sees of ``examples``: ``example_id`` and the texts ``1``, ``2`` and ``3``, with the intruder's at ``answer``."""
    a, b, x, at = F.get("positive_indices", F.lit(0)), F.get("positive_indices", F.lit(1)), F.col("intruder_index"), F.col("answer")
    order = F.when(at == 1, F.array(x, a, b)).when(at == 2, F.array(a, x, b)).otherwise(F.array(a, b, x))
    places = found.select("example_id", F.posexplode(order).alias("place", ident))
    texts = places.join(df.select(ident, F.col(text).alias("__t")), ident, "left")
    return texts.groupBy("example_id").agg(*[F.max(F.when(F.col("place") == k, F.col("__t"))).alias(str(k + 1)) for k in range(3)])
