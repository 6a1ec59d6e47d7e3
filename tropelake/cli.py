"""Command line: ``python -m tropelake.cli COMMAND …``.  Tables are parquet directories unless a reader says otherwise."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .operators import annotate, classifier, clustering, constraints, experiments, features, groups, intrusion, metrics, nlp, providers, regression, relational, sampling
from .session import session
from .sources import corpora, results


def _write(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").parquet(out)


def candidates(spark: SparkSession, a) -> None:
    docs = corpora.chunked(spark.read.parquet(a.input), a.id, a.text, a.limit)
    docs = docs.withColumn("doc_id", F.concat_ws("-", "doc_id", "chunk_idx"))
    if a.sample:
        docs = sampling.draw(docs, "doc_id", a.sample, a.seed)
    sents = nlp.sentence_tokens(nlp.parse(docs, "doc_id", "text", providers.provider("parser", a.parser))).where(nlp.is_candidate(F.col("t")))
    _write(nlp.candidate_pairs(nlp.match_paths(nlp.paths(sents, not a.all_paths), nlp.grammar(spark, not a.all_paths))), a.out)


def annotate_task(spark: SparkSession, a) -> None:
    items = spark.read.parquet(a.input)
    prompt = results.prompt_file(a.prompt_file) if a.prompt_file else {"question": "", "demos": []}
    names = {c: F.col(c) for c in items.columns}
    text = annotate.prompt(a.task, prompt["question"], **names)
    done = spark.read.parquet(a.done) if a.done else None
    if a.sample:
        items = sampling.draw(items, a.id, a.sample, a.seed)
    answers = providers.provider("answers", a.provider, task=a.task, seed=a.seed)
    if a.config:
        told = results.ProviderOptions.from_yaml(a.config)
        a.workers, a.retries, a.save_every = told.workers, told.max_retries, told.save_interval
    if a.after:  # chained: only what an earlier task answered with FIELD=VALUE
        field, value = a.only.split("=", 1)
        items = items.join(annotate.matching(spark.read.parquet(a.after), field, value).select(F.col("id").alias("__after")), F.col(a.id).cast("string") == F.col("__after"), "left_semi")
    if done is not None:
        items = items.join(done.select(F.col("id").alias("__done")), F.col(a.id).cast("string") == F.col("__done"), "left_anti")
    annotate.annotate_saved(items, a.id, annotate.with_demos(text, prompt["demos"], a.shots, a.seed), a.task, answers, a.out, a.save_every, retries=a.retries, workers=a.workers)


def embed(spark: SparkSession, a) -> None:
    rows = spark.read.parquet(a.input).withColumnRenamed(a.id, "id").withColumnRenamed(a.text, "text")
    rows = features.embed(features.embedding_texts(a.kind, rows), "id", "text", providers.provider("embedder", a.embedder, dim=a.dim))
    _write(features.dense_index(rows, "id"), a.out)


def cannot_link(spark: SparkSession, a) -> None:
    rows = spark.read.parquet(a.input)
    if a.pairs:
        results.write_pairs(relational.different_pairs(rows, a.id, [], a.feature_key), a.out)
    else:
        _write(constraints.cannot_link_count(rows, a.feature_key), a.out)


def cluster(spark: SparkSession, a) -> None:
    rows = spark.read.parquet(a.input)
    if a.use_pckmeans:
        group = F.when(F.forall(F.array(*[F.col(f).isNotNull() for f in a.feature_key]), lambda x: x), F.concat_ws("|", *a.feature_key))
        labels, _, history = clustering.pckmeans(rows.withColumn("__g", group), a.id, a.vector, "__g", a.k, a.w_cl, "kmeans" if a.skip_init else "spread", a.centroid_percentile, a.pairwise_percentile, a.max_iter, parallel=a.parallel, seed=a.seed)
        _write(history, f"{a.out}/history")
    else:
        labels = clustering.kmeans(rows, a.vector, a.k, seed=a.seed)[0].select(a.id, "label")
    _write(labels, f"{a.out}/assignments")


def elbow(spark: SparkSession, a) -> None:
    _write(clustering.elbow(spark.read.parquet(a.input), a.vector, range(2, a.k + 1), a.seed), a.out)


def regress(spark: SparkSession, a) -> None:
    fit = regression.regression(spark.read.parquet(a.input), a.id, a.label, a.include_target, seed=a.seed)
    _write(fit.report, f"{a.out}/report")
    _write(fit.weights, f"{a.out}/weights")
    print(json.dumps(fit.metrics))


def evaluate(spark: SparkSession, a) -> None:
    grid = experiments.Grid(tuple(a.k_list), tuple(a.w_cl_list))
    _write(experiments.evaluate_grid(spark.read.parquet(a.input), a.id, a.vector, a.feature_key, a.doc, spark.read.parquet(a.labels), a.label, grid), a.out)


def cluster_lr(spark: SparkSession, a) -> None:
    read = spark.read.parquet
    got = regression.run_clusters(read(a.input), read(a.labels), a.doc, a.label_list, read(a.text_clusters) if a.text_clusters else None, a.target or None, a.out, seed=a.seed)
    _write(got, f"{a.out}/metrics")


def target_groups(spark: SparkSession, a) -> None:
    mets = spark.read.parquet(a.input).withColumnRenamed(a.id, "id")
    words, answers = providers.provider("words", a.words), providers.provider("answers", a.provider, task="groups", seed=a.seed)
    _write(groups.create_groups(mets, a.noun_type, a.dataset, words, answers, ks=range(a.k_min, a.k_max + 1), restarts=a.restarts), a.out)


def clean_groups(spark: SparkSession, a) -> None:
    _write(groups.clean_groups(spark.read.parquet(a.input), providers.provider("answers", a.provider, task="clean_groups", seed=a.seed)), a.out)


def train_classifier(spark: SparkSession, a) -> None:
    rows = relational.judged_only(spark.read.parquet(a.input), a.label, binary=a.binary)
    vectors = classifier.span_vectors(rows, a.id, a.text, a.word, providers.provider("words", a.words), providers.provider("embedder", a.embedder))
    labelled = vectors.join(rows.select(F.col(a.id).cast("string").alias("id"), a.label, *([a.group] if a.group else [])), "id")
    reports, scores = classifier.evaluate(labelled, "id", "v", a.label, a.folds, a.group or None, seed=a.seed)
    _write(reports, f"{a.out}/reports")
    _write(scores, f"{a.out}/scores")


def export_metaphors(spark: SparkSession, a) -> None:
    rows = spark.read.parquet(a.input).where(F.col(a.score) >= a.threshold)
    _write(sampling.draw(rows, a.id, a.sample, a.seed) if a.sample else rows, a.out)


def sample_scores(spark: SparkSession, a) -> None:
    done = spark.read.parquet(a.done).select(a.id) if a.done else None
    _write(sampling.draw_quota(spark.read.parquet(a.input), a.id, a.score, a.n, a.threshold, done, seed=a.seed), a.out)


def sample_targets(spark: SparkSession, a) -> None:
    """A sample of metaphors (noun_classification) with the group that their noun type's table has for them."""
    tables = {kind: spark.read.parquet(path) for kind, path in (g.split("=", 1) for g in a.groups)}
    _write(relational.lookup_by_kind(sampling.draw(spark.read.parquet(a.input), a.id, a.n, a.seed), "noun_classification", a.id, tables, ["target_group"]), a.out)


def word_clusters(spark: SparkSession, a) -> None:
    _write(clustering.word_clusters(spark.read.parquet(a.input), a.word, a.k, a.seed), a.out)


def create_tables(spark: SparkSession, a) -> None:
    results.create_tables(spark, a.out)


def intrusion_examples(spark: SparkSession, a) -> None:
    rows = metrics.with_distance(spark.read.parquet(a.input), "label", a.vector)
    n = a.total // 3
    counts = {"easy": n, "medium": n, "hard": a.total - 2 * n}
    out = intrusion.examples(rows, metrics.centroids(rows, "label", a.vector), a.id, "label", "d2", a.doc, a.text, counts, a.jaccard, a.seed)
    results.separate_export(intrusion.shown(out, rows, a.id, a.text), out, a.out)


def combine(spark: SparkSession, a) -> None:
    _write(experiments.combined_vectors(spark.read.parquet(a.input), spark.read.parquet(a.mets), a.doc, a.vector, a.dim, a.how), a.out)


def consolidate(spark: SparkSession, a) -> None:
    read = spark.read.parquet
    _write(features.metaphor_features(read(a.input), read(a.noun_types), [read(g) for g in a.groups], read(a.schemas), a.accepted), a.out)


def remove_null_results(spark: SparkSession, a) -> None:
    _write(annotate.drop_failed(spark.read.parquet(a.input)), a.out)


def remove_ads(spark: SparkSession, a) -> None:
    classes = relational.require_domain(spark.read.parquet(a.classes).select(a.id, "classification"), "classification", ("advertisement", "podcast"))
    _write(relational.keep_unlisted_or(spark.read.parquet(a.input), classes, [a.id], "classification", "podcast"), a.out)


def fix_ids(spark: SparkSession, a) -> None:
    rows = spark.read.parquet(a.input)
    rest = F.regexp_replace(F.col(a.id), "^[^_]*", "")
    _write(rows.withColumn(a.id, F.concat(ids.strip_episode_chunk(ids.document(F.col(a.id))), rest)), a.out)


def sample(spark: SparkSession, a) -> None:
    rows = spark.read.parquet(a.input)
    if a.strata:
        out = sampling.draw_stratified(rows, a.strata, a.id, a.n, a.n_strata, a.seed)
    else:
        out = sampling.draw_each(rows, a.by, a.id, a.n, a.seed) if a.by else sampling.draw(rows, a.id, a.n, a.seed)
    _write(out, a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tropelake")
    sub = top.add_subparsers(dest="command", required=True)

    def add(run, *options: tuple) -> None:
        p = sub.add_parser(run.__name__.replace("_", "-"))
        p.add_argument("input")
        p.add_argument("out")
        p.add_argument("--id", default="id")
        p.add_argument("--seed", type=int, default=42)
        for name, kind, default in options:
            flag = f"--{name.replace('_', '-')}"
            if kind is bool:
                p.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                p.add_argument(flag, type=kind, nargs="+", default=default)
            else:
                p.add_argument(flag, type=kind, default=default)
        p.set_defaults(run=run)

    vector, keys = ("vector", str, "emb"), ("feature_key", str, ["noun_classification", "target_group", "source_image_schema_group"])
    add(candidates, ("text", str, "text"), ("limit", int, 42_000), ("sample", int, 0), ("all_paths", bool, False), ("parser", str, ""))
    add(annotate_task, ("task", str, "metaphor_class"), ("prompt_file", str, ""), ("shots", int, 0), ("done", str, ""), ("sample", int, 0), ("retries", int, 5), ("workers", int, 8), ("provider", str, ""), ("save_every", int, 100), ("config", str, ""), ("after", str, ""), ("only", str, ""))
    add(embed, ("text", str, "text"), ("dim", int, 64), ("kind", str, "document"), ("embedder", str, ""))
    add(cannot_link, keys, ("pairs", bool, False))
    add(cluster, vector, keys, ("k", int, 100), ("use_pckmeans", bool, False), ("w_cl", float, 0.01), ("skip_init", bool, False), ("centroid_percentile", float, None), ("pairwise_percentile", float, None), ("max_iter", int, 100), ("parallel", bool, False))
    add(elbow, vector, ("k", int, 30))
    add(regress, ("label", str, "polarity"), ("include_target", bool, False))
    add(evaluate, vector, keys, ("labels", str, ""), ("doc", str, "doc_id"), ("label", str, "polarity"), ("k_list", int, list(range(25, 301, 25))), ("w_cl_list", float, [0.01, 0.05, 0.1]))
    add(intrusion_examples, vector, ("doc", str, "doc_id"), ("text", str, "text"), ("total", int, 150), ("jaccard", float, 0.6))
    add(combine, vector, ("mets", str, ""), ("doc", str, "doc_id"), ("dim", int, 64), ("how", str, "concat"))
    add(consolidate, ("noun_types", str, ""), ("groups", str, []), ("schemas", str, ""), ("accepted", str, []))
    add(cluster_lr, ("labels", str, ""), ("doc", str, "doc_id"), ("label_list", str, ["polarity"]), ("text_clusters", str, ""), ("target", str, ""))
    add(target_groups, ("noun_type", str, "person"), ("dataset", str, "podcasts"), ("words", str, ""), ("provider", str, ""), ("k_min", int, 5), ("k_max", int, 15), ("restarts", int, 50))
    add(clean_groups, ("provider", str, ""))
    add(train_classifier, ("text", str, "text"), ("word", str, "source_word"), ("label", str, "human_metaphor_score"), ("binary", bool, False), ("folds", int, 5), ("group", str, ""), ("words", str, ""), ("embedder", str, ""))
    add(export_metaphors, ("score", str, "llm_met_score"), ("threshold", float, 0.4), ("sample", int, 0))
    add(sample_scores, ("score", str, "llm_met_score"), ("threshold", float, 0.4), ("n", int, 200), ("done", str, ""))
    add(sample_targets, ("n", int, 100), ("groups", str, []))
    add(word_clusters, ("word", str, "word"), ("k", int, 20))
    add(create_tables)
    add(remove_null_results)
    add(remove_ads, ("classes", str, ""))
    add(fix_ids)
    add(sample, ("n", int, 100), ("by", str, []), ("strata", str, ""), ("n_strata", int, 11))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or session(), a)


if __name__ == "__main__":
    main()
