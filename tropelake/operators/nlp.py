"""Sentences, tokens, dependency edges and the path grammar that finds source-target pairs.

Parsers are providers: functions from an iterator of frames (doc_id, text) to frames of nested sentences.  The stub
provider is deterministic and needs no model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOUNS = ("NOUN", "PROPN", "PRON")
#: The path grammar.  Slots are S(ource), T(arget) or neither, with a part of speech, and between them the dependency of the edge.
GRAMMAR = {
    0: "S_NOUN prep ADP pobj T_NOUN",
    1: "S_VERB dobj T_NOUN",
    2: "T_NOUN nsubj S_VERB",
    3: "T_NOUN compound S_NOUN",
    4: "S_ADJ amod T_NOUN",
    5: "T_NOUN nsubj AUX attr S_NOUN",
    6: "S_VERB agent ADP pobj T_NOUN",
    7: "S_VERB amod T_NOUN",
    8: "S_NOUN compound T_NOUN",
    9: "T_NOUN nsubjpass S_VERB",
    10: "T_NOUN nsubj AUX acomp S_ADJ",
    11: "T_NOUN poss S_NOUN",
}
VERB_PATHS = (1, 2, 6, 7, 9)

PARSED = "doc_id STRING, sentences ARRAY<STRUCT<sent_idx: INT, text: STRING, start_char: INT, end_char: INT, tokens: ARRAY<STRUCT<tok_idx: INT, text: STRING, pos: STRING, start_char: INT, end_char: INT, head: INT, dep: STRING>>>>"

#: Fixed values of the stub tagger.
STUB_PRONOUNS = "i you he she it we they this that these those who".split()
STUB_FUNCTION = {"the": "DET", "a": "DET", "an": "DET", "of": "ADP", "by": "ADP", "in": "ADP", "on": "ADP", "with": "ADP", "is": "AUX", "are": "AUX", "was": "AUX", "were": "AUX", "and": "CCONJ", "or": "CCONJ", "not": "PART", "to": "PART"}


_TEXTS = pa.schema([("doc_id", pa.string()), ("text", pa.string())])
#: Characters of texts that a parser is given at once, so that a worker's memory does not grow with the number of documents.
PARSED_AT_ONCE = 1 << 18


_KINDS = ("PUNCT", "PRON", "VERB", "NOUN", *dict.fromkeys(STUB_FUNCTION.values()))
_DEPS = ("root", "nsubj", "dobj", "pobj", "agent", "prep", "dep")


class _Kinds(dict):
    """Place in ``_KINDS`` by word, worked out once for each word."""

    def __missing__(self, word: str) -> int:
        w = word.lower()
        pos = "PUNCT" if not w[0].isalnum() and w[0] != "_" else "PRON" if w in STUB_PRONOUNS else STUB_FUNCTION.get(w) or ("VERB" if w.endswith(("ed", "ing")) else "NOUN")
        self[word] = _KINDS.index(pos)
        return self[word]


def _stub_sentences(texts: Iterable[str | None]) -> pa.ListArray:
    """The nested sentences of each text, made column by column: an object for each token would cost some ten times the memory."""
    begin, end, token = re.compile(r"\S"), re.compile(r"[.!?](?=\s|$)"), re.compile(r"(\w+|[^\w\s])")
    words, lengths, docs, n_words = [], [], [0], []
    numbers, bodies, starts, stops = [], [], [], []
    for text in texts:
        text = text or ""
        parts = token.split(text)  # blanks and tokens by turns
        words += parts[1::2]
        n_words.append(len(parts) // 2)
        lengths += map(len, parts)
        n, m = 0, begin.search(text)
        while m:
            a = m.start()
            m = end.search(text, a + 1)
            b = m.end() if m else len(text) - text.endswith("\n")
            bodies.append(text[a:b])
            numbers.append(n)
            starts.append(a)
            stops.append(b)
            n, m = n + 1, begin.search(text, b)
        docs.append(len(numbers))
    ints, strings = (lambda v: pa.array(v, pa.int32())), (lambda v: pa.array(v, pa.string()))
    n_words, n = np.array(n_words, np.int64), np.array(lengths, np.int64)
    after, n_parts = np.cumsum(n), 2 * n_words + 1  # places in all texts, one after the other
    opens = np.cumsum(n_parts) - n_parts
    base = after[opens] - n[opens]  # each text's
    is_word = (np.arange(len(n)) - np.repeat(opens, n_parts)) % 2 == 1
    stop = after[is_word]
    start = stop - n[is_word]
    first = np.searchsorted(start, np.array(starts, np.int64) + np.repeat(base, np.diff(docs)))  # each sentence's first token
    ends = np.append(first, len(words))
    size = np.diff(ends)
    all_, own = np.arange(len(words)), np.repeat(base, n_words)
    nth = all_ - np.repeat(first, size)
    kind = np.fromiter(map(_Kinds().__getitem__, words), np.int8, len(words))
    is_ = lambda *tags: np.isin(kind, [_KINDS.index(t) for t in tags if t in _KINDS])
    verb, noun, adp = np.append(is_("VERB"), False), is_(*NOUNS), is_("ADP")
    to_verb = np.where(verb, np.arange(len(verb)), len(verb))[::-1]
    to_verb = np.minimum.accumulate(to_verb)[::-1][first] - first
    root = np.repeat(np.where(to_verb < size, to_verb, 0), size)
    is_root = nth == root
    last = np.maximum.accumulate(np.where(noun | adp | is_root, all_, -1), dtype=np.int64)
    last = np.append(-1, last)[: len(words)]  # the last noun, preposition or root before each token
    hinged = (last >= all_ - nth) & (last >= 0) & np.append(adp & ~is_root, False)[last]
    by = is_root, noun & hinged, noun, adp
    head = np.select(by, (-1, nth - (all_ - last), root, root), np.where(nth > 0, nth - 1, root))
    agent = np.zeros(len(words), bool)
    agent[adp] = [words[i].lower() == "by" for i in np.flatnonzero(adp)]
    dep = np.select(by, (0, 3, np.where(nth < root, 1, 2), np.where(agent, 4, 5)), 6)
    named = lambda codes, names: strings(names).take(pa.array(codes, pa.int32()))
    fields = {"tok_idx": ints(nth), "text": strings(words), "pos": named(kind, _KINDS), "start_char": ints(start - own), "end_char": ints(stop - own), "head": ints(head), "dep": named(dep, _DEPS)}
    tokens_ = pa.ListArray.from_arrays(ints(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    fields = {"sent_idx": ints(numbers), "text": strings(bodies), "start_char": ints(starts), "end_char": ints(stops), "tokens": tokens_}
    return pa.ListArray.from_arrays(ints(docs), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def stub_parser(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sentences end at ``.!?`` and whitespace or at the end; words ending in -ed or -ing are verbs, other words nouns or from a short list.

    Heads: the first verb is the root; nouns before it are its subjects, nouns after it its objects, unless a
    preposition stands between, on which they then hang; everything else hangs on its neighbour.
    """
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["doc_id"], "sentences": _stub_sentences(frame["text"]).to_pylist()})


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in order, ``PARSED_AT_ONCE`` characters of ``text`` at a time; a longer text comes by itself."""
    for batch in batches:
        n = np.asarray(pc.fill_null(pc.utf8_length(batch.column("text")), 0), np.int64)
        first, chars = 0, 0
        for k, more in enumerate(n.tolist()):
            if k > first and chars + more > PARSED_AT_ONCE:
                yield batch.slice(first, k - first)
                first, chars = k, 0
            chars += more
        if first < len(n):
            yield batch.slice(first)


def parse(docs: DataFrame, ident: str, text: str, parser: Callable = stub_parser, workers: int | None = None) -> DataFrame:
    """Parsed documents: ``doc_id`` and nested ``sentences``.  Null and empty texts have none.

    Parsing costs far more than moving texts: with ``workers`` they are spread over that many tasks, however few files they come from.
    A parser gets its frames in portions of ``PARSED_AT_ONCE`` characters.
    """
    rows = docs.select(F.col(ident).cast("string").alias("doc_id"), F.col(text).alias("text"))
    if workers:
        rows = rows.repartition(workers, "doc_id")
    if parser is stub_parser:  # its columns go out as they are, not by way of objects

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _portions(batches):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _stub_sentences(part.column("text").to_pylist())], ["doc_id", "sentences"])

        return rows.mapInArrow(run, PARSED)

    def given(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return parser(part.to_pandas() for part in _portions(pa.RecordBatch.from_pandas(f, _TEXTS, preserve_index=False) for f in frames))

    return rows.mapInPandas(given, PARSED)


def sentences(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.sent_idx", "s.text", "s.start_char", "s.end_char", F.size("s.tokens").alias("num_tokens"))


def tokens(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.sent_idx", F.explode("s.tokens").alias("t")).select("doc_id", "sent_idx", "t.*")


def candidate_sentences(tokens_: DataFrame) -> DataFrame:
    """Sentences with a verb and a noun, proper noun or pronoun."""
    flags = tokens_.groupBy("doc_id", "sent_idx").agg(F.bool_or(F.col("pos") == "VERB").alias("verb"), F.bool_or(F.col("pos").isin(*NOUNS)).alias("noun"))
    return flags.where("verb AND noun").select("doc_id", "sent_idx")


def grammar(spark: SparkSession, verbs_only: bool = True) -> DataFrame:
    """The grammar as a table: slots n1, n2, n3 (parts of speech without their role), edges d1, d2 and where source and target stand."""
    rows = []
    for path, text in GRAMMAR.items():
        if verbs_only and path not in VERB_PATHS:
            continue
        parts = text.split()
        slots, deps = parts[::2], parts[1::2]
        bare = [s.split("_")[-1] for s in slots]
        where = {s[0]: i + 1 for i, s in enumerate(slots) if "_" in s}
        rows.append((path, len(slots), *bare, *[None] * (3 - len(bare)), *deps, *[None] * (2 - len(deps)), where["S"], where["T"]))
    return spark.createDataFrame(rows, "path_id INT, len INT, n1 STRING, n2 STRING, n3 STRING, d1 STRING, d2 STRING, s_at INT, t_at INT")


def grammar_bounds(verbs_only: bool = True) -> tuple[list[str], list[str]]:
    """The dependencies and the parts of speech of middle tokens that occur in the grammar."""
    parts = [text.split() for path, text in GRAMMAR.items() if not verbs_only or path in VERB_PATHS]
    return sorted({d for p in parts for d in p[1::2]}), sorted({p[2] for p in parts if len(p) == 5})


def sentence_tokens(parsed: DataFrame) -> DataFrame:
    """``doc_id``, ``sent_idx`` and ``t``, the sentence's tokens in order: no shuffle, as they are nested already."""
    return parsed.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.sent_idx", F.col("s.tokens").alias("t"))


def tokens_by_sentence(tokens_: DataFrame) -> DataFrame:
    """The same from a table of tokens, whose places in a sentence run from 0 without gaps."""
    return tokens_.groupBy("doc_id", "sent_idx").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "pos", "head", "dep"))).alias("t"))


def is_candidate(t: Column) -> Column:
    """Whether a sentence has a verb and a noun, proper noun or pronoun."""
    return F.exists(t, lambda x: x["pos"] == "VERB") & F.exists(t, lambda x: x["pos"].isin(*NOUNS))


def paths(sents: DataFrame, verbs_only: bool = False) -> DataFrame:
    """Dependency paths of two and three tokens between tokens in sentence order, worked out inside each row.

    A parse is a tree, so a path of one or two edges is the only and the shortest one; the grammar needs no longer.
    Ends must be verbs or nouns.  Only edges and middle tokens that some pattern has are looked at, so a token with many
    dependents makes no pairs of them.
    """
    deps, middles = grammar_bounds(verbs_only)
    none, t = F.lit(None), F.col("t")
    step = lambda p, q, d1, d2, m, pm: F.struct(p["tok_idx"].alias("x"), m.cast("int").alias("y"), q["tok_idx"].alias("z"), d1.alias("d1"), d2.cast("string").alias("d2"), p["pos"].alias("p_x"), pm.cast("string").alias("p_y"), q["pos"].alias("p_z"))
    up = lambda x: F.get(t, x["head"])

    def edge(x: Column) -> Column:
        return F.when(x["tok_idx"] < x["head"], step(x, up(x), x["dep"], none, none, none)).otherwise(step(up(x), x, x["dep"], none, none, none))

    def around(m: Column) -> Column:
        node = lambda x, dep: F.struct(x["tok_idx"].alias("tok_idx"), x["pos"].alias("pos"), dep.alias("dep"))
        below = F.transform(F.filter(t, lambda x: x["head"] == m["tok_idx"]), lambda x: node(x, x["dep"]))
        above = F.filter(F.array(node(up(m), m["dep"])), lambda x: x["tok_idx"].isNotNull())
        near = F.filter(F.concat(below, above), lambda x: x["dep"].isin(deps))
        return F.struct(m["tok_idx"].alias("tok_idx"), m["pos"].alias("pos"), near.alias("near"))

    def pairs(m: Column) -> Column:
        later = lambda p: F.filter(m["near"], lambda q: q["tok_idx"] > p["tok_idx"])
        return F.flatten(F.transform(m["near"], lambda p: F.transform(later(p), lambda q: step(p, q, p["dep"], q["dep"], m["tok_idx"], m["pos"]))))

    two = F.transform(F.filter(t, lambda x: (x["head"] >= 0) & (x["head"] != x["tok_idx"]) & x["dep"].isin(deps)), edge)
    three = F.flatten(F.transform(F.transform(F.filter(t, lambda x: x["pos"].isin(middles)), around), pairs))
    ends = ("VERB", *NOUNS)
    good = F.filter(F.concat(two, three), lambda p: p["p_x"].isin(*ends) & p["p_z"].isin(*ends))
    return sents.select("doc_id", "sent_idx", F.explode(good).alias("p")).select("doc_id", "sent_idx", "p.*")


def match_paths(found: DataFrame, rules: DataFrame) -> DataFrame:
    """``source`` and ``target`` token and ``path_id`` for every rule a path satisfies; the grammar is a fixed table of a dozen rows."""
    fits = lambda pos, want: (F.col(want) == F.col(pos)) | ((F.col(want) == "NOUN") & F.col(pos).isin(*NOUNS))
    joined = found.join(F.broadcast(rules.withColumnsRenamed({"d1": "g1", "d2": "g2"})), (F.col("d1") == F.col("g1")) & F.col("d2").eqNullSafe(F.col("g2")))
    last = F.when(F.col("len") == 2, fits("p_z", "n2")).otherwise(fits("p_y", "n2") & fits("p_z", "n3"))
    at = lambda c: F.when(F.col(c) == 1, F.col("x")).otherwise(F.col("z"))
    return joined.where(fits("p_x", "n1") & last).select("doc_id", "sent_idx", at("s_at").alias("source"), at("t_at").alias("target"), "path_id")


def candidate_pairs(matched: DataFrame) -> DataFrame:
    """One row per source-target pair with the ids of its paths."""
    from ..functions.ids import compose

    pairs = matched.groupBy("doc_id", "sent_idx", "source", "target").agg(F.sort_array(F.collect_set("path_id")).alias("met_paths"))
    return pairs.withColumn("met_id", compose(*[F.col(c) for c in ("doc_id", "sent_idx", "source", "target")]))


def path_errors(tokens_: DataFrame) -> DataFrame:
    """Counts of sentences that give no paths, by kind of error."""
    per = tokens_.groupBy("doc_id", "sent_idx").agg(F.count_if(F.col("head") >= 0).alias("edges"), F.count_if(F.col("head") == F.col("tok_idx")).alias("loops"), F.count("*").alias("n"))
    kind = F.when(F.col("loops") > 0, "token is its own head").when(F.col("edges") == 0, "no edges").when(F.col("edges") < F.col("n") - 1, "no path between parts")
    return per.withColumn("error", kind).where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))


def one_mention_per_sentence(mentions: DataFrame) -> DataFrame:
    """The first mention of each chain in each sentence, numbered within its chain."""
    w = Window.partitionBy("chain_id", "sent_idx").orderBy("start_tok", "end_tok")
    rows = mentions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return rows.withColumn("mention_idx", F.row_number().over(Window.partitionBy("chain_id").orderBy("sent_idx", "start_tok")) - 1)


def representative(targets: DataFrame, mentions: DataFrame, chains: DataFrame) -> DataFrame:
    """The text that stands for each target token: of the mentions that hold it the last one's chain, else null.  Token places are numbers; ends are included."""
    inside = targets.join(mentions, (targets.doc_id == mentions.doc_id) & (targets.sent_idx == mentions.sent_idx) & targets.target.between(mentions.start_tok, mentions.end_tok)).select(targets.met_id, mentions.chain_id, mentions.start_tok, mentions.end_tok)
    last = inside.groupBy("met_id").agg(F.max_by("chain_id", F.struct("start_tok", "end_tok", "chain_id")).alias("chain_id"))
    return targets.join(last, "met_id", "left").join(chains.select("chain_id", "representative_text"), "chain_id", "left").drop("chain_id")


def representatives(targets: Column, mentions: Column, chains: Column) -> Column:
    """What ``representative`` gives, inside a row and without a join: ``target`` and ``representative_text`` for each of a sentence's ``targets``.

    ``mentions`` are the sentence's, structs with ``start_tok``, ``end_tok`` and ``chain_id``; ``chains`` is a map from chains to their texts.
    """

    def text(r: Column, i: Column) -> Column:
        held = F.filter(r["mentions"], lambda m: i.between(m["start_tok"], m["end_tok"]))
        last = F.array_max(F.transform(held, lambda m: F.struct(m["start_tok"].alias("a"), m["end_tok"].alias("b"), m["chain_id"].alias("chain_id"))))
        return F.try_element_at(r["chains"], last["chain_id"])

    once = F.array(F.struct(targets.alias("targets"), mentions.alias("mentions"), chains.alias("chains")))  # not worked out again for each target
    return F.flatten(F.transform(once, lambda r: F.transform(r["targets"], lambda i: F.struct(i.alias("target"), text(r, i).alias("representative_text")))))


def token_span(tokens_: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """First and last token that overlaps a span of characters (ends exclusive)."""
    from .relational import overlapping

    met = overlapping(spans, tokens_, on, ("span_start", "span_end"), ("start_char", "end_char"))
    return met.groupBy(*on, "span_start", "span_end").agg(F.min("tok_idx").alias("first_tok"), F.max("tok_idx").alias("last_tok"))


def path_scores(pairs: DataFrame, ident: str, text: str, provider: Callable) -> DataFrame:
    """``id`` and ``score`` of each candidate path from a scoring provider."""
    rows = pairs.select(F.col(ident).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(provider, "id STRING, score DOUBLE")


def retokenized(sents: DataFrame, ident: str, text: str, parser: Callable = stub_parser) -> DataFrame:
    """The tokens of sentences parsed by themselves; of a text that is more than one sentence, the first.  Without one there are no rows."""
    first = parse(sents, ident, text, parser).select("doc_id", F.get("sentences", F.lit(0)).alias("s")).where("s IS NOT NULL")
    return first.select("doc_id", F.explode("s.tokens").alias("t")).select("doc_id", "t.*")


def pair_errors(sents: DataFrame) -> DataFrame:
    """Counts of token pairs of sentences without a path between them, by kind of error, and of all pairs (``pairs``).

    A sentence's tokens and heads make a forest; pairs in different trees have no path.  Trees are found in the row, so
    pairs are counted from tree sizes and never listed.
    """
    t = F.col("t")
    up = lambda r: F.transform(r, lambda x: F.get(r, x))
    root = F.transform(t, lambda x: F.when((x["head"] < 0) | (x["head"] >= F.size(t)), x["tok_idx"]).otherwise(x["head"]))
    jumps = sents.withColumn("r", root)
    for _ in range(8):  # heads of heads: up to 2^8 steps to the root
        jumps = jumps.withColumn("r", up(F.col("r")))
    sizes = F.transform(F.array_distinct("r"), lambda a: F.size(F.filter("r", lambda b: b == a)).cast("long"))
    pairs = lambda n: n * (n - 1) / 2
    per = jumps.select(F.size("t").cast("long").alias("n"), F.aggregate(sizes, F.lit(0.0), lambda s, n: s + pairs(n)).alias("joined"), F.exists(t, lambda x: x["head"] == x["tok_idx"]).alias("loop"))
    one = per.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(pairs(F.col("n")) - F.col("joined")), F.lit(0)).cast("long").alias("no path between parts"), F.coalesce(F.count_if("loop"), F.lit(0)).alias("sentences with a loop"))
    return one.unpivot([], one.columns, "error", "n")
