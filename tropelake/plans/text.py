"""Text queries: cleaning, filters, identifiers, prompts, spans, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import features, intrusion, nlp, providers, relational
from ..session import spread
from .registry import query, table

SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SP}', ' ', 'g'))"


CLEAN = collapse(f"translate(lower(text), '{PUNCT}', '')")
N_WORDS = f"len(list_filter(string_split({collapse('text')}, ' '), lambda w: w <> ''))"


@query(f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT id, {CLEAN} = clean_text AS same FROM doc_store")
def clean_text_agrees(spark, sf):
    return table(spark, sf, "doc_store").select("id", (T.clean_text(F.col("text")) == F.col("clean_text")).alias("same"))


@query(f"SELECT doc_id, CAST({N_WORDS} AS INTEGER) AS n_words FROM documents WHERE {N_WORDS} > 30 AND {N_WORDS} < 200")
def word_count_filter(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.where(T.words_between(F.col("text"), 30, 200)).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(r"SELECT id, md5(regexp_replace(text, '(?i)(?:&#160;)(?:\W*&#160;)+', '&#160;', 'g')) AS digest FROM doc_store")
def nbsp_collapse(spark, sf):
    return table(spark, sf, "doc_store").select("id", F.md5(T.collapse_nbsp(F.col("text"))).alias("digest"))


@query(f"""
WITH w AS (SELECT source, doc_id, unnest(list_filter(string_split({CLEAN}, ' '), lambda w: w <> '')) AS w FROM documents),
d AS (SELECT source, doc_id, count(*) AS n, count(DISTINCT w) AS u FROM w GROUP BY ALL)
SELECT source, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words, round(avg(n), 6) AS mean_words, round(avg(u), 6) AS mean_distinct FROM d GROUP BY source""")
def token_statistics(spark, sf):
    """Documents, words and mean words and distinct words per document of every source; each text is cleaned once."""
    words = spread(table(spark, sf, "documents").select("source", "text")).select("source", T.words(T.clean_text(F.col("text"))).alias("w"))
    sizes = words.select("source", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("u"))
    some = F.count_if(F.col("n") > 0)
    means = [F.round(F.sum(F.when(F.col("n") > 0, F.col(c))) / some, 6).alias(name) for c, name in (("n", "mean_words"), ("u", "mean_distinct"))]
    return sizes.groupBy("source").agg(some.alias("n_docs"), F.sum(F.when(F.col("n") > 0, F.col("n"))).alias("n_words"), *means).where("n_docs > 0")


@query("""
SELECT id, string_split(id, '_')[1] AS doc, CAST(string_split(id, '_')[2] AS INTEGER) AS sent, CAST(string_split(id, '_')[3] AS INTEGER) AS src, CAST(string_split(id, '_')[4] AS INTEGER) AS tgt
FROM llm_met_scores""")
def id_split(spark, sf):
    i = F.col("id")
    return table(spark, sf, "llm_met_scores").select("id", ids.document(i).alias("doc"), ids.sentence(i).alias("sent"), ids.source_token(i).alias("src"), ids.target_token(i).alias("tgt"))


@query("SELECT DISTINCT doc_id, regexp_replace(doc_id, '-[^-]*$', '') AS stripped, regexp_replace(doc_id, '^(.{36})-[0-9]+$', '\\1') AS episode FROM llm_met_scores")
def id_strip_suffix(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "llm_met_scores").select("doc_id", ids.strip_chunk(d).alias("stripped"), ids.strip_episode_chunk(d).alias("episode")).distinct()


@query("SELECT DISTINCT id, regexp_replace(id, '_[^_]*$', '') AS sentence_token FROM llm_met_scores")
def id_parent(spark, sf):
    return table(spark, sf, "llm_met_scores").select("id", ids.parent(F.col("id")).alias("sentence_token")).distinct()


@query("""
SELECT id, 'Is the verb metaphorical?' || chr(10) || 'Source Word: ' || coalesce(source_word, '') || chr(10) || 'Target Word: ' || coalesce(target_word, '') || chr(10) || 'Sentence: ' || coalesce(sentence, '') AS prompt
FROM llm_met_scores""")
def prompt_template(spark, sf):
    from ..operators.annotate import prompt

    p = prompt("metaphor_class", "Is the verb metaphorical?", source_word=F.col("source_word"), target_word=F.col("target_word"), sentence=F.col("sentence"))
    return table(spark, sf, "llm_met_scores").select("id", p.alias("prompt"))


@query("""
WITH p AS (SELECT id, 'Source Word: ' || source_word || chr(10) || 'Sentence: ' || sentence AS t FROM llm_met_scores)
SELECT id, substr(t, strpos(t, 'Sentence: ') + 10) AS sentence FROM p""")
def sentence_after_marker(spark, sf):
    t = T.fill("Source Word: {a}\nSentence: {b}", a=F.col("source_word"), b=F.col("sentence"))
    return table(spark, sf, "llm_met_scores").select("id", T.after_marker(t, "Sentence: ").alias("sentence"))


@query("""
WITH t AS (SELECT id, source_word, target_word, replace(sentence, source_word, '<LmSource>' || source_word || '</LmSource>') AS x FROM llm_met_scores),
p AS (SELECT id, regexp_extract(x, '(?s)^(.*?)<LmSource[^>]*>(.*?)</LmSource>', 1) AS a, regexp_extract(x, '(?s)^(.*?)<LmSource[^>]*>(.*?)</LmSource>', 2) AS w FROM t)
SELECT id, CASE WHEN w <> '' THEN w END AS word, CASE WHEN w <> '' THEN CAST(length(a) AS INTEGER) END AS start_char, CASE WHEN w <> '' THEN CAST(length(a) + length(w) AS INTEGER) END AS end_char FROM p""")
def tag_span_extract(spark, sf):
    tagged = F.replace(F.col("sentence"), F.col("source_word"), F.concat(F.lit("<LmSource>"), "source_word", F.lit("</LmSource>")))
    word, start, end = T.span_of(F.col("x"), "LmSource")
    return table(spark, sf, "llm_met_scores").select("id", tagged.alias("x")).select("id", word.alias("word"), start.alias("start_char"), end.alias("end_char"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k INT").getField("k").alias("k"))


GROUPS = ("Immigrants", "Police", "Families", "Voters", "Clinics", "Courts", "Media", "Gun Owners", "Politicians")
_IN = ", ".join(f"'{g}'" for g in GROUPS)
_SHORT = "string_split(string_split(target_group, ':')[1], ' (e.g.,')[1]"


@query(f"SELECT met_id, exported_at, CASE WHEN target_group IS NULL THEN NULL WHEN {_SHORT} IN ({_IN}) THEN {_SHORT} ELSE 'Other' END AS target_group FROM clust_export")
def label_sanitize(spark, sf):
    return table(spark, sf, "clust_export").select("met_id", "exported_at", T.sanitize_label(F.col("target_group"), list(GROUPS)).alias("target_group"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'es') THEN lang WHEN contains(lang, 'en') THEN 'en' WHEN contains(lang, 'es') THEN 'es' ELSE 'invalid' END AS lang FROM documents")
def enum_when(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_contained(F.col("lang"), ["en", "es"]).alias("lang"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 150000 THEN 'left' ELSE 'right' END AS polarity FROM orders")
def polarity_bucket(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") <= 150000, "left").otherwise("right").alias("polarity"))


@query(r"""
SELECT DISTINCT episode, CASE WHEN regexp_full_match(translate(string_split(episode_date, 'T')[1], '/', '-'), '\d{4}-\d{2}-\d{2}') THEN year(try_cast(translate(string_split(episode_date, 'T')[1], '/', '-') AS DATE))::INTEGER END AS year FROM episodes""")
def year_parse(spark, sf):
    return table(spark, sf, "episodes").select("episode", T.year_of(F.col("episode_date")).alias("year")).distinct()


@query("""
SELECT id, CAST(trunc(try_cast(annotation_value AS DOUBLE)) AS INTEGER) AS score FROM doc_annotations WHERE annotation_type = 'human_metaphor_score'""")
def score_parse(spark, sf):
    rows = table(spark, sf, "doc_annotations").where("annotation_type = 'human_metaphor_score'")
    return rows.select("id", T.parse_score(F.col("annotation_value")).alias("score"))


@query("""
WITH g AS (SELECT document_id, list(annotation_value ORDER BY annotation_value) FILTER (annotation_value IS NOT NULL) AS v FROM doc_annotations WHERE annotation_type = 'polarity' GROUP BY document_id)
SELECT document_id, CASE WHEN len(list_distinct(v)) = 1 THEN v[1] END AS polarity FROM g""")
def unanimous_label(spark, sf):
    rows = table(spark, sf, "doc_annotations").where("annotation_type = 'polarity'").groupBy("document_id").agg(F.collect_set("annotation_value").alias("v"))
    return rows.select("document_id", T.unanimous(F.col("v")).alias("polarity"))


_WORDSET = "list_filter(list_distinct(string_split(" + collapse("lower(sentence)") + ", ' ')), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], w))"


@query(f"""
WITH s AS (SELECT doc_id, list_sort({_WORDSET}) AS w, min(id) AS id, count(DISTINCT id) AS n FROM llm_met_scores WHERE sentence IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL HAVING len(w) > 0)
SELECT a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 9) AS jaccard
FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.id < b.id AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.8""")
def jaccard_pairs(spark, sf):
    """Pairs of different word sets of one document's sentences with a similarity of 0.8 or more; a word set is named by its smallest id and has the number of its ids."""
    rows = table(spark, sf, "llm_met_scores").where("sentence IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "id", F.array_sort(T.word_set(F.col("sentence"))).alias("w"))
    sets = rows.groupBy("doc_id", "w").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n"))
    return intrusion.similar_sets(sets, "doc_id", "id", "w", 0.8, ["n"]).select("id_a", "id_b", "n_a", "n_b", F.round("jaccard", 9).alias("jaccard"))


@query("""
SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS sent_idx, u.s AS sentence FROM (SELECT doc_id, unnest(list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda z: z[1] <> ''), lambda z: {'s': z[1], 'i': z[2]})) AS u
FROM (SELECT doc_id, string_split(text, '. ') AS x FROM documents))""")
def sentence_explode(spark, sf):
    """Pieces between ends of sentences with their place."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("sent_idx", "sentence"))
    return rows.where("sentence <> ''")


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS tok_idx, w AS token FROM (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(string_split({CLEAN}, ' '), lambda w: w <> '') AS x FROM documents))")
def token_explode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.words(T.clean_text(F.col("text")))).alias("tok_idx", "token"))


def parsed_documents(spark, sf):
    """Parsed in as many tasks as the session has partitions for shuffles."""
    return nlp.parse(table(spark, sf, "documents"), "doc_id", "text", workers=int(spark.conf.get("spark.sql.shuffle.partitions")))


_EDGE = rf"(?s)^{SP}|{SP}$"


@query(rf"""
WITH RECURSIVE store AS (SELECT DISTINCT id, text FROM doc_store WHERE text IS NOT NULL),
part AS (
  SELECT id, text, 0 AS no, 0 AS s, 0 AS e, false AS done FROM store
  UNION ALL
  SELECT id, text, no + 1, stop, stop, last FROM (
    SELECT id, text, no, length(text) - s <= 42000 AS last, CASE WHEN length(text) - s <= 42000 THEN length(text) ELSE s + CASE WHEN a > 0 THEN a WHEN b > 0 THEN b WHEN c > 0 THEN c ELSE 42000 END END AS stop
    FROM (SELECT *, length(regexp_extract(w, '(?s)^(.*[.!?]{SP})', 1)) AS a, length(regexp_extract(w, '(?s)^(.*[,;:-]{SP})', 1)) AS b, length(regexp_extract(w, '(?s)^(.* )', 1)) AS c
          FROM (SELECT *, substr(text, s + 1, 42000) AS w FROM part WHERE NOT done)))
),
cut AS (SELECT id, text, no, s, lead(e) OVER (PARTITION BY id, md5(text) ORDER BY no) AS e FROM part),
chunk AS (SELECT id, CAST(no AS INTEGER) AS chunk_idx, CASE WHEN length(text) <= 42000 THEN text ELSE regexp_replace(substr(text, s + 1, e - s), '{_EDGE}', '', 'g') END AS c FROM cut WHERE e IS NOT NULL)
SELECT id, chunk_idx, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS digest FROM chunk""")
def chunk_text(spark, sf):
    """Chunks of at most 42 000 characters of every text, with their place."""
    cut = T.chunks(42_000)
    rows = table(spark, sf, "doc_store").select("id", "text").distinct()
    return rows.select("id", F.posexplode(cut(F.col("text"))).alias("chunk_idx", "chunk")).select("id", "chunk_idx", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query(r"""
WITH p AS (SELECT id, sentence AS t, lower(target_word) AS w, unnest(range(length(sentence) - length(target_word) + 1)) AS i FROM llm_met_scores WHERE length(target_word) > 0)
SELECT id, CAST(i AS INTEGER) AS start, CAST(i + length(w) AS INTEGER) AS "end" FROM p WHERE lower(substr(t, CAST(i AS BIGINT) + 1, length(w))) = w
AND NOT regexp_matches(substr(t, CAST(i AS BIGINT), CASE WHEN i > 0 THEN 1 ELSE 0 END), '[\p{L}\p{N}_]') AND NOT regexp_matches(substr(t, CAST(i AS BIGINT) + length(w) + 1, 1), '[\p{L}\p{N}_]')""")
def word_span_places(spark, sf):
    rows = table(spark, sf, "llm_met_scores").select("id", T.word_spans("sentence", "target_word").alias("s"))
    return rows.select("id", F.explode("s").alias("s")).select("id", "s.start", "s.end")


@query("SELECT DISTINCT target_group AS label, CASE WHEN x IN ('immigrants', 'police', 'u.s. country') THEN x WHEN x IS NOT NULL THEN 'other' END AS clean FROM (SELECT target_group, replace(lower(trim(target_group)), 'u.s country', 'u.s. country') AS x FROM clust_export)")
def group_repair(spark, sf):
    clean = T.clean_group(F.col("target_group"), ["immigrants", "police", "u.s. country"])
    return table(spark, sf, "clust_export").select(F.col("target_group").alias("label"), clean.alias("clean")).distinct()


@query("SELECT id, CAST(strpos(sentence, source_word) - 1 AS INTEGER) AS start_char, CAST(strpos(sentence, source_word) - 1 + length(source_word) AS INTEGER) AS end_char FROM llm_met_scores WHERE strpos(sentence, source_word) > 0")
def relative_spans(spark, sf):
    """Places of source words in their sentences, from places in a document in which the sentence starts at 1000."""
    rows = table(spark, sf, "llm_met_scores").where(F.instr(F.col("sentence"), F.col("source_word")) > 0).withColumn("at", F.lit(999) + F.instr(F.col("sentence"), F.col("source_word")))
    start, end = T.relative_span(F.col("sentence"), F.lit(1000), F.col("at"), F.col("at") + F.char_length("source_word"), F.col("source_word"))
    return rows.select("id", start.alias("start_char"), end.alias("end_char"))


@query("SELECT met_id, exported_at, concat_ws(' ', source_word, target_word, entailment_text) AS joined FROM clust_export")
def joined_answers(spark, sf):
    rows = table(spark, sf, "clust_export").select("met_id", "exported_at", F.struct("source_word", "target_word", "entailment_text").alias("annotation"))
    return rows.select("met_id", "exported_at", T.joined_values(F.col("annotation"), ["source_word", "target_word", "entailment_text"]).alias("joined"))


def _say(name: str, column: str) -> str:
    return f"'{name}' || chr(39) || coalesce({column}, '') || chr(39)"


@query(f"""
SELECT id, {_say('Specified Verb: ', 'source_word')} || chr(10) || {_say(' Sentence: ', 'sentence')} AS verb,
{_say('Specified Verb: ', 'source_word')} || chr(10) || {_say(' Target Noun: ', 'target_word')} || chr(10) || {_say(' Sentence: ', 'sentence')} AS verb_target,
{_say('Potential Source Word: ', 'source_word')} || chr(10) || {_say(' Sentence: ', 'sentence')} AS word FROM llm_met_scores""")
def candidate_prompts(spark, sf):
    from ..operators.annotate import candidate_prompt

    values = {c: F.col(c) for c in ("source_word", "target_word", "sentence")}
    return table(spark, sf, "llm_met_scores").select("id", candidate_prompt(**values).alias("verb"), candidate_prompt(target=True, **values).alias("verb_target"), candidate_prompt(False, **values).alias("word"))


@query("SELECT id, min(llm_explanation) AS text FROM llm_met_scores WHERE llm_explanation <> '' GROUP BY id")
def embedding_texts(spark, sf):
    """The explanations, one of the texts that embeddings may be made of."""
    return features.embedding_texts("explanation", table(spark, sf, "llm_met_scores").select("id", F.struct(F.col("llm_explanation").alias("explanation")).alias("annotation")))


@query("SELECT id, CAST(CAST('0x' || substr(md5(t || '|42'), 1, 8) AS BIGINT) % 1001 AS DOUBLE) / 1000 AS score FROM (SELECT DISTINCT id, source_word || ' ' || sentence AS t FROM llm_met_scores)")
def path_scores(spark, sf):
    """Scores of candidate paths by a provider: here by lot."""
    rows = table(spark, sf, "llm_met_scores").select("id", F.concat("source_word", F.lit(" "), "sentence").alias("t")).distinct()
    return nlp.path_scores(rows, "id", "t", providers.provider("scores"))


@query()
def candidate_sentence_flags(spark, sf):
    toks = nlp.tokens(parsed_documents(spark, sf))
    return nlp.candidate_sentences(toks)


@query()
def sdp_match(spark, sf):
    """Source-target pairs of all documents under the verb part of the grammar."""
    sents = nlp.sentence_tokens(parsed_documents(spark, sf)).where(nlp.is_candidate(F.col("t")))
    found = nlp.match_paths(nlp.paths(sents, verbs_only=True), nlp.grammar(spark))
    return nlp.candidate_pairs(found).select("met_id", "doc_id", "sent_idx", "source", "target", "met_paths")


@query()
def sdp_errors(spark, sf):
    return nlp.path_errors(nlp.tokens(parsed_documents(spark, sf)))


@query()
def nested_documents(spark, sf):
    """Documents with their sentences nested in order."""
    parsed = parsed_documents(spark, sf)
    sents = nlp.sentences(parsed).select("doc_id", "sent_idx", "text", "num_tokens")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    return relational.nested(docs, sents, "doc_id", "doc_id", ["sent_idx"], "sentences")


@query()
def pair_errors(spark, sf):
    return nlp.pair_errors(nlp.sentence_tokens(parsed_documents(spark, sf)))


@query()
def retokenized(spark, sf):
    rows = table(spark, sf, "llm_met_scores").select("id", "sentence").distinct()
    return nlp.retokenized(spread(rows), "id", "sentence").select(F.col("doc_id").alias("id"), "tok_idx", "text", "pos", "head", "dep")


@query()
def word_vectors(spark, sf):
    """Vectors of target words in their sentences."""
    rows = table(spark, sf, "llm_met_scores").select("id", "sentence", "target_word").distinct()
    return features.word_vectors(spread(rows), "id", "sentence", "target_word", providers.provider("words", dim=32))


@query("""
WITH m AS (SELECT DISTINCT id, sentence, source_word, strpos(sentence, source_word) - 1 AS a, strpos(sentence, source_word) - 1 + length(source_word) AS b FROM llm_met_scores WHERE strpos(sentence, source_word) > 0),
w AS (SELECT id, sentence, a, b, unnest(string_split(sentence, ' ')) AS w, generate_subscripts(string_split(sentence, ' '), 1) - 1 AS i FROM m),
t AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY id, sentence, a, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w)
SELECT id, CAST(a AS INTEGER) AS span_start, CAST(b AS INTEGER) AS span_end, CAST(min(i) AS INTEGER) AS first_tok, CAST(max(i) AS INTEGER) AS last_tok FROM t WHERE a < s + length(w) AND b > s GROUP BY id, a, b""")
def token_spans(spark, sf):
    """First and last token, between single spaces, of each source word's characters."""
    rows = table(spark, sf, "llm_met_scores").where(F.instr(F.col("sentence"), F.col("source_word")) > 0).select("id", "sentence", "source_word").distinct()
    at = F.instr(F.col("sentence"), F.col("source_word")) - 1
    spans = rows.select("id", at.alias("span_start"), (at + F.char_length("source_word")).alias("span_end"))
    pieces = F.split("sentence", " ")
    begin = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda s, w: s + F.char_length(w) + 1)
    toks = rows.select("id", "sentence", F.posexplode(pieces).alias("tok_idx", "w")).withColumn("start_char", begin(F.col("tok_idx"))).select("id", "tok_idx", "start_char", (F.col("start_char") + F.char_length("w")).alias("end_char")).distinct()
    return nlp.token_span(toks, spans, ["id"])
