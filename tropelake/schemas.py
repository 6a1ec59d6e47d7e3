"""Declared schemas; nothing is ever inferred, as identifiers are long strings of digits."""

DOCUMENTS = "id STRING, text STRING, clean_text STRING, num_sentences INT"
SENTENCES = "id STRING, document_id STRING, text STRING, clean_text STRING, num_tokens INT, start_char INT, end_char INT"
TOKENS = "id STRING, sentence_id STRING, text STRING, pos STRING, start_char INT, end_char INT"
CHAINS = "id STRING, document_id STRING, representative_text STRING"
MENTIONS = "id STRING, coreference_chain_id STRING, sentence_id STRING, start_tok INT, end_tok INT, text STRING"
DOC_ANNOTATIONS = "id STRING, document_id STRING, annotation_type STRING, annotation_value STRING"
SENT_ANNOTATIONS = "id STRING, document_id STRING, sentence_id STRING, annotation_type STRING, annotation_value STRING"
TOKEN = "STRUCT<token_id: STRING, text: STRING, pos: STRING, dep: STRING>"
CANDIDATES = f"met_id STRING, source_token {TOKEN}, target_token {TOKEN}, sentence_text STRING, met_paths ARRAY<INT>"
EMBEDDINGS = "idx INT, id STRING, emb ARRAY<FLOAT>, text STRING"
FEATURES = "noun_classification STRING, target_group STRING, source_image_schema_group STRING"
ASSIGNMENTS = "idx BIGINT, label INT"
CENTROIDS = "cluster INT, center ARRAY<DOUBLE>"
CANNOT_LINK = "i INT, j INT"
SOLUTIONS = "example_id INT, answer INT, difficulty STRING, method STRING, source_cluster INT, positive_indices ARRAY<BIGINT>, intruder_index BIGINT"

#: Answers of the annotation tasks.
ANSWERS = {
    "metaphor_class": "classification STRING, explanation STRING",
    "metaphor_class_only": "classification STRING",
    "metaphor_score": "metaphor_salience_score DOUBLE, explanation STRING",
    "metaphor_score_only": "metaphor_salience_score DOUBLE",
    "noun_type": "noun_classification STRING",
    "target_group": "target_group STRING",
    "groups": "groups ARRAY<STRING>",
    "clean_groups": "clean_groups MAP<STRING, STRING>",
    "image_schema": "image_schema_group STRING",
    "entailments": "problem_def STRING, cause STRING, moral_eval STRING, treatment_rec STRING",
    "ad_class": "classification STRING",
}
#: Accepted values of enumerated answers.
DOMAINS = {
    "noun_classification": ("person", "place", "thing", "organization"),
    "image_schema_group": ("spatial motion", "force", "balance", "other"),
    "ad_class": ("advertisement", "podcast"),
    "metaphor_class": ("literal", "metaphorical"),
}
DATASETS = ("subframes_immigration", "subframes_guns", "subframes_abortion", "tweets_immigration", "lcc-small", "lcc-large", "podcasts")
