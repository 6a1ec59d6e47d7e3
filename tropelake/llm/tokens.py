"""Token counts of a public tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of NLTK's WordPunctTokenizer.
WORD_PUNCT = r"\w+|[^\w\s]+"


def token_counts(df: DataFrame, ident: str, text: str, keep: list[str] | None = None, tokenizer: str = "word_punct") -> DataFrame:
    """``ident``, ``n_tokens`` INT and the columns ``keep``: the number of tokens of each whole text; null and empty texts have none.

    ``tokenizer`` is "word_punct", NLTK's public pattern, or the path of a public vocabulary file of the library
    tokenizers (.json).  Counting happens where the texts are read; texts are not shuffled.
    """
    keep = keep or []
    rows = df.select(F.col(f"`{ident}`"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_tokens INT"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer == "word_punct":
            find = re.compile(WORD_PUNCT).findall
            count = lambda texts: [len(find(t)) if t else 0 for t in texts]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer)
            model.encode_special_tokens = True
            count = lambda texts: [len(e.ids) for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = pa.array(count(part.column("_text").to_pylist()), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], n], names=[*part.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, schema)
