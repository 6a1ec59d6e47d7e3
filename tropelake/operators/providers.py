"""Models by name, ``module:function``, in place of the deterministic stubs.

A provider takes and gives iterators of frames, so it loads its model once a task.  A name stands for a function that
returns the provider (it gets the keyword arguments below); modules must be importable where the tasks run.

=========  =====================================  ===========================================
kind       frames in                              frames out
=========  =====================================  ===========================================
parser     doc_id, text                           doc_id, sentences (``nlp.PARSED``)
embedder   id, text                               id, text, emb
words      id, text, word                         id, emb (null: the word isn't there)
answers    id, prompt                             id, answer (JSON or null)
scores     id, text                               id, score
=========  =====================================  ===========================================
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd

from . import annotate, features, nlp

STUBS = {
    "parser": lambda **o: nlp.stub_parser,
    "embedder": lambda dim=64, **o: features.stub_embedder(dim),
    "words": lambda dim=64, **o: features.stub_word_vectors(dim),
    "answers": lambda task="metaphor_class", seed=42, **o: annotate.stub_provider(task, seed),
    "scores": lambda seed=42, **o: stub_scores(seed),
}


def provider(kind: str, name: str = "", **options) -> Callable:
    """The provider of a kind: the stub without a name, else what the named function returns."""
    if not name:
        return STUBS[kind](**options)
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"a provider is named module:function, not {name}")
    return getattr(importlib.import_module(module), function)(**options)


def stub_scores(seed: int = 42) -> Callable:
    """A score from 0 to 1 by lot, for each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for frame in frames:
            score = [None if t is None else int(hashlib.md5(f"{t}|{seed}".encode()).hexdigest()[:8], 16) % 1001 / 1000 for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "score": score})

    return run
