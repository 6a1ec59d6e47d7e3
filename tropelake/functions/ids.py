"""Composite identifiers: ``{doc}[-chunk]_{sentence}_{source token}_{target token}[_{path}]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compose(*parts: Column) -> Column:
    """Parts joined by ``_``; null if any is null."""
    out = parts[0].cast("string")
    for p in parts[1:]:
        out = F.concat(out, F.lit("_"), p.cast("string"))
    return out


def part(met_id: Column, k: int) -> Column:
    """Part ``k`` from 0; null where there is none."""
    return F.get(F.split(met_id, "_"), F.lit(k))


def document(met_id: Column) -> Column:
    return part(met_id, 0)


def sentence(met_id: Column) -> Column:
    return part(met_id, 1).try_cast("int")


def source_token(met_id: Column) -> Column:
    return part(met_id, 2).try_cast("int")


def target_token(met_id: Column) -> Column:
    return part(met_id, 3).try_cast("int")


def parent(identifier: Column) -> Column:
    """All but the last part."""
    return F.regexp_replace(identifier, "_[^_]*$", "")


def strip_chunk(doc_id: Column) -> Column:
    """An episode's identifier without its chunk: the last dash and what follows; one without a dash stays."""
    return F.regexp_replace(doc_id, "-[^-]*$", "")


def strip_episode_chunk(doc_id: Column) -> Column:
    """Like ``strip_chunk``, but only for a chunk number after the 36 characters of an episode."""
    return F.regexp_replace(doc_id, r"^(.{36})-\d+$", "$1")
