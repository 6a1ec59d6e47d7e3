"""The star export against its SQL where embeddings share an idx or have none."""

import os

import oracle
import pytest

from tropelake.plans import core

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")


def test_star_export_with_shared_and_missing_idx(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    for f in os.listdir(oracle.DATA):
        if f != "met_embeddings.parquet":
            os.symlink(os.path.join(oracle.DATA, f), tmp_path / f)
    source = os.path.join(oracle.DATA, "met_embeddings.parquet")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN idx % 3 = 0 THEN NULL WHEN idx % 3 = 1 THEN 7 ELSE idx END AS idx) FROM '{source}{'/*.parquet' if os.path.isdir(source) else ''}') TO '{tmp_path}/met_embeddings.parquet'")
    monkeypatch.setattr(oracle, "DATA", str(tmp_path))
    oracle.compare(spark, oracle.connect(), core.queries()["star_export"], core.oracle_sql()["star_export"])
