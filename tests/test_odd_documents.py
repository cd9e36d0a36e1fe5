"""Queries over documents with empty, blank and padded texts, held against their SQL."""

import pytest

from tests.comparing import connection, same
from textquarry import queries, registry  # noqa: F401

TEXTS = [None, "", " \n  ", "\n\n", "  padded line  \nnext \n　\n last", "with the of\n \nis  in the ", " only ", "a\n\n b"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    con = connection("/root/testdata/sf0.001")
    for t in ("labels", "embeddings"):
        con.sql(f"COPY {t} TO '{d}/{t}.parquet'")
    con.execute("CREATE TABLE odd (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO odd VALUES (?, ?)", list(enumerate(TEXTS, 100_000)))
    con.sql(f"COPY (FROM documents UNION ALL BY NAME SELECT doc_id, text, 'en' AS lang, 's' AS source, length(text) AS n_chars FROM odd) TO '{d}/documents.parquet'")
    con.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{d}/documents.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["sections", "blocks_annotated", "blocks_page"])
def test_odd_documents_agree_with_sql(spark, odd, name):
    d, con = odd
    same(registry.QUERIES[name](spark, d), con, registry.ORACLES[name])
