import pathlib
import re
import zlib

import pytest

from lectern.llm import queries as Q
from tests.oracle import rows_of, sql_rows

QUERIES, ORACLE = Q.queries(), Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == sql_rows(ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op6_pack_sequences"}))
def test_query_has_every_document(spark, sf_dir, name):
    ids = sorted(r["doc_id"] for r in QUERIES[name](spark, sf_dir).collect())
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())


def test_held_out_languages(spark, sf_dir):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = [r for r in QUERIES["op8_language_id"](spark, sf_dir).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in out)
    assert sum(docs[r["doc_id"]] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(__file__).parents[2]
    for path in (root / "lectern").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"lectern\.llm|from lectern import llm", path.read_text(encoding="utf-8")), path
