"""The registered queries over the smallest tables: columns, row counts and, where there is one, the SQL."""

import duckdb
import pytest

from sondage.llm.queries import ORACLES, QUERIES
from tools.oracle_check import norm

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["query_id", "rank", "vec_id", "score"], "op2": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op3": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op6": ["doc_id", "fingerprint", "component_id"],
    "op7": ["doc_id", "size", "source_size", "target", "taken"], "op8": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op9": ["doc_id", "start", "n_tokens", "ids_crc32"], "op10": ["page_id", "host", "path", "rule", "verdict"],
    "op11": ["lang", "source", "part", "item", "value", "rank"], "op12": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op13": ["vec_id", "code", "error", "label_error", "codebooks_sha256"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    op = name.split("_")[0]
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[op]
    got = df.toPandas()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    table = {"op1": "embeddings", "op4": "pages", "op10": "pages", "op13": "embeddings"}.get(op, "documents")
    n = con.execute(f"SELECT COUNT(*) FROM {table}" + (" WHERE vec_id % 50 = 0" if op == "op1" else "")).fetchone()[0]
    assert len(got) == 5 * n if op == "op1" else len(got) >= n if op == "op5" else len(got) == n or op == "op11"
    if name in ORACLES:
        want = con.execute(ORACLES[name]).fetchdf()
        assert norm(got[sorted(got.columns)]) == norm(want[sorted(want.columns)])


def test_all_operators_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
