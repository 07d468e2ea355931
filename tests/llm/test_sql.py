"""The problems' queries against their SQL over the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from setlens.llm import tokens_sql
from setlens.llm.queries import ORACLE, QUERIES
from verify import plain

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert got == Counter(tuple(plain(x) for x in r) for r in rows)


def test_token_ids_equal_merges_in_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{D}/documents.parquet'")
    want = dict(con.sql(tokens_sql.tokens_cte() + "SELECT doc_id, ids FROM enc").fetchall())
    assert {r["doc_id"]: list(r["ids"]) for r in QUERIES["p7_ids"](spark, D).collect()} == want
