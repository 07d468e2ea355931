"""Every core query against its SQL over the smallest tables, and independence of the number of shuffle partitions."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from setlens.plans import catalog, core_queries
from verify import plain

D = "/root/testdata/sf0.001"
QUERIES = {name: q for m in core_queries() for name, q in m.QUERIES.items()}
ORACLE = {name: q for m in core_queries() for name, q in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


def result(df):
    return Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    got = result(df)
    if name not in ORACLE:
        assert got
        return
    columns = sorted(con.sql(ORACLE[name]).columns)
    assert sorted(df.columns) == columns
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert got == Counter(tuple(plain(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", ["rerank_fixed_tail", "identity_vocabulary", "candidate_quota", "split_fingerprint", "p2_found"])
def test_partitions_do_not_matter(spark, name):
    seen = []
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(result(QUERIES[name](spark, D)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2]


def test_the_entry_works_without_the_subpackage_and_names_match(monkeypatch):
    import sys

    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    for name in [n for n in sys.modules if n == "setlens.llm" or n.startswith("setlens.llm.")]:
        monkeypatch.delitem(sys.modules, name)

    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name == "setlens.llm" or name.startswith("setlens.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE)


@pytest.mark.parametrize("name", ["complete_ranking", "zscore_coarse", "retrieval_metrics_overall"])
def test_no_task_sorts_a_whole_query(spark, name):
    """Windows by sample alone are limited, or hold positives or a shortlist only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    windows = [line for line in plan.split("\n") if " Window " in line]
    if name != "retrieval_metrics_overall":
        assert not [w for w in windows if ", [sample_id#" in w and "_part#" not in w]


def test_filters_and_columns_reach_the_scan(spark):
    # complete_ranking writes what it reads here before it ranks, so its own plan begins after the scan
    plan = catalog.scored(spark, D)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "IsNotNull(sample_id)" in scan and "scored_at" not in scan
    assert "WindowGroupLimit" in QUERIES["topm_shortlist"](spark, D)._jdf.queryExecution().executedPlan().toString()


def test_hard_crops_lists_no_pairs_by_identity(spark):
    joins = [line for line in QUERIES["hard_crops"](spark, D)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and not [line for line in joins if "identity_id" in line]


def refuse(*_args, **_kwargs):
    raise AssertionError("lists every image that holds an identity")


def test_mined_pools_list_no_pairs_by_identity(spark, monkeypatch):
    from setlens.plans import calibrated

    monkeypatch.setattr(calibrated, "division", refuse, raising=False)
    assert QUERIES["hard_negative_pools"](spark, D).count()


def test_evaluation_lists_no_pairs_by_identity(spark, monkeypatch):
    """Identity positives are counted, and only ranked and labelled pairs are tested."""
    from setlens.plans import dataset

    monkeypatch.setattr(dataset, "identity_positives", refuse)
    assert QUERIES["evaluation_per_query"](spark, D).count()


def test_scope_audit_lists_no_pairs_by_identity(spark, monkeypatch):
    from setlens.plans import dataset

    monkeypatch.setattr(dataset, "division", refuse)
    assert QUERIES["positive_scope_audit"](spark, D).count()


def test_review_queue_numbers_images_once_per_identity(spark, monkeypatch):
    from setlens.plans import dataset

    monkeypatch.setattr(dataset, "identity_positives", refuse)
    assert QUERIES["review_queue"](spark, D).count()
