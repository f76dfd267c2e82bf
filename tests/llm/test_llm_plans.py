"""Mixing stays in SQL functions; no operator has a cross join."""

from __future__ import annotations

from maildf.llm import mixing, packing
from maildf.llm import queries as Q
from maildf.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mixing_is_native(spark):
    p = plan(mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark)))
    assert not any(x in p for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoopJoin"))


def test_packing_does_not_shuffle_tokens(spark):
    p = plan(packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark)))
    assert "SortMergeJoin" not in p and p.count("MapInArrow") == 1


def test_names_of_queries():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(Q.oracle_sql()) <= set(Q.queries())
