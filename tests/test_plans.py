"""The plans are the ones we want: pruned scans, pushed filters, one Python node a parse, no cross joins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maildf import functions as M
from maildf.parse import EmailParser
from maildf.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filtered(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 10")
    p = plan(EmailParser().parse(docs.selectExpr("doc_id", "encode(concat('Subject: ', source, '\n\n'), 'UTF-8') AS raw")).select(M.subject("message")))
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in p
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p
    assert p.count("MapInArrow") == 1 and "ArrowEvalPython" not in p


def test_text_functions_run_only_where_they_are_asked_for(spark):
    m = EmailParser().parse(spark.read.parquet(f"{SF}/pages.parquet").select(F.encode("html", "UTF-8").alias("raw")))
    lazy = m.select(M.subject("message").alias("s"), M.body_text("message").alias("t")).select("s")
    assert "ArrowEvalPython" not in plan(lazy)


@pytest.mark.parametrize("name", sorted(Q.REGISTRY))
def test_no_query_has_a_cross_join(spark, name):
    p = plan(Q.REGISTRY[name][0](spark, SF))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p and "BatchEvalPython" not in p
    assert p.count("MapInArrow") <= 2 + p.count("Union")
