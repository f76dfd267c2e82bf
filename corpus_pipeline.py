"""A corpus pipeline of five stages: language ID, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's ``docs``. A stage begins by deleting the scratch tables of the stage before on
the same tables, whose output has been written by then; run one pipeline at a time over one ``sf_dir``.

In every stage: null and empty texts reach no later stage, as the first rejects them; repeated rows are
rows of their own; rows are told apart by number and never by doc_id, which may be null or repeat; texts are
read whole; columns beside those of ``documents`` pass through all stages but the last; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maildf.llm import exact, jaccard, langid, mixing, packing
from maildf.llm.common import Scratch, numbered, table_of

_last: dict[str, Scratch] = {}
#: A column that stands for the row while verdicts are joined back.
ROW = "__pipeline_row"


def _scratch(spark: SparkSession, sf_dir: str) -> Scratch:
    if sf_dir in _last:
        _last.pop(sf_dir).drop()
    _last[sf_dir] = Scratch(spark)
    return _last[sf_dir]


def _rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return numbered(docs, scratch, [F.col(f"`{c}`") for c in docs.columns], ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null text or no letter) go."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    s = _scratch(spark, sf_dir)
    rows = _rows(docs, s)
    kept = exact.dedup(rows, s, row=ROW).filter("kept").select(F.col("uid").alias(ROW))
    return rows.join(kept, ROW, "left_semi").drop(ROW)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the first row stays; rows stand for themselves, whatever their doc_id."""
    s = _scratch(spark, sf_dir)
    rows = _rows(docs, s)
    classes = jaccard.join(rows.select(F.col(ROW).alias("doc_id"), "text", ROW), s, row=ROW)
    kept = classes.filter("doc_id = class_id").select(F.col("doc_id").alias(ROW))
    return rows.join(kept, ROW, "left_semi").drop(ROW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights."""
    held = docs.select("source", mixing.name_of().alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))
    return mixing.mix_sources(held, _scratch(spark, sf_dir), named=F.col("doc_id")).select(f"{ROW}.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens; the pieces are the result."""
    return packing.pack(docs, _scratch(spark, sf_dir))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]
#: Language ID, Poisson draws over what it keeps and byte-pair ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, out = table_of(spark, sf_dir, "documents"), Scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = out.table(docs, name)
    return docs
