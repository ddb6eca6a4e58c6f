"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.plans import memory, problems, relational, retrieval, store, streams

_MODULES = (problems, memory, retrieval, relational, store, streams)

QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_retrieval"](spark, sf_dir)
