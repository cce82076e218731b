"""Stages of the corpus pipeline, and the registered queries against SQL where there is some."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from staylens.llm import queries
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")


def test_registration():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck(FOLDER), queries.SQL[name]) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    twin = docs.where("doc_id = 2").withColumn("doc_id", F.lit(900_000).cast("long"))
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("item_id = 0").first().text
    leak = twin.withColumns({"doc_id": F.lit(900_001).cast("long"), "text": F.lit("Some words before. " + item)})
    none = twin.withColumns({"doc_id": F.lit(900_002).cast("long"), "text": F.lit(None).cast("string")})
    given = docs.unionByName(twin).unionByName(leak).unionByName(none)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, given, FOLDER)
        assert left.columns == docs.columns
        ids = {r.doc_id for r in left.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in given.select("doc_id").collect()} and len(ids) > 0.5 * given.count()
        assert (900_000 in ids) == (name in ("quality", "benchmark")), name
        assert (900_001 in ids) == (name != "benchmark"), name
    packed = corpus_pipeline.STAGES[-1][1](spark, given, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in given.collect()}


def test_run(spark):
    first = {(r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert first and first == {(r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, FOLDER).collect()}
