"""The registered queries over the driver's tables: against SQL, and together."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from meshwright.llm import queries
from meshwright.llm.toxicity import induce, scored

from .conftest import prose

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cursor = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


def test_all_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "secrets", "source mix", "packing"]


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no driver tables")
def test_toxic_documents_on_held_out_labels(spark):
    """Half of the labels are learnt from, the others are judged."""
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    lex = induce(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("label"))
    scores = scored(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")), lex).join(held, "doc_id")
    counts = {(r["label"], r["toxic"]): r["count"] for r in scores.groupBy("label", "toxic").count().collect()}
    caught, missed, wrong, right = (counts.get(k, 0) for k in ((1, True), (1, False), (0, True), (0, False)))
    # some labels name documents without any toxic word
    assert caught >= 0.85 * (caught + missed) > 100 and wrong <= 0.01 * (wrong + right)


def test_pipeline_by_stage(spark):
    """Each stage against what its definition leaves of its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    toxic = {r["doc_id"] for r in queries.op5_toxicity(spark, DATA).where("toxic").collect()}
    one = corpus_pipeline.toxicity(spark, docs, DATA).cache()
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - toxic
    two = corpus_pipeline.near_duplicates(spark, one, DATA).cache()
    c = duckdb.connect()
    one.toPandas().pipe(lambda p: c.register("documents", p))
    kept = {r[0] for r in c.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op2_near_duplicates']}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in two.select("doc_id").collect()} == kept
    three = corpus_pipeline.secret_scan(spark, two, DATA).cache()
    assert three.count() == len(kept) and three.columns == docs.columns
    same = three.join(two.select("doc_id", F.col("text").alias("was")), "doc_id").where("text <> was")
    assert same.where(~F.col("text").contains("[SECRET]")).count() == 0
    four = corpus_pipeline.source_mix(spark, three, DATA).cache()
    assert 0 < four.count() <= three.count() and four.join(three, four.columns, "left_anti").count() == 0
    packs = corpus_pipeline.packing(spark, four, DATA)
    tokens = sum(len((r["text"] or "").split()) for r in four.collect())
    assert packs.agg(F.sum("n_tokens")).first()[0] == tokens


def test_toxicity_stage_removes_what_the_lexicon_rejects(spark, tmp_path):
    """A table whose labels teach something: the stage leaves what the query calls clean."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w, toxic = prose(rng, rng.randrange(60, 200), 200).split(), i % 5 == 0
        for _ in range(6 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilest", "rotter", "scurvy", "gormless"]))
        rows.append((i, " ".join(w), "en", "a", 1))
        labels += [(i, 1, int(toxic))] if i % 2 else []
        labels += [(i, 1, int(toxic))] if toxic and i % 4 == 0 else []
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()}
    assert kept == {r["doc_id"] for r in queries.op5_toxicity(spark, str(tmp_path)).where("not toxic").collect()}
    assert len(kept & {i for i in range(0, 400, 5)}) <= 2 and len(kept) >= 315


def test_run_ends_with_packs(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["pack_id", "n_tokens", "pieces"] and out.count() > 0
