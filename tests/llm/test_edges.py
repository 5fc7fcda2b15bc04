"""Every operator and stage on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshwright.llm.audio import audio_features
from meshwright.llm.fingerprints import fingerprints
from meshwright.llm.mixing import mixed
from meshwright.llm.neardup import near_duplicates
from meshwright.llm.packing import packs
from meshwright.llm.pii import pii
from meshwright.llm.queries import VOCABULARY
from meshwright.llm.secrets import secrets
from meshwright.llm.substrings import repeated_passages
from meshwright.llm import tokenstore as T
from meshwright.llm.tokenstore import store
from meshwright.llm.toxicity import toxicity


def _labels(spark, rows=((6, 1, 1), (10, 1, 0), (8, 1, 0), (99, 1, 1), (None, 1, 1), (12, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "audio": lambda d: audio_features(d.withColumn("clip", F.col("text").cast("binary"))),
    "neardup": near_duplicates,
    "secrets": secrets,
    "mixing": mixed,
    "toxicity": lambda d: toxicity(d, _labels(d.sparkSession)),
    "pii": pii,
    "fingerprints": fingerprints,
    "substrings": repeated_passages,
    "packing": packs,
    "tokenstore": lambda d: store(d, VOCABULARY),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(documents, odd_rows, name):
    plain = OPERATORS[name](documents(odd_rows))
    rows = sorted(plain.collect(), key=str)
    clash = OPERATORS[name](documents(odd_rows, clash=True))
    assert clash.columns == plain.columns
    if name != "tokenstore":  # whose shards follow the partitions
        assert sorted(clash.collect(), key=str) == rows
    ids = [r["doc_id"] for r in rows] if "doc_id" in plain.columns else []
    if name in ("toxicity", "fingerprints"):
        assert len(rows) == len(odd_rows)
    if name in ("neardup", "mixing"):
        assert sorted(ids) == list(range(1, 13))
    if name == "audio":
        assert set(ids) == {None, *range(1, 13)}


LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))


def test_values_on_odd_rows(documents, odd_rows):
    """What each operator makes of null, empty, wordless and very long texts and of repeated rows."""
    docs = documents(odd_rows)
    count = lambda t: len((t or "").split())
    # no secrets and no personal data among them, in whole texts
    assert secrets(docs).count() == 0
    assert {(r["doc_id"], r["kind"]) for r in pii(docs).collect()} == set()
    marked = [(d, t if t != LONG else t + " write to ann@mail.example.com or call (212) 555-0100 now") for d, t, *_ in odd_rows] + [(None, "mail bob@mail.example.com today")] * 2
    got = sorted(((r["doc_id"], r["kind"], r["start"]) for r in pii(documents(marked)).collect()), key=str)
    assert got == sorted([(8, "email", len(LONG) + 10), (8, "phone", len(LONG) + 39), (None, "email", 5), (None, "email", 5)], key=str)
    # nothing of fifty words recurs, as rows of a doc_id count once; the long text does if another document quotes its end
    assert repeated_passages(docs).count() == 0
    quoted = LONG.split()[-70:]
    got = {tuple(r) for r in repeated_passages(documents([*odd_rows, (8, LONG), (30, " ".join(quoted))])).collect()}
    assert got == {(8, 59_930, 60_000), (30, 0, 70)}
    # every token of every row is in one piece
    pieces = [(p["doc_id"], p["start"], p["n_tokens"]) for r in packs(docs).collect() for p in r["pieces"]]
    want = [(d, a, min(2048, count(t) - a)) for d, t, *_ in odd_rows for a in range(0, count(t), 2048)]
    assert sorted(pieces, key=str) == sorted(want, key=str)
    # texts come back as they are, null as null
    back = T.documents(store(docs, VOCABULARY), VOCABULARY).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(((d, t) for d, t, *_ in odd_rows), key=str)
    # a document is a doc_id
    mix = {r["doc_id"]: r for r in mixed(docs).collect()}
    assert mix.keys() == set(range(1, 13)) and [mix[d]["n_tokens"] for d in (1, 2, 3, 4, 8)] == [0, 0, 0, 3, 60_000]


def test_ties(documents):
    """Equal lengths, texts and scores: results are those of any order of the rows."""
    rows = [(i, "six words of one same text") for i in range(40)] + [(100 + i, f"six other words number {i} here") for i in range(40)]
    for name, operator in OPERATORS.items():
        if name == "tokenstore":
            continue
        one, two = (sorted(map(str, operator(documents(r)).collect())) for r in (rows, rows[::-1]))
        assert one == two, name


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(documents, name):
    got = OPERATORS[name](documents([])).collect()
    assert len(got) == (1 if name == "tokenstore" else 0)


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, documents, odd_rows, stage, tmp_path):
    _labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    function = corpus_pipeline.STAGES[stage][1]
    for clash in (False, True):
        docs = documents(odd_rows, clash)
        out = function(spark, docs, str(tmp_path))
        if stage < 4:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.collect()
        empty = function(spark, documents([], clash), str(tmp_path))
        assert empty.count() == 0


def test_stage_results(spark, documents, odd_rows, tmp_path):
    _labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.near_duplicates(spark, documents(odd_rows), str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted([1, None, None, 2, 3, 4, 6, 8, 9, 10, 12], key=str)
    masked = corpus_pipeline.secret_scan(spark, documents([*odd_rows, *((20 + i, f"key {h} end") for i, h in enumerate(_hex(30)))]), str(tmp_path)).collect()
    assert len(masked) == len(odd_rows) + 30
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in masked)
    assert sum(r["text"] == "key [SECRET] end" for r in masked if r["doc_id"] and r["doc_id"] >= 20) >= 28


def test_stage_results_of_the_others(spark, documents, odd_rows, tmp_path):
    _labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda rows: sorted((str(tuple(r)) for r in rows))
    docs = documents(odd_rows)
    # three labelled documents teach nothing, so nothing goes; every row stays as it is
    assert key(corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()) == key(docs.collect())
    # what the operator selects stays with all its rows; rows without a doc_id take no part
    chosen = {r["doc_id"] for r in mixed(docs).where("selected").collect()}
    assert key(corpus_pipeline.source_mix(spark, docs, str(tmp_path)).collect()) == key(r for r in docs.collect() if r["doc_id"] in chosen)
    packed = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len((t or "").split()) for _, t, *_ in odd_rows)


def _hex(n):
    import random

    rng = random.Random(5)
    return ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(n)]
