"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import audio_features
from .fingerprints import fingerprints
from .mixing import mixed
from .neardup import near_duplicates
from .packing import packs
from .pii import pii
from .secrets import secrets
from .substrings import repeated_passages
from .tokenstore import store
from .toxicity import toxicity


#: Byte-level pairs, of the public vocabulary files of the machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no sound; every document's bytes stand for a mu-law clip."""
    clips = documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("clip"))
    return audio_features(clips)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs(documents(spark, sf_dir))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(documents(spark, sf_dir), VOCABULARY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_audio_features": op1_audio_features,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_secrets": op3_secrets,
    "op4_source_mix": op4_source_mix,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_fingerprints": op7_fingerprints,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_packing": op9_packing,
    "op10_token_store": op10_token_store,
}

#: Words as the operators take them.
_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ')"
_WORDS = f"docs AS (SELECT DISTINCT doc_id, text, regexp_extract_all({_FOLD}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"
_REPEATED = f"""WITH {_WORDS},
win AS (SELECT doc_id, i AS s, list_slice(w, i + 1, i + 50) AS p FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM docs WHERE len(w) >= 50)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY p) AS n FROM win) WHERE n > 1),
mark AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM rep),
run AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM mark)
SELECT doc_id, min(s) AS start_word, max(s) + 50 AS end_word FROM run GROUP BY doc_id, r"""
_NEAR = f"""WITH RECURSIVE {_WORDS},
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN [text, ''] WHEN len(w) < 3 THEN w ELSE list_slice(w, i + 1, i + 3) END AS g FROM (SELECT doc_id, text, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM docs))),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM common JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE c >= 0.5 * (x.n + y.n - c)),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(doc_id, other) AS (SELECT DISTINCT a, a FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
grp AS (SELECT doc_id, min(other) AS g FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(g, d.doc_id) AS group_id, coalesce(g, d.doc_id) = d.doc_id AS kept FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN grp ON grp.doc_id = d.doc_id"""

#: What SQL can express; the others draw at random, learn or search.
ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": _NEAR,
    "op8_repeated_passages": _REPEATED,
}
