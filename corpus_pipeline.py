"""The corpus pipeline: language ID, near-dedup, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next stage's ``docs``. All but the last return the columns of documents.
Null texts are rejected by the first stage; empty tables stay empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import langid, mixing, packing, secrets, simhash
from lumenframe.llm.common import discard, materialise, packed, release, unpacked

# No SQL expresses the trained classifier or the tokenizer; tests use brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; learns from labelled rows.

    Rejected are texts that are null or hold no letter (``und``), and foreign ones: gibberish
    and languages without labelled rows, which lie below the fences that the labelled rows of
    each language set. Very short texts, and what looks most like a language of few labelled
    rows, are hardly or not fenced; they stay. Rows without a label get the recognised language as ``lang``."""
    model = langid.train(docs, F.lit(True), fenced=True)
    out = langid.predict(docs, model, prefix="_lang_")
    kept = out.filter((F.col("_lang_pred") != "und") & ~F.col("_lang_foreign"))
    return kept.withColumn("lang", F.coalesce("lang", "_lang_pred")).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every component, the one of the smallest id (of rows that
    repeat it whole, one)."""
    key = lambda i, h: {"id": F.coalesce(i, F.lit(0)), "void": i.isNull(), "hash": h}
    found = simhash.near_duplicates(docs)
    first = found.select(*[c.alias(n) for n, c in key(F.col("component_id"), F.col("first_hash")).items()]).distinct()
    rows = packed(docs, **key(F.col("doc_id"), F.xxhash64("text")))
    # Both steps need rows of a key together: texts move once.
    rows = rows.join(first, ["id", "void", "hash"], "left_semi").dropDuplicates(["id", "void", "hash"])
    return rows.select(*unpacked(rows, docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks credentials that look live; widely copied examples stay."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or cuts documents so that sources meet their target weights."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture into sequences of at most 2048 tokens, one row per piece."""
    out = packing.pack(docs)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = materialise(made, name)
        release(made)  # what the stage wrote on its way, and the stage before
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # packing has written its pieces
    return out
