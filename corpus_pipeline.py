"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.

1. toxicity: documents predicted toxic go.
2. near duplicates (five words, similarity 0.8): one document of each group stays, and one
   of rows that repeat an id and its text.
3. substring dedup: repeated chunks go from the texts; ``n_chars`` follows.
4. decontamination: documents with a window of a benchmark item go.
5. mixing: what each source gives to the mix; documents that give nothing go.

Null texts pass as empty ones, null ids are never matched, and empty tables stay empty. Of
rows that repeat an id and its text, that with the smallest further columns (as JSON) stays.
Columns besides ``doc_id``, ``text`` and ``source`` travel in one struct, so they may have
any name, those of the operators' results included; the last stage returns its own
``size``, ``source_size``, ``target`` and ``taken`` in place of columns so named.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from oligo_engine.llm.chunk_dedup import dedup_substrings
from oligo_engine.llm.common import checkpoint, shared_dir
from oligo_engine.llm.decontamination import decontaminate
from oligo_engine.llm.minhash import near_duplicates
from oligo_engine.llm.mixing import mix
from oligo_engine.llm.toxic_text import toxicity


def packed(docs: DataFrame, *plain: str) -> DataFrame:
    """The columns ``plain``, and all others in the struct ``_rest``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in plain]
    return docs.select(*plain, F.struct(*others, F.lit(0).alias("_end")).alias("_rest"))


def unpacked(rows: DataFrame, docs: DataFrame, *plain: str) -> DataFrame:
    """``packed`` rows with the columns of ``docs`` again."""
    return rows.select(*[F.col(c) if c in plain else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity(packed(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(scored.filter("predicted = 0"), docs, "doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = near_duplicates(docs.select("doc_id", "text"), words=5, percent=80).filter("NOT kept").select("doc_id").distinct()
    known, unknown = docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")
    left = packed(known.join(others, "doc_id", "left_anti"), "doc_id", "text")
    same = W.partitionBy("doc_id", "text").orderBy(F.to_json("_rest"))
    once = left.withColumn("_nth", F.row_number().over(same)).filter("_nth = 1")
    return unpacked(once, docs, "doc_id", "text").unionByName(unknown)


def drop_repeated_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = unpacked(dedup_substrings(packed(docs, "doc_id", "text")), docs, "doc_id", "text")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate(packed(docs, "doc_id", "text"), items, carry=("text", "_rest"))
    return unpacked(judged.filter("NOT contaminated"), docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ("size", "source_size", "target", "taken")
    mixed = mix(packed(docs, "doc_id", "text", "source"), carry=("text", "_rest")).filter("taken > 0")
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text", *own)]
    kept = ["text", *[F.col("_rest").getField(c).alias(c) for c in others]]
    return mixed.select("doc_id", "source", *kept, *own)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_chunks),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Learning, hashing and components have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the tables between the stages are deleted."""
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
            docs = spark.read.parquet(f"{root}/{name}")
        return checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
