"""From the table of documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's documents. All but the last return the
columns of documents.

1. quality: documents that the quality classifier rejects go. It learns from the
   labels whose crc32(doc_id) mod 5 is not 0.
2. lines: recurring line templates go, and lines of 50 words and more that an
   earlier document has as well; documents that had words and are left with
   none go as well.
3. near_duplicates: of each component of linked documents the one with the least
   id stays. Of rows with equal ids the least row stays.
4. mixture: documents are chosen by the target weights.
5. tokens: texts are encoded, and decoded from the ids.

Null texts are empty texts; rows without an id pass stages 2 and 3 unchanged.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleaner.llm import bpe, jaccard, lines, mixing, quality  # noqa: E402
from gleaner.llm.blocks import small_batches  # noqa: E402
from gleaner.llm.queries.corpus import DOMAIN, HELD_OUT, target_weights  # noqa: E402
from gleaner.sources.tables import broadcast_if_small, new_dir, written  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(f"not {HELD_OUT}")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model, keep=tuple(docs.columns), names=("__score", "__predicted"))
    return scored.filter("__predicted = 1").select(docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(docs, dropped="__dropped")
    kept = kept.filter((F.col("__dropped") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return kept.withColumn("n_chars", F.when(F.col("__dropped") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = written(jaccard.join_components(docs), "components")
    gone = found.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(gone, jaccard.SMALL), "doc_id", "left_anti").select(docs.columns)
    repeated = written(found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    rest = [c for c in docs.columns if c != "doc_id"]
    least = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("__row")).select("doc_id", "__row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(least.select(docs.columns))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(docs, target_weights(spark), F.expr(DOMAIN), share=0.8)
    chosen = written(chosen.select(F.col("_id").alias("__id"), F.col("_sum").alias("__sum")).distinct(), "chosen")
    rows = docs.withColumn("__own", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return rows.join(broadcast_if_small(chosen, jaccard.SMALL), rows["doc_id"].eqNullSafe(chosen["__id"]) & (rows["__own"] == chosen["__sum"]), "left_semi").select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = ("doc_id", "lang", "source")
    return bpe.encode(docs, path, keep=kept, decoded=True).drop("ends").withColumnRenamed("decoded", "text")


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixture", mixture_stage),
    ("tokens", tokens_stage),
]

# The quality classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
