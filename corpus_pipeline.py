"""Documents to packed training sequences: quality, repeated lines, near-duplicates, benchmark passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the table that the next
stage reads. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewise.llm.common import fingerprint, own_columns, plain_columns, small_or_shuffled, stored
from stakewise.llm.decontamination import contamination
from stakewise.llm.lines import dedup_lines
from stakewise.llm.minhash import one_of_each
from stakewise.llm.packing import pack_documents
from stakewise.llm.quality import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, out="__rules").filter("__rules.kept").drop("__rules")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents of which no word is left."""
    out = dedup_lines(docs, short_copies=True, out="__lines")
    left = F.when(F.size("__lines.removed") > 0, F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).otherwise(True)
    n_chars = F.when(F.size("__lines.removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.filter(left).withColumn("n_chars", n_chars).select(*own_columns(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows that repeat in id and text, one."""
    return one_of_each(docs).select(*own_columns(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window. Rows go by id and text, so an id that repeats takes no other text along."""
    keyed = docs.withColumn("__row", F.struct(*[h.alias(n) for h, n in zip(fingerprint(F.col("doc_id"), F.col("text")), ("r1", "r2"), strict=True)]))
    found = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__row")
    hit = stored(found.filter("n_hit > 0").select(F.col("doc_id").alias("__row")).distinct(), "hit")
    return keyed.join(small_or_shuffled(hit), "__row", "left_anti").select(*own_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def any_columns(stage):
    """``stage`` for documents with columns of any names besides those that it reads: they pass under plain names."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain, named = plain_columns(docs, ("doc_id", "text", "n_chars"))
        return named(stage(spark, plain, sf_dir))

    return run


STAGES = [(f.__name__, any_columns(f)) for f in (quality, lines, near, benchmark)] + [("packing", packing)]
#: SQL has no Zstandard ratio, MinHash components or tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    name, last = STAGES[-1]
    return last(spark, docs, sf_dir)
