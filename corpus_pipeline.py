"""The training-data pipeline: toxicity, near-duplicates, repeated substrings, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage's result is written and read again before the next, so an executor lost later costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import index, simhash, suffixes, toxicity
from loomtrace.llm.common import materialise, table
from loomtrace.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more go."""
    docs = docs.select(*COLUMNS)
    return toxicity.accept(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of 4 or fewer differing bits, that with the smallest id stays."""
    return simhash.representatives(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that start earlier too are cut out; n_chars is that of the new text."""
    docs = docs.select(*COLUMNS)
    return suffixes.deduplicate(docs, carry=["lang", "source"]).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 10 consecutive words of a benchmark item, or all of a shorter one, go."""
    docs = docs.select(*COLUMNS)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")))
    found = index.decontaminate(docs.select(key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    hit = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", key).join(hit, "_key", "left_anti").select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left in windows of 1024 tokens, each mixed from the sources by their shares."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: SQL can't express most stages; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
