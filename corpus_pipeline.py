"""Documents to token ids: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm import op1_toxicity, op2_bpe_codec, op3_language, op4_simhash, op9_decontamination
from paperlake.llm.common import connected_components, free_name, materialise, table

#: Rows that leave by deduplication are broadcast up to this many, else joined by a shuffle.
BROADCAST_ROWS = 200_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    net = op1_toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_toxicity")
    return op1_toxicity.scored(docs, net, into=score).where(F.col(score) < 0.5).drop(score)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter go."""
    found = free_name(docs, "_language")
    named = op3_language.identified(docs, op3_language.fit(docs), into=found)
    return named.where(F.col(found)["lang_pred"] != "und").drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints the document with the smallest doc_id; rows with a null doc_id stay.

    Groups are of fingerprints, and each row is decided by its own: an id that
    repeats with another text neither joins two groups nor removes the other
    row. Rows that repeat a doc_id and its text are one document; where ids
    repeat with other texts, each text of a group's smallest id stays.
    """
    prints = materialise(docs.where("doc_id is not null").select("doc_id", op4_simhash.fingerprints("text").alias("_print")), "pipeline-prints")
    distinct = materialise(prints.groupBy("_print").agg(F.min("doc_id").alias("least")).select(F.col("_print").alias("fp"), F.col("_print").alias("rep"), "least"), "pipeline-distinct")
    parts = connected_components(op4_simhash.links(distinct), "pipeline-links")
    named = distinct.join(parts, distinct["rep"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "rep").alias("part"))
    named = named.join(named.groupBy("part").agg(F.min("least").alias("first")), "part").select(F.col("fp").alias("_print"), "first")
    found = materialise(prints.join(named, "_print").select("doc_id", "_print", "first"), "pipeline-components")
    repeated = materialise(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    pairs = found.where("doc_id <> first").select("doc_id", "_print").distinct()
    gone = pairs.select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    n = repeated.count()
    if n == 0:
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    again = docs.join(repeated, "doc_id", "left_semi").withColumn("_print", op4_simhash.fingerprints("text"))
    once = again.join(pairs, ["doc_id", "_print"], "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return docs.join(repeated, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = free_name(docs, "_matches")
    return op9_decontamination.with_matches(docs, table(spark, sf_dir, "benchmark"), into=found).where(F.size(found) == 0).drop(found)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids and of what they decode to."""
    return op2_bpe_codec.round_trip(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL can't express trained models and hashes of shingles: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
