"""Token counts by a digest cache: encode only contents that no earlier run, and no other row, has had."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import bpe
from .common import materialise, new_path, slices, table

SCHEMA = "tokenizer binary, content binary, n_tokens long"
TEXTS = 128
MAX_TOKENS = 1024
#: Digests of misses are broadcast up to this many, else joined by a shuffle.
BROADCAST_DIGESTS = 200_000


@functools.lru_cache(2)
def _counter(definition: str, pattern: str):
    """Counts of texts as the library gives them for a byte-level definition with ``pattern``.

    A text that holds the string of an added token goes to the library whole,
    as the library cuts it there before it looks for pieces.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(definition)
    whole.no_padding()
    whole.no_truncation()
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    pieces = bpe.PieceEncoder(definition, pattern)

    def counts(texts: list[str]) -> list[int]:
        plain = [not any(s in t for s in special) for t in texts]
        fast = iter(pieces.count([t for t, p in zip(texts, plain, strict=True) if p]))
        slow = iter(whole.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [next(fast) if p else len(next(slow).ids) for p in plain]

    return counts


def count_tokens(df: DataFrame, cache: str, tokenizer: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", limit: int = MAX_TOKENS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of the whole text.

    ``cache`` is a path in a store that all executors share. Content is the text
    with null made empty; its digest and that of the tokenizer's file are looked
    up there, distinct misses are encoded once and appended before the result is
    read from the cache. Another tokenizer's counts never match. Copies, however
    many, are encoded once; texts meet by digest with one row from each map task.
    Null keys stay null, repeated rows are each returned, an empty table gives none.
    """
    import public_tokenizers

    spark = df.sparkSession
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    pattern = pattern or public_tokenizers.PATTERN
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    version = bytes.fromhex(bpe.sha256_hex(definition.encode()))
    sent = spark.sparkContext.broadcast(definition)

    @arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = _counter(sent.value, pattern)
        for batch in batches:
            out: list[int] = []
            for a, b in slices(len(batch), TEXTS):
                out += counts(batch.slice(a, b - a).to_pylist())
            yield pa.array(out, pa.int64())

    content = F.coalesce(F.col(text), F.lit(""))
    named = df.select(F.col(key).alias("doc_id"), content.alias("_text")).withColumn("digest", F.sha2("_text", 256))
    misses = named.select("digest", "_text")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        # digests alone are looked up; only the texts of misses are moved
        missing = materialise(named.select("digest").distinct().join(_stored(spark, cache, version), "digest", "left_anti"), "token-misses")
        missing = F.broadcast(missing) if missing.count() <= BROADCAST_DIGESTS else missing
        misses = misses.join(missing, "digest", "left_semi")
    new = misses.groupBy("digest").agg(F.first("_text").alias("_text"))
    new.select(F.lit(version).alias("tokenizer"), F.unhex("digest").alias("content"), n_tokens("_text").alias("n_tokens")).write.mode("append").parquet(cache)
    sized = named.select("doc_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes"))
    return sized.join(_stored(spark, cache, version), "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark: SparkSession, cache: str, version: bytes) -> DataFrame:
    """One count per digest of this tokenizer, also where two runs have appended the same.

    The digest is another expression than the grouped one, so that a join deals
    it out anew and Spark can split the rows of a content with many copies.
    """
    rows = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == F.lit(version))
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")).select(F.lower(F.hex("content")).alias("digest"), "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query begins with an empty cache of its own, so that its result and its cost depend on its input alone."""
    return count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-counts"))


def token_counts_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with a cache that an earlier run has filled: no text is encoded or moved."""
    docs, cache = table(spark, sf_dir, "documents"), new_path(spark, "token-counts")
    count_tokens(docs, cache)
    return count_tokens(docs, cache)
