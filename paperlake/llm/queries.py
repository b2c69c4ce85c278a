"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op5_embeddings as op5
from . import op6_sharding
from .op1_toxicity import op1_toxicity
from .op2_bpe_codec import op2_bpe_codec
from .op3_language import op3_language
from .op4_simhash import op4_simhash
from .op5_embeddings import op5_embeddings
from .op7_token_counts import op7_token_counts, token_counts_cached
from .op8_quality import op8_quality
from .op9_decontamination import op9_decontamination
from .op10_licenses import op10_licenses


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bpe_codec, op3_language, op4_simhash, op5_embeddings, op6_sharding.op6_sharding, op7_token_counts, op8_quality, op9_decontamination, op10_licenses)} | {"pipeline": pipeline, "sharding_64k": op6_sharding.sharding_64k, "token_counts_cached": token_counts_cached}
SQL = {"op5_embeddings": op5.SQL, "op6_sharding": op6_sharding.sql(op6_sharding.LIMIT), "sharding_64k": op6_sharding.sql(op6_sharding.SMALL)}
