"""Placement by key: partial aggregates per shard, layout, and plans to rebalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compare import as_scalar
from .paths import Scope


def shard_of(df: DataFrame, path: str, shards: int) -> Column:
    """The shard of a document by Spark's hash of its key."""
    return F.pmod(F.hash(as_scalar(Scope(df.schema).ref(path))), F.lit(shards))


def sharded(df: DataFrame, path: str, shards: int) -> DataFrame:
    """The frame laid out with one partition per shard, so that what groups or joins by the key needn't shuffle."""
    return df.repartition(shards, as_scalar(Scope(df.schema).ref(path)))


def partial_aggregate(df: DataFrame, shard: Column, path: str, by: list[str] | None = None) -> DataFrame:
    """Sums and counts per shard; averages can't be merged, these can."""
    value = Scope(df.schema).ref(path).column.cast("double")
    return df.groupBy(shard.alias("shard"), *(by or [])).agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"))


def merge_partials(partials: DataFrame, by: list[str] | None = None) -> DataFrame:
    grouped = partials.groupBy(*(by or []))
    return grouped.agg((F.sum("sum") / F.sum("count")).alias("avg"), F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


def rebalance_plan(df: DataFrame, old: Column, new: Column) -> DataFrame:
    """How many documents go from which shard to which."""
    return df.select(old.alias("old_shard"), new.alias("new_shard")).groupBy("old_shard", "new_shard").agg(F.count(F.lit(1)).alias("documents"))
