"""Things that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of this machine where driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_roots:
        _fallback_roots[app] = "file://" + tempfile.mkdtemp(prefix="paperlake-")
    return _fallback_roots[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/paperlake/{tag}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until the frame has no column called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def split_number(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string")) % F.lit(modulus)


def is_held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True for the test fold. A row without a key can't be learned from, so it counts as held out."""
    return F.coalesce(split_number(key, modulus) == F.lit(remainder), F.lit(True))


def slices(n: int, step: int) -> Iterator[tuple[int, int]]:
    for at in range(0, n, step):
        yield at, min(n, at + step)


def spanning_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node of each one's component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        fu, fv = label[u], label[v]
        if np.array_equal(fu, fv):
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(fu, fv), np.minimum(fu, fv))
        while True:
            above = label[label]
            if np.array_equal(above, label):
                break
            label = above


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """For each edge (u, v) the pair of v and the m that ``least`` (u, m) has for u, as (a, b).

    The join's key is another expression than the one that ``least`` was grouped
    by, so that both sides are dealt out anew and the adaptive skew join can
    split the rows of a hub.
    """
    key = F.bitwise_not(F.col("u"))
    return edges.withColumn("_t", key).join(least.select(key.alias("_t"), "m"), "_t").select(F.col("v").alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """Components of undirected ``edges`` (a, b: long) as (node, component), component the smallest node.

    Large-star and small-star rounds as joins with a minimum per node, so that
    no node's neighbours are gathered. Each round's edges are written to the shared folder.
    Nodes without edges, and nulls, aren't in the result.
    """
    spark = edges.sparkSession

    def canonical(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, tag)
        df.write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, path = written(canonical(edges))
    said = summary(now)
    while said[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both.where("v > u"), least)
        now, middle = written(canonical(large))
        delete_path(spark, path)
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(now, least)
        now, path = written(canonical(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))))
        delete_path(spark, middle)
        before, said = said, summary(now)
        if said == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
