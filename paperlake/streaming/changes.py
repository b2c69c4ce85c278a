"""The change feed as a stream, its application to a copy, and time-to-live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.paths import Scope
from ..sources.store import CHANGES, Store


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    """The change log of a store as a stream; offsets are the checkpoint's. Only committed changes are ever in the log."""
    Store(spark, root).publish()
    return spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/_changes")


def collapse(changes: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last change of each key. One row per key and task is shuffled, as the greatest struct, not each key's history."""
    rest = [c for c in changes.columns if c not in key and c != seq]
    last = changes.groupBy(*key).agg(F.max(F.struct(seq, *rest)).alias("_last"))
    return last.select(*key, *[F.col("_last")[c].alias(c) for c in (seq, *rest)])


def apply_changes(base: DataFrame, changes: DataFrame, id_column: str = "_id") -> DataFrame:
    """A copy after changes: keys that changed leave it, and come back unless the last change is a delete."""
    last = collapse(changes.select("seq", "op", "id", "document"), ["id"])
    stay = base.join(last.select(F.col("id").alias(id_column)), id_column, "left_anti").select(base.columns)
    new = last.where("op <> 'delete'").select(F.from_json("document", base.schema).alias("d")).select("d.*")
    return stay.unionByName(new.select(base.columns))


def follow(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Start a query that hands each batch's collapsed changes to ``upsert``, which a batch number lets be repeated."""

    def batch(df: DataFrame, number: int) -> None:
        upsert(collapse(df, ["collection", "id"]), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def expired(df: DataFrame, field: str, now: Column) -> Column:
    """Whether a document's time has come: a timestamp, or a number of milliseconds, at or before ``now``. Absent never."""
    ref = Scope(df.schema, variant="_doc" if df.columns == ["_doc"] else None).ref(field)
    if isinstance(ref.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        due = ref.column <= now
    elif isinstance(ref.kind, T.NumericType):
        due = ref.column <= F.unix_millis(now)
    elif isinstance(ref.kind, T.VariantType):
        kind = F.schema_of_variant(ref.column)
        due = F.when(kind == "STRING", F.try_to_timestamp(F.try_variant_get(ref.column, "$", "string")) <= now).when(kind == "BIGINT", F.try_variant_get(ref.column, "$", "long") <= F.unix_millis(now))
    else:
        due = F.lit(False)
    return F.coalesce(due, F.lit(False))


def sweep_every(spark: SparkSession, sweep: Callable[[], int], interval: str, checkpoint: str):
    """Start a query that calls ``sweep`` - a session's - at every interval until it is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
    return ticks.writeStream.foreachBatch(lambda df, number: sweep()).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts per tumbling window and keys; what comes later than ``late`` behind the stream is left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("count"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by a window, for frames whose rows are wide and keys have few."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
