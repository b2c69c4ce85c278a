"""JSON documents in and out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIANT = "_doc"
#: Strings of this form are moments; a day without a time stays text.
MOMENT = "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS][.SSSSSSS][.SSSSSS][.SSS][XXX]"


def from_lines(lines: DataFrame, schema: str | T.StructType | None = None, mode: str = "auto") -> DataFrame:
    """Documents from a frame with one string column of JSON.

    ``schema`` gives typed columns. Without one, ``auto`` infers the types and
    stays typed while every field has one type; ``variant`` keeps each document
    as a VARIANT in column ``_doc``. ISO strings with a ``T`` become timestamps
    where every value of the field is one.
    """
    column = F.col(lines.columns[0])
    if mode == "auto" and schema is None:
        kind = lines.select(F.schema_of_variant_agg(F.parse_json(column))).first()[0] or "VOID"
        mode = "variant" if "VARIANT" in kind or not kind.startswith("OBJECT") else "typed"
    if mode == "variant":
        return lines.select(F.parse_json(column).alias(VARIANT))
    if schema is None:
        schema = _inferred(lines.select(column.alias("value")))
    return lines.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def _inferred(lines: DataFrame) -> T.StructType:
    """The types of JSON texts, found in the JVM."""
    spark = lines.sparkSession
    texts = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark._jsparkSession.read().option("inferTimestamp", "true").option("timestampFormat", MOMENT)
    return T.StructType.fromJson(json.loads(reader.json(texts).schema().json()))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, mode: str = "auto", multi_line: bool = False) -> DataFrame:
    """A file or folder of JSON lines, or with ``multi_line`` of JSON arrays."""
    if multi_line:
        reader = spark.read.option("multiLine", "true").option("inferTimestamp", "true").option("timestampFormat", MOMENT)
        return (reader.schema(schema) if schema else reader).json(path)
    return from_lines(spark.read.text(path), schema, mode)


def from_texts(spark: SparkSession, texts: list[str], schema: str | T.StructType | None = None, mode: str = "auto") -> DataFrame:
    """Documents given as JSON texts in the program."""
    return from_lines(spark.createDataFrame([(t,) for t in texts], "value string"), schema, mode)


def to_json(df: DataFrame) -> DataFrame:
    """One column ``json`` with each document's text."""
    if df.columns == [VARIANT]:
        return df.select(F.to_json(VARIANT).alias("json"))
    if VARIANT in df.columns and isinstance(df.schema[VARIANT].dataType, T.VariantType):  # a schemaless document with its id and version
        head = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("variant").alias("value")) for c in df.columns if c != VARIANT]
        own = F.map_from_entries(F.filter(F.array(*head), lambda e: e["value"].isNotNull()))
        fields = F.coalesce(F.from_json(F.to_json(VARIANT), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        return df.select(F.to_json(F.map_concat(own, fields)).alias("json"))
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def stream_lines(df: DataFrame, message: str = "ok") -> Iterator[str]:
    """JSON lines of a result, partition by partition, behind a line that describes it."""
    yield json.dumps({"success": True, "message": message, "columns": df.columns})
    for row in to_json(df).toLocalIterator():
        yield row["json"]


def flatten(df: DataFrame) -> DataFrame:
    """A grid of strings: nested values as compact JSON."""
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields])


def export(collections: dict[str, DataFrame], path: str, database: str = "default") -> dict:
    """Write each collection as JSON lines below ``path``; gives what was written."""
    for name, df in collections.items():
        to_json(df).select(F.col("json").alias("value")).write.mode("overwrite").text(f"{path}/{name}")
    return {"database": database, "exportedAtUtc": datetime.now(timezone.utc).isoformat(), "collections": sorted(collections)}
