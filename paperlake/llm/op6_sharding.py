"""Sharding by extendible hashing.

A key's hash is read bit by bit. A shard is a prefix of those bits; only a
shard over the byte limit is split on its next bit. The directory has an entry
for each prefix of some length, and says how many bits its shard uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, table

#: Bytes of text of a shard.
LIMIT = 64 << 20
SMALL = 64 << 10
BITS = 32
#: Bits of the directory beyond those that even shards would need, and bits that are added where a cell is still too large.
SLACK, STEP = 4, 6
#: Directories of so many entries are broadcast, larger ones joined by a shuffle.
BROADCAST_CELLS = 1 << 20


def hash_bits(key: Column) -> Column:
    """The first 32 bits of the MD5 digest of the key as text, as a long; of ``null`` for a null key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """(cell, bits, depth, shard_bytes, shard_rows): the cells of the directory, by the length of their prefix, and their shards.

    ``sizes``: h and n_bytes. Bytes are summed per cell before anything is
    shuffled; the sums of shorter prefixes come from the cells. Cells that are
    over the limit at the directory's length, and only those, are cut further.
    """
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(BITS, max(0, (int(total) // limit).bit_length()) + SLACK)
    done, least = None, 0
    todo = sizes
    while True:
        cells = materialise(todo.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")), "shard-cells")
        over = cells.where((F.col("n_bytes") > limit) & F.lit(bits < BITS)).select(F.col("cell").alias("over"))
        depths = F.explode(F.sequence(F.lit(least), F.lit(bits)))
        sums = cells.select("n_bytes", "n_rows", "cell", depths.alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        sums = sums.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows")).where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        entries = cells.select("cell", depths.alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        entries = entries.join(sums, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("s"))
        entries = entries.select("cell", F.lit(bits).alias("bits"), "s.depth", "s.shard_bytes", "s.shard_rows")
        done = entries if done is None else done.unionByName(entries)
        if bits >= BITS or over.isEmpty():
            return done
        # rows of cells that are too large go on with more bits, and can't stop before those
        todo = todo.withColumn("_c", F.shiftright("h", BITS - bits)).join(over, F.col("_c") == F.col("over"), "left_semi").drop("_c")
        least = bits + 1
        bits = min(BITS, bits + STEP)


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8 of the text, null 0), depth, shard (its prefix in bits), shard_bytes and page.

    Shards hold ``limit`` bytes at most. What no bit can part - one longer text,
    or rows with one key - is a shard of full depth that is cut into pages of
    at most ``limit`` bytes or one row; page is 0 elsewhere.
    Null keys share a hash and so a shard with its pages; an empty table gives no rows.
    """
    sizes = materialise(_sized(df, key, text), "shard-sizes")
    return _placed(sizes, materialise(directory(sizes, limit), "shard-directory"), limit).drop("h")


def _sized(df: DataFrame, key: str, text: str, *carried: str) -> DataFrame:
    return df.select(*carried, F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col(f"`{key}`")).alias("h"))


def _placed(sizes: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """Rows with doc_id, n_bytes and h, and whatever else they have, in their shards and pages."""
    carried = [c for c in sizes.columns if c not in ("doc_id", "n_bytes", "h")]
    if entries.count() <= BROADCAST_CELLS:
        entries = F.broadcast(entries)
    lengths = [r["bits"] for r in entries.select("bits").distinct().orderBy("bits").collect()]
    rows = sizes.withColumn("_at", F.explode(F.array(*map(F.lit, lengths)))) if len(lengths) > 1 else sizes.withColumn("_at", F.lit(lengths[0] if lengths else 0))
    rows = rows.withColumn("_cell", F.expr(f"shiftright(h, {BITS} - _at)"))
    rows = rows.join(entries, (F.col("_at") == F.col("bits")) & (F.col("_cell") == F.col("cell")))
    shard = F.when(F.col("depth") == 0, "").otherwise(F.expr(f"substring(lpad(bin(h), {BITS}, '0'), 1, depth)"))
    out = rows.select("doc_id", "n_bytes", "depth", shard.alias("shard"), "shard_bytes", "h", *carried)
    fits = out.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    return fits.unionByName(_paged(out.where(F.col("shard_bytes") > limit), limit))


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of shards of full depth that are over the limit.

    Rows are dealt over blocks first, so that a shard's rows don't meet in one
    task: a block numbers its own pages, and begins after the pages of those
    before it, of which only the numbers are gathered.
    """
    kept = materialise(rows.withColumn("_block", F.spark_partition_id()), "shard-pages")
    if kept.isEmpty():
        return rows.withColumn("page", F.lit(0).cast("long"))
    inner = Window.partitionBy("h", "_block").orderBy("doc_id", "n_bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = kept.withColumn("_sum", F.sum("n_bytes").over(inner)).withColumn("_long", F.col("n_bytes") * 2 > limit)
    # rows of half the limit at most that end in one stretch of half the limit fit together; a longer row has its own page
    cell = F.when(F.col("_long"), F.col("_sum")).otherwise(F.floor((F.col("_sum") - 1) / F.lit(max(1, limit // 2))))
    numbered = numbered.withColumn("_cell", cell).withColumn("_rank", F.dense_rank().over(Window.partitionBy("h", "_block").orderBy("_long", "_cell")))
    blocks = numbered.groupBy("h", "_block").agg(F.max("_rank").alias("_pages"))
    before = Window.partitionBy("h").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("h", "_block", F.coalesce(F.sum("_pages").over(before), F.lit(0)).alias("_before"))
    return numbered.join(offsets, ["h", "_block"]).select(*rows.columns, (F.col("_rank") + F.col("_before") - 1).cast("long").alias("page"))


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Write the table's rows, all columns as they are, below ``path`` in a folder for each shard and page, and return the assignment.

    Each row goes to its own page, so that rows of one key are in as many pages
    as ``assign`` says and no file's texts are over the limit, but for one
    longer text. The folders' columns are ``shard`` (an ``s`` before its bits,
    so that readers keep leading zeros) and ``page``, with underscores before
    them where the table has such columns itself.
    """
    sizes = materialise(_sized(df, key, text), "shard-sizes")
    entries = materialise(directory(sizes, limit), "shard-directory")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), whole)
    placed = _placed(_sized(rows, "_key", "_text", "_row"), entries, limit)
    shard, page = free_name(df, "shard"), free_name(df, "page")
    out = placed.select("_row.*", F.concat(F.lit("s"), "shard").alias(shard), F.col("page").alias(page))
    out.repartition(shard, page).write.partitionBy(shard, page).parquet(path)
    return placed.drop("h", "_row")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def sharding_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with a limit of 64 KiB, at which small tables have shards of many depths."""
    return assign(table(spark, sf_dir, "documents"), limit=SMALL)


def sql(limit: int) -> str:
    """Each row's least depth at which its prefix fits. A shard of full depth is one text here, as keys differ: page 0."""
    return f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h
  FROM documents
), p AS (
  SELECT depth, h >> ({BITS} - depth) AS prefix, sum(n_bytes) AS shard_bytes
  FROM d, (SELECT unnest(generate_series(0, {BITS})) AS depth) GROUP BY ALL
), s AS (
  SELECT d.doc_id, d.h, any_value(d.n_bytes) AS n_bytes, min(p.depth) AS depth
  FROM d JOIN p ON p.prefix = d.h >> ({BITS} - p.depth)
  WHERE p.shard_bytes <= {limit} OR p.depth = {BITS} GROUP BY d.doc_id, d.h
)
SELECT s.doc_id, s.n_bytes, CAST(s.depth AS INTEGER) AS depth,
       left(CAST(CAST(s.h AS BIT) AS VARCHAR)[-{BITS}:], CAST(s.depth AS INTEGER)) AS shard,
       CAST(p.shard_bytes AS BIGINT) AS shard_bytes, CAST(0 AS BIGINT) AS page
FROM s JOIN p ON p.depth = s.depth AND p.prefix = s.h >> ({BITS} - s.depth)
"""
