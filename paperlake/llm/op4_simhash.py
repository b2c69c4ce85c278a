"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in few bits agree in one of a few bands of bits.
Distinct fingerprints meet by band; a bucket that is too large is divided by
the same rule over the bits that it hasn't fixed yet, so no pair is lost and no
bucket is compared whole that a finer key can divide. Within buckets, bit
planes are stored vertically and carry-save counters hold many distances at
once; a block is left as soon as all its distances exceed the radius.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import connected_components, materialise, slices, spanning_roots, table

RADIUS = 3
BANDS = RADIUS + 1
SHINGLE = 3
#: Fingerprints in a bucket beyond which it is divided; at most LEVELS times.
BUCKET, LEVELS = 1024, 5
#: Divided buckets are broadcast up to this many, else joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Rows compared at once, and 64-row words of a block.
ROWS, BLOCK = 1 << 16, 512

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str) -> int:
    """Bits set in over half of the hashes of the shingles of a whole text; 0 without words."""
    words = _WORDS.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for a, b in slices(n, 1 << 15):
        ones += np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: str) -> Column:
    @arrow_udf("long")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [fingerprint(t or "") for a, b in slices(len(batch), 256) for t in batch.slice(a, b - a).to_pylist()]
            yield pa.array(np.array(out, dtype=np.uint64).view(np.int64), pa.int64())

    return made(F.col(text))


def band_masks(levels: int = LEVELS) -> list[list[int]]:
    """For each level, the bits that each path of bands has fixed; path p's children are 4p to 4p+3."""
    out, above = [], [0]
    for _ in range(levels):
        here = []
        for mask in above:
            free = [b for b in range(64) if not mask >> b & 1]
            for part in np.array_split(free, BANDS):
                here.append(mask | sum(1 << int(b) for b in part))
        out.append(here)
        above = here
    return out


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """Bit b of fingerprint i as bit i of row b; a word of zeros ends each row."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = -(-len(fp) // 64)
    planes = np.zeros((64, (words + 1) * 8), dtype=np.uint8)
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    return planes.view(np.uint64)


def near_at(planes: np.ndarray, lag: int, same: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Rows that are within ``radius`` (at most 3) of the row ``lag`` further and, by the bits of ``same``, may be."""
    step, shift = divmod(lag, 64)
    words = planes.shape[1] - 1 - step
    found = []
    for a, b in slices(words, BLOCK):
        over = ~same[a:b]
        ones, twos = np.zeros_like(over), np.zeros_like(over)
        for k in range(0, 64, 2):
            if k % 8 == 0 and not (~over).any():
                break  # all distances of the block exceed the radius
            x = planes[k : k + 2, a + step : b + step]
            if shift:
                x = (x >> np.uint64(shift)) | (planes[k : k + 2, a + step + 1 : b + step + 1] << np.uint64(64 - shift))
            x = x ^ planes[k : k + 2, a:b]
            half = ones ^ x[0]
            carry = (ones & x[0]) | (half & x[1])
            ones = half ^ x[1]
            over |= twos & carry
            twos ^= carry
        else:
            if radius < 3:
                over |= {0: ones | twos, 1: twos, 2: ones & twos}[radius]
            if (~over).any():
                found.append(np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")) + a * 64)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def near_pairs(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions of one group, whose rows stand together, within ``radius`` bits; groups of like size side by side."""
    left, right = [], []
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(first, len(group)))
    of_row = np.repeat(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), sizes)
    number = np.repeat(np.arange(len(first)), sizes)
    for c in np.unique(of_row):
        if c == 0:
            continue
        rows = np.flatnonzero(of_row == c)
        planes, g = bit_planes(np.ascontiguousarray(fp[rows])), number[rows]
        words = planes.shape[1] - 1
        for lag in range(1, int(sizes[g].max())):
            same = np.zeros(words * 8, dtype=np.uint8)
            bits = np.packbits(g[:-lag] == g[lag:], bitorder="little")
            same[: len(bits)] = bits
            i = near_at(planes, lag, same.view(np.uint64), radius)
            left.append(rows[i])
            right.append(rows[i + lag])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of buckets that come one after another, sorted by (path, key)."""
    held: list[np.ndarray] = []
    n = 0

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
        i, j = near_pairs(rows[:, 2].copy().view(np.uint64), np.cumsum(new))
        nodes, roots = spanning_roots(rows[i, 3], rows[j, 3])
        kept = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(roots[kept])], ["a", "b"])

    for batch in batches:
        rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
        held.append(rows)
        n += len(rows)
        if n < ROWS:
            continue
        rows = np.concatenate(held)
        cut = len(rows) - int(np.argmax((rows[::-1, :2] != rows[-1, :2]).any(1)))
        if (rows[0, :2] == rows[-1, :2]).all():
            held = [rows]  # one bucket so far
            continue
        yield links(rows[:cut])
        held, n = [rows[cut:]], len(rows) - cut
    if n:
        yield links(np.concatenate(held))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Spanning links (a, b) between the representatives of distinct fingerprints (fp, rep) within the radius."""
    masks = band_masks()
    level = distinct.select("fp", "rep", F.lit(0).alias("path"))
    found = None
    for k, here in enumerate(masks):
        signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in here])
        child = F.col("path") * BANDS + F.col("_band") if k else F.col("_band")
        rows = level.withColumn("_band", F.explode(F.array(*map(F.lit, range(BANDS))))).withColumn("path", child)
        rows = rows.select("path", F.col("fp").bitwiseAND(F.get(signed, F.col("path"))).alias("key"), "fp", "rep")
        large = None
        if k + 1 < len(masks):
            large = materialise(rows.groupBy("path", "key").count().where(F.col("count") > bucket).select("path", "key"), "simhash-large")
            n = large.count()
            large = None if n == 0 else F.broadcast(large) if n <= BROADCAST_KEYS else large
        small = rows if large is None else rows.join(large, ["path", "key"], "left_anti")
        edges = small.repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInArrow(_bucket_edges, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if large is None:
            break
        level = rows.join(large, ["path", "key"], "left_semi").select("fp", "rep", "path")
    return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, fingerprint and component_id of the whole text.

    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null key keep their fingerprint; they stand in no chain of links, and
    their component is that of their fingerprint's other rows, null without any.
    Repeated rows are each returned; an empty table gives none.
    """
    prints = materialise(df.select(F.col(key).cast("long").alias("doc_id"), fingerprints(text).alias("fp")), "simhash")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "simhash-distinct")
    parts = connected_components(links(distinct, bucket), "simhash-links")
    named = distinct.join(parts, distinct["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
