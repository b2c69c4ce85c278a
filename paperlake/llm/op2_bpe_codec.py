"""Byte-level BPE encoding and decoding over Arrow batches, with offsets in characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import bpe
from .common import slices, table

#: Texts that are encoded at once.
TEXTS = 128
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long"
ENCODED = "ids array<int>, char_start array<int>, char_end array<int>"


def default_paths() -> tuple[str, str]:
    """Rank file and pattern of the installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _coded(spark: SparkSession, ranks: str, pattern: str, returns: str, row):
    definition = spark.sparkContext.broadcast(bpe.tokenizer_json(ranks))

    @arrow_udf(returns)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = bpe.encoder(definition.value, pattern)
        for batch in batches:
            rows = []
            for a, b in slices(len(batch), TEXTS):
                texts = [t or "" for t in batch.slice(a, b - a).to_pylist()]
                rows += [row(coder, t, ids) for t, ids in zip(texts, coder.encode(texts), strict=True)]
            yield row.build(rows)

    return code


class _Digest:
    """Digest columns of a text: of its ids, and of the bytes that decoding them gives."""

    def __call__(self, coder: bpe.PieceEncoder, text: str, ids):
        return (len(ids), bpe.sha256_hex(coder.ids_text(ids).encode()), bpe.sha256_hex(coder.decode(ids)), coder.offsets(ids, text.encode())[2])

    def build(self, rows):
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["n_tokens", "ids_sha256", "decoded_sha256", "n_split"])


class _Encoded:
    """Ids and the characters that each token covers."""

    def __call__(self, coder: bpe.PieceEncoder, text: str, ids):
        return (ids, *coder.offsets(ids, text.encode())[:2])

    def build(self, rows):
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.StructArray.from_arrays([pa.array([x.astype("int32") for x in c], pa.list_(pa.int32())) for c in columns], ["ids", "char_start", "char_end"])


def encode(df: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text", into: str = "bpe") -> DataFrame:
    """Add struct ``into`` (ids, char_start, char_end) for the whole text of each row.

    A null or empty text has empty arrays. Repeated rows are encoded alike, an
    empty table stays empty, and other columns pass unchanged; a column that is
    already named ``into`` is replaced.
    """
    path, pat = default_paths()
    return df.withColumn(into, _coded(df.sparkSession, ranks or path, pattern or pat, ENCODED, _Encoded())(F.col(text)))


def decode(df: DataFrame, ranks: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add binary ``into``: the bytes of the ids in column ``ids``, null for null.

    Bytes are joined before anything reads them as characters, so a character
    that two tokens share is whole; ids of part of a text may give bytes that
    aren't UTF-8. An id outside the vocabulary is an error.
    """
    path, pat = default_paths()
    definition = df.sparkSession.sparkContext.broadcast(bpe.tokenizer_json(ranks or path))

    @arrow_udf("binary")
    def undo(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = bpe.encoder(definition.value, pat)
        for batch in batches:
            yield pa.array([None if x is None else b"".join(map(coder.token_bytes.__getitem__, x)) for x in batch.to_pylist()], pa.binary())

    return df.withColumn(into, undo(F.col(ids)))


def round_trip(df: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256 and n_split (token boundaries inside a character).

    The ids stay in the worker that made them: only digests leave it. Nulls and
    empty texts have no tokens and the digests of nothing; a null key stays null.
    """
    path, pat = default_paths()
    code = _coded(df.sparkSession, ranks or path, pattern or pat, DIGEST, _Digest())
    return df.select(F.col(key).alias("doc_id"), code(F.col(text)).alias("_d")).select("doc_id", "_d.*")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
