import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.llm import bpe
from paperlake.llm import op2_bpe_codec as codec

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n  \n", "a", "  two  spaces ", "don't you'll I'm", "naïve café — 北京 🤦🏽‍♀️", "‍ x", "<|endoftext|>", "x" * 5000, "é" * 3000, "1234567 ½ ⅷ", "\x00\x01"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.PieceEncoder(bpe.tokenizer_json(RANKS), public_tokenizers.PATTERN)


def test_byte_alphabet_reverses():
    table = bpe.byte_alphabet()
    assert sorted(table) == list(range(256)) and len(set(table.values())) == 256


def test_same_ids_as_tiktoken(coder, reference):
    texts = [t for t in ODD if t] + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text_round_trips(coder, reference, text):
    (ids,) = coder.encode([text])
    assert ids.tolist() == reference.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()
    start, end, split = coder.offsets(ids, text.encode())
    at, bounds = 0, []
    for i in ids:
        bounds.append((at, at + len(coder.token_bytes[i])))
        at = bounds[-1][1]
    chars = np.repeat(np.arange(len(text)), [len(c.encode()) for c in text])
    assert start.tolist() == [int(chars[a]) for a, _ in bounds]
    assert end.tolist() == [int(chars[b - 1]) + 1 for _, b in bounds]
    assert split == sum(1 for _, b in bounds[:-1] if chars[b - 1] == chars[b])


def test_a_full_cache_starts_afresh(reference):
    small = bpe.PieceEncoder(bpe.tokenizer_json(RANKS), public_tokenizers.PATTERN, max_pieces=5)
    for text in ["one two three four", "five six seven eight nine ten eleven", "one two"]:
        assert small.encode([text])[0].tolist() == reference.encode_ordinary(text)
        assert len(small.known) <= max(5, len(text.split()))


def test_round_trip_of_odd_rows(spark, reference):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(None, "null key", 0), (3, "\n\n  \n", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r["doc_id"], r["decoded_sha256"]): r for r in codec.round_trip(df).collect()}
    assert codec.round_trip(df).count() == len(rows)
    for k, text, _ in rows:
        data = (text or "").encode()
        ids = reference.encode_ordinary(text or "")
        r = got[k, hashlib.sha256(data).hexdigest()]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_the_query_is_the_library_over_the_whole_table(spark, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = codec.op2_bpe_codec(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_encode_and_decode_columns(spark, reference):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(ODD)], "doc_id long, text string, bpe string")
    out = codec.decode(codec.encode(df).selectExpr("doc_id", "text", "bpe.*"))
    for r in out.collect():
        assert r["ids"] == reference.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert len(r["char_start"]) == len(r["char_end"]) == len(r["ids"])


def test_decoding_handles_split_characters(spark):
    coder = bpe.PieceEncoder(bpe.tokenizer_json(RANKS), public_tokenizers.PATTERN)
    (ids,) = coder.encode(["🤦"])
    assert len(ids) > 1
    df = spark.createDataFrame([(ids.tolist(),), (ids[:1].tolist(),), (None,), ([],)], "ids array<int>")
    got = [None if r["decoded"] is None else bytes(r["decoded"]) for r in codec.decode(df).collect()]
    assert got == ["🤦".encode(), coder.token_bytes[ids[0]], None, b""]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert codec.round_trip(df).columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert codec.round_trip(df).count() == 0 and codec.encode(df).count() == 0
