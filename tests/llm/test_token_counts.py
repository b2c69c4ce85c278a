import public_tokenizers
from tokenizers import Tokenizer

from paperlake.llm import op7_token_counts as op

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "plain words", "plain words", "a <|endoftext|> b", "<|endoftext|>", "x" * 9000, "word " * 1024, "word " * 1025, "日本語 🤦", " \n\t "]


def expected(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_are_the_librarys(spark, tmp_path):
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(TEXTS)] + [(None, "null key", 0)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in op.count_tokens(df, f"file://{tmp_path}/cache").collect()}
    assert len(got) == len(TEXTS) + 1 and got[None]["n_tokens"] == expected(["null key"])[0]
    for i, n in enumerate(expected(TEXTS)):
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((TEXTS[i] or "").encode()), n > 1024)


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    first = spark.createDataFrame([(1, "one"), (2, "one"), (3, "two")], "doc_id long, text string")
    op.count_tokens(first, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    more = first.union(spark.createDataFrame([(4, "three"), (5, "two")], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in op.count_tokens(more, cache).collect()) == [1, 2, 3, 4, 5]
    assert spark.read.parquet(cache).count() == 3
    op.count_tokens(more, cache, tokenizer=public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert spark.read.parquet(cache).count() == 3


def test_another_tokenizer_has_counts_of_its_own(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1, "one <|endoftext|> two")], "doc_id long, text string")
    op.count_tokens(df, cache).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    other = str(tmp_path / "other.json")
    plain = t.to_str().replace("<|endoftext|>", "<|other|>")
    with open(other, "w", encoding="utf-8") as f:
        f.write(plain)
    got = op.count_tokens(df, cache, tokenizer=other).collect()[0]["n_tokens"]
    assert got == len(Tokenizer.from_str(plain).encode("one <|endoftext|> two", add_special_tokens=False).ids)
    assert spark.read.parquet(cache).count() == 2


def test_copies_in_the_cache_count_once(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    op.count_tokens(df, cache).collect()
    spark.read.parquet(cache).union(spark.read.parquet(cache)).write.parquet(f"{cache}-twice")
    assert op.count_tokens(df, f"{cache}-twice").count() == 1


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.count_tokens(df, f"file://{tmp_path}/cache").collect() == []


def test_whole_table(spark):
    got = {r["doc_id"]: r["n_tokens"] for r in op.op7_token_counts(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r["doc_id"] for r in rows], expected([r["text"] for r in rows]), strict=True))


def test_a_filled_cache_gives_the_same_and_gets_nothing_new(spark, tmp_path):
    key = lambda r: r["doc_id"]
    assert sorted(op.token_counts_cached(spark, SF).collect(), key=key) == sorted(op.op7_token_counts(spark, SF).collect(), key=key)
    docs, cache = spark.read.parquet(f"{SF}/documents.parquet"), f"file://{tmp_path}/cache"
    op.count_tokens(docs, cache)
    n = spark.read.parquet(cache).count()
    op.count_tokens(docs, cache)
    assert spark.read.parquet(cache).count() == n
