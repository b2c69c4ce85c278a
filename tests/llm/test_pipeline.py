import hashlib
import inspect

import public_tokenizers
import pytest
import tiktoken
from test_decontamination import brute as contaminated
from test_simhash import brute_components, brute_print

import __spark_entry__
import corpus_pipeline
from paperlake.llm import bpe, op1_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "encoding"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    named = __spark_entry__.queries()
    assert "pipeline" in named and corpus_pipeline.ORACLE_SQL is None
    assert {n.split("_")[0] for n in named if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}


def test_all_stages_against_brute_force(spark, documents):
    """Each stage on all that the one before kept, decided anew without it."""
    rows = {r["doc_id"]: r for r in documents.collect()}
    net = op1_toxicity.fit(spark, documents, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = op1_toxicity.Scorer(net)
    kept = [k for k in sorted(rows) if scorer.score([rows[k]["text"] or ""])[0] < 0.5]
    assert 0 < len(kept) < len(rows)
    kept = [k for k in kept if any(c.isalpha() for c in rows[k]["text"] or "")]
    parts = brute_components([brute_print(rows[k]["text"]) for k in kept], kept)
    kept = [k for k, p in zip(kept, parts, strict=True) if k == p]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    held = {d for d, _ in contaminated(items, [(k, rows[k]["text"]) for k in kept])}
    assert held
    kept = [k for k in kept if k not in held]
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for k in kept:
        tokens = reference.encode_ordinary(rows[k]["text"])
        want[k] = (len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(rows[k]["text"].encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_all_but_the_last_stage_return_the_columns_of_documents(spark, documents):
    some = documents.where("doc_id < 60")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, some, SF)
        assert out.schema == some.schema
        kept = {r["doc_id"]: tuple(r) for r in out.collect()}
        rows = {r["doc_id"]: tuple(r) for r in some.collect()}
        assert kept.items() <= rows.items()


def test_odd_rows_pass_every_stage(spark):
    """Null texts, keys and other columns, copies, repeated rows and clashing names."""
    text = "the quick brown fox jumps over the lazy dog and runs away from it"
    rows = [(1, None, None), (2, "", "en"), (3, text, None), (3, text, None), (4, text, "en"), (None, text, "fr"), (None, None, None), (5, "1234", "en"), (6, "other prose " * 9000, "en"), (7, "a different sentence that stands alone in this table", None)]
    docs = spark.createDataFrame([(k, t, lang, 1.0, "x") for k, t, lang in rows], "doc_id long, text string, lang string, bm25 double, component_id string")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, SF).columns == docs.columns
    named = stages["language"](spark, docs, SF)
    assert named.where("doc_id IN (1, 2, 5)").count() == 0
    named = stages["language"](spark, docs.withColumnRenamed("lang", "_l").selectExpr("*", "coalesce(_l, 'en') AS lang").drop("_l"), SF)
    assert ids(named.where("doc_id is not null")) == [3, 3, 4, 6, 7] and named.where("doc_id is null").count() == 1
    once = stages["near_duplicates"](spark, docs, SF)
    assert ids(once.where("doc_id is not null")) == [1, 3, 5, 6, 7] and once.where("doc_id is null").count() == 2
    assert stages["decontamination"](spark, docs, SF).count() == len(rows)
    assert stages["encoding"](spark, docs, SF).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_an_id_that_repeats_with_another_text(spark):
    """Rows are decided by their own text: neither an id's other text nor its group removes them."""
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    a, b = "the quick brown fox jumps over the lazy dog and runs", "colourless green ideas sleep furiously in the old library"
    run = lambda rows: sorted(tuple(r) for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect())
    assert run([(1, a), (3, a), (3, b), (7, b)]) == [(1, a), (3, b)]
    assert run([(3, a), (3, b), (3, b), (7, b), (8, a)]) == [(3, b), (3, a)]
    # the id 3 is the smallest of near copies of b and stands in a group of 1
    base = [f"word{i}" for i in range(3000)]
    variants = [" ".join([*base[:-k], *["other"] * k]) for k in range(1, 200, 5)]
    base = " ".join(base)
    near = next(v for v in variants if brute_print(v) != brute_print(base))
    assert brute_components([brute_print(base), brute_print(near)], [0, 1]) == [0, 0]
    assert run([(1, a), (3, a), (3, base), (7, near), (7, b), (9, b)]) == [(1, a), (3, base), (7, b)]
