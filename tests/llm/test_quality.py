import pickle
import zlib

import numpy as np
import pytest

from paperlake.llm import op8_quality as op

SF = "/root/testdata/sf0.01"


def brute(x, y, rows):
    """Probabilities of ``rows`` by the densities of shrunk covariances, inverted whole."""
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z, w, d = (x - centre) / scale, (rows - centre) / scale, x.shape[1]
    sizes = [int((y == c).sum()) for c in (0, 1)]
    spread = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (sizes[0] * spread[0] + sizes[1] * spread[1]) / len(y)
    logs = []
    for c, n in enumerate(sizes):
        share = max(op.TO_POOLED, d / (d + n))
        cov = (1 - share) * spread[c] + share * pooled
        cov = (1 - op.TO_SPHERE) * cov + op.TO_SPHERE * np.eye(d) * np.trace(pooled) / d
        off = w - z[y == c].mean(0)
        logs.append(np.log(n / len(y)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off))
    return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -50, 50)))


def test_scores_are_mahalanobis_log_density_differences():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((200, 5)), rng.standard_normal((90, 5)) @ rng.standard_normal((5, 5)) + 1])
    y = np.array([0] * 200 + [1] * 90)
    assert np.allclose(op.train(x, y).score(x), brute(x, y, x), atol=1e-9)


def test_the_query_is_brute_force_over_the_whole_table(spark):
    """The registered query; at this size every labelled row outside the test fold is learned."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fold = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in texts}
    known = sorted(k for k, v in labels.items() if k in texts and v in (0, 1) and not fold[k])
    ids = sorted(texts)
    x = {k: op.statistics(texts[k] or "") for k in ids}
    want = brute(np.array([x[k] for k in known]), np.array([labels[k] for k in known]), np.array([x[k] for k in ids]))
    got = {r["doc_id"]: r for r in op.op8_quality(spark, SF).collect()}
    assert sorted(got) == ids and all(got[k]["held_out"] == fold[k] and got[k]["predicted"] == int(got[k]["score"] >= 0.7) for k in ids)
    assert np.allclose([got[k]["score"] for k in ids], want, atol=1e-6)


def test_rows_that_repeat_a_key_are_learned_alike_in_any_order(spark):
    rows = [(i, float(i % 7), float(i % 2)) for i in range(60)] + [(i, float(i % 5), 3.0) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    pad = [0.0] * (len(op.NAMES) - 2)
    frames = [spark.createDataFrame([(k, [a, b, *pad]) for k, a, b in x], "doc_id long, features array<double>").repartition(n) for x, n in ((rows, 1), (rows[::-1], 4))]
    assert pickle.dumps(op.fit(frames[0], labels)) == pickle.dumps(op.fit(frames[1], labels))


@pytest.mark.parametrize("text", ["", " ", "\n\n", "one", "x" * 100_000, "a b " * 20_000, "é 北京 🤦", "12 34", "line\nline\nline", "\x00"])
def test_statistics_are_finite(text):
    v = op.statistics(text)
    assert len(v) == len(op.NAMES) and np.isfinite(v).all()


def test_statistics_of_a_text():
    v = dict(zip(op.NAMES, op.statistics("One two two.\nOne two two.\n3"), strict=True))
    assert v["words"] == pytest.approx(np.log1p(7))
    assert v["line_copies"] == pytest.approx(np.log((1 + 0.5) / (3 - 1 + 0.5)))
    assert v["distinct"] == pytest.approx(np.log((4 + 0.5) / (7 - 4 + 0.5)))
    assert v["digit"] == pytest.approx(np.log((1 + 0.5) / (27 - 1 + 0.5)))


def test_tiny_and_constant_classes():
    assert op.train(np.zeros((0, 3)), np.zeros(0)) is None and op.train(np.ones((4, 3)), np.ones(4)) is None
    model = op.train(np.array([[1.0, 2.0], [1.0, 2.0], [5.0, 2.0]]), np.array([0, 0, 1]))
    assert np.isfinite(model.score(np.array([[1.0, 2.0], [5.0, 2.0], [1e9, -1e9]]))).all()


def test_odd_rows(spark):
    good, bad = "A sentence of plain prose, and one more. ", "$$$ ### 999 !!! "
    rows = [(i, (good if i % 2 else bad) * (2 + i % 5)) for i in range(80)] + [(900, None), (901, ""), (None, good), (902, good * 9000), (902, good * 9000)]
    df = spark.createDataFrame([(*r, 3.0, "x") for r in rows], "doc_id long, text string, score double, features string")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(80)), (None, 1), (900, 1), (901, None), (902, 5)], "doc_id long, quality int")
    got = op.quality(df, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert len({r["score"] for r in got if r["doc_id"] in (900, 901)}) == 1


def test_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in op.quality(docs, none).collect()] == [(0.0, 0)]
    assert op.quality(docs.limit(0), none).collect() == []


def test_held_out_labels_do_not_reach_the_model(spark):
    features = op.measured(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "features")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - quality, quality) AS quality")
    assert pickle.dumps(op.fit(features, labels)) == pickle.dumps(op.fit(features, flipped))


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in op.op8_quality(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
