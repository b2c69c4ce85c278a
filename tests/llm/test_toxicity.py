import pickle
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from paperlake.llm import op1_toxicity as op

SF = "/root/testdata/sf0.01"
RNG = np.random.default_rng(0)
BAD = ["scumbag", "idiots", "worthless"]


def prose(n):
    return " ".join("".join(RNG.choice(list("aeioulnrst"), int(RNG.integers(2, 9)))) for _ in range(n))


def insulting(n, at):
    words = prose(n).split()
    words[at:at] = [str(RNG.choice(BAD)), str(RNG.choice(BAD))]
    return " ".join(words)


@pytest.fixture(scope="module")
def net():
    texts = [prose(int(RNG.integers(5, 120))) for _ in range(300)]
    toxic = [insulting(n := int(RNG.integers(5, 120)), int(RNG.integers(n))) for _ in range(150)]
    return op.train(texts + toxic, [0] * 300 + [1] * 150)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    p = {"E": np.zeros((2, op.WORD_DIM)), "G": np.zeros((op.GRAMS, op.CHAR_DIM - 1)), "v": rng.standard_normal(2 * op.HIDDEN), "w": rng.standard_normal(2 * op.HIDDEN), "c": np.zeros(1)}
    for d in "fb":
        p |= {"W" + d: rng.standard_normal((op.WORD_DIM + op.CHAR_DIM, 3 * op.HIDDEN)) * 0.4, "U" + d: rng.standard_normal((op.HIDDEN, 3 * op.HIDDEN)) * 0.4, "b" + d: rng.standard_normal(3 * op.HIDDEN) * 0.1}
    net = op.Network({}, np.zeros(op.GRAMS), p)
    x, mask = rng.standard_normal((3, 7, op.WORD_DIM + op.CHAR_DIM)), np.ones((3, 7))
    mask[1, 4:] = 0
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.run(x, mask)["logit"]
        return float((np.logaddexp(0, z) - y * z).sum())

    k = net.run(x, mask)
    g, dx = net.back(k, op.sigmoid(k["logit"]) - y)
    g["x"] = dx
    for name, values in [*((n, p[n]) for n in ("Wf", "Uf", "bf", "Wb", "Ub", "bb", "v", "w", "c")), ("x", x)]:
        for at in [tuple(int(rng.integers(s)) for s in values.shape) for _ in range(6)]:
            was = values[at]
            values[at] = was + 1e-3
            up = loss()
            values[at] = was - 1e-3
            down = loss()
            values[at] = was
            # states are kept in single precision
            assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3), name


def forward(net, text):
    """The probability of a whole text: all its overlapping windows, each by the network's own forward pass."""
    tokens = [op.clean(t) for t in text.split()]
    best = -1e9
    for at in op.starts_of(len(tokens)):
        part = tokens[at : at + op.WINDOW]
        x = np.zeros((1, op.WINDOW, op.WORD_DIM + op.CHAR_DIM), dtype=np.float32)
        mask = np.zeros((1, op.WINDOW), dtype=np.float32)
        if part:
            x[0, : len(part)] = net.inputs(np.array([net.words.get(w, 0) for w in part]), *op.grams(part))
            mask[0, : len(part)] = 1
        best = max(best, float(net.run(x, mask)["logit"][0]))
    return float(op.sigmoid(np.array(best)))


def test_scorer_is_the_networks_forward_pass(net):
    scorer = op.Scorer(net)
    for text in ["", "one", prose(11), prose(24), prose(25), insulting(200, 150), "--- !!! ..."]:
        assert scorer.score([text])[0] == pytest.approx(forward(net, text), abs=1e-4)


def test_the_query_is_brute_force_over_the_whole_table(spark):
    """The registered query: every document's score is the forward pass over its whole text."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    net = op.fit(spark, docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = op.op1_toxicity(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["score"] == pytest.approx(forward(net, texts[r["doc_id"]] or ""), abs=1e-3)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_rows_that_repeat_a_key_are_learned_alike_in_any_order(spark):
    rows = [(100 + i, f"you {'scumbag idiots' if i % 3 == 0 else 'kind people'} of house {i}") for i in range(60)] + [(100 + i, f"a walk to house {i}") for i in range(60)]
    labels = spark.createDataFrame([(100 + i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    nets = [op.fit(spark, spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 1), (rows[::-1], 4))]
    assert pickle.dumps(nets[0].p) == pickle.dumps(nets[1].p)


@pytest.mark.parametrize("n", [1, 11, 12, 13, 24, 25, 36, 37, 500])
def test_windows_cover_every_token(n):
    covered = np.zeros(n, dtype=int)
    for at in op.starts_of(n):
        covered[at : at + op.WINDOW] += 1
    assert covered.min() >= 1 and (n <= 3 * op.STRIDE or covered[op.STRIDE : -2 * op.STRIDE].min() >= 2)


@pytest.mark.parametrize("at", [0, 1500, 2999, 5000, 9999])
def test_an_insult_anywhere_in_a_long_text(net, at):
    scorer = op.Scorer(net)
    assert scorer.score([insulting(10_000, at)])[0] >= 0.5 > scorer.score([prose(10_000)])[0]


def test_a_full_cache_starts_afresh(net):
    a, b = op.Scorer(net), op.Scorer(net, most=20)
    texts = [prose(30) for _ in range(5)] + [insulting(30, 3)]
    assert np.allclose([a.score([t])[0] for t in texts], [b.score([t])[0] for t in texts], atol=1e-6)


def test_training_is_repeatable():
    texts, labels = ["good day to you"] * 5 + ["you scumbag idiots"] * 5, [0] * 5 + [1] * 5
    assert pickle.dumps(op.train(texts, labels).p) == pickle.dumps(op.train(texts, labels).p)
    assert op.train(texts[:5], labels[:5]) is None and op.train([], []) is None and op.train(["", " "], [0, 1]) is None
    assert op.train(["...", "---"], [0, 1]) is not None


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "no key"), (4, "same text"), (4, "same text"), (5, "x" * 100_001), (6, "the worthless idiots " * 4000)]
    docs = [(k, t, 0.5, "x") for k, t in rows] + [(100 + i, insulting(20, 5) if i % 3 == 0 else prose(20), 0.1, "x") for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, held_out string")
    labels = spark.createDataFrame([*((100 + i, int(i % 3 == 0)) for i in range(90)), (1, 1), (None, 1), (4, None), (5, 0), (6, 7)], "doc_id long, toxic int")
    got = op.toxicity(df, labels).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 4}) == 1


def test_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in op.toxicity(docs, none).collect()] == [(0.0, 0)]
    assert op.toxicity(docs.limit(0), none).collect() == []


def test_held_out_labels_do_not_reach_the_network(spark):
    """Other labels in the test fold, and other languages, sources and keys of rows to score, change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    a, b = (op.fit(spark, docs, x) for x in (labels, flipped))
    assert pickle.dumps(a.p) == pickle.dumps(b.p) and a.words == b.words


def test_held_out_accuracy():
    """On the largest of the small tables; some labels there are wrong by design."""
    d = "/root/testdata/sf0.1"
    texts = dict(zip(*(pq.read_table(f"{d}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    toxic = dict(zip(*(pq.read_table(f"{d}/labels.parquet")[c].to_pylist() for c in ("doc_id", "toxic")), strict=True))
    held = sorted(k for k in toxic if zlib.crc32(str(k).encode()) % 5 == 0)
    known = sorted(toxic.keys() - set(held))[:1500]
    net = op.train([texts[k] for k in known], [toxic[k] for k in known])
    scorer = op.Scorer(net)
    y = np.array([toxic[k] for k in held])
    predicted = np.array([scorer.score([texts[k]])[0] >= 0.5 for k in held])
    assert (predicted == y).mean() > 0.95 and predicted[y == 0].mean() < 0.02 and predicted[y == 1].mean() > 0.75
