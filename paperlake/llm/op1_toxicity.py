"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token's input is a trained word vector beside a character vector (the mean
of trained vectors of its hashed character n-grams, and their largest log
odds). Both directions run over windows of ``WINDOW`` tokens that begin every
``STRIDE`` tokens, so every token is scored in two windows; attention pools a
window, and a document scores as its most toxic window does. Labels are of
documents: each epoch picks a document's window by the network so far.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import is_held_out, slices, table

WINDOW, STRIDE = 24, 12
#: Labelled documents of each class that the network is fitted on, the lowest by a hash of their key.
FIT_TOXIC, FIT_CLEAN = 1500, 2500
#: Longest document, in characters, that is fitted on; scoring has no such bound.
FIT_CHARS = 100_000
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORDS, GRAMS = 20_000, 1 << 14
EPOCHS, BATCH, RATE = 6, 128, 0.01
#: Updates at least, and epochs at most: few labels take smaller batches and more epochs.
UPDATES, MOST_EPOCHS = 240, 24
#: Tokens whose input is kept by a worker before it starts afresh.
CACHE_TOKENS = 200_000
CHUNK = 4096


_OUTSIDE = re.compile(r"[\W_]+")


def clean(token: str) -> str:
    """Lower case without punctuation; a token of punctuation alone is one empty word."""
    return _OUTSIDE.sub("", token.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of 3, 4 and 5 characters of the words, begun and ended by marks: those of one word after another, and how many each has."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(points))  # characters from here to the word's end
    hashed = np.zeros((len(points), 3), dtype=np.int64)
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(5):
        h = (h + np.append(points[n:], np.zeros(min(n, len(points)), dtype=np.uint64)) + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
        if n >= 2:
            hashed[:, n - 2] = (h >> np.uint64(40)) % np.uint64(GRAMS)
    has = left[:, None] >= np.array([3, 4, 5])
    first = np.cumsum(lens) - lens
    counts = np.add.reduceat(has.sum(1), first) if len(words) else lens
    return hashed[has], counts


def starts_of(n: int) -> range:
    """Where the windows of ``n`` tokens begin; one at least."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def softsign(x: np.ndarray) -> np.ndarray:
    """The network's squashing function: of candidates, and halved and raised by a half of gates. It needs no exponential."""
    return x / (1 + np.abs(x))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """Parameters: E word and G n-gram vectors, odds of n-grams, and for each direction W, U, b; attention v, output w and c."""

    words: dict[str, int]
    odds: np.ndarray
    p: dict[str, np.ndarray]

    def inputs(self, words: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words by their rows of E and their n-grams."""
        out = np.zeros((len(words), WORD_DIM + CHAR_DIM), dtype=np.float32)
        out[:, :WORD_DIM] = self.p["E"][words]
        some = np.flatnonzero(lens)
        if len(some):
            at = (np.cumsum(lens) - lens)[some]
            out[some, WORD_DIM:-1] = np.add.reduceat(self.p["G"][flat], at) / lens[some, None]
            out[some, -1] = np.maximum.reduceat(self.odds[flat], at)
        return out

    def run(self, x: np.ndarray, mask: np.ndarray) -> dict:
        """Forward over x (windows, tokens, inputs) and mask (windows, tokens), with what backward needs."""
        keep = {"x": x, "mask": mask}
        states = []
        for d in "fb":
            xd, md = (x, mask) if d == "f" else (x[:, ::-1], mask[:, ::-1])
            pre = xd @ self.p["W" + d] + self.p["b" + d]
            h = np.zeros((len(x), HIDDEN), dtype=np.float32)
            steps = []
            for t in range(x.shape[1]):
                a = pre[:, t]
                u = h @ self.p["U" + d]
                s = softsign(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = 0.5 + 0.5 * s[:, :HIDDEN], 0.5 + 0.5 * s[:, HIDDEN:]
                n = softsign(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                m = md[:, t, None]
                steps.append((h, u[:, 2 * HIDDEN :], z, r, n, m))
                h = h + m * (1 - z) * (n - h)
                states.append(h)
            keep[d] = steps
        T = x.shape[1]
        H = np.concatenate([np.stack(states[:T], 1), np.stack(states[T:][::-1], 1)], axis=2)
        s = np.where(mask > 0, H @ self.p["v"], -1e9)
        e = np.exp(s - s.max(1, keepdims=True)) * mask
        att = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        pooled = (att[:, :, None] * H).sum(1)
        return keep | {"H": H, "att": att, "pooled": pooled, "logit": pooled @ self.p["w"] + self.p["c"][0]}

    def back(self, k: dict, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the inputs."""
        g = {"w": k["pooled"].T @ dlogit, "c": np.array([dlogit.sum()], dtype=np.float32)}
        dpool = dlogit[:, None] * self.p["w"]
        datt = (k["H"] * dpool[:, None]).sum(2)
        ds = k["att"] * (datt - (k["att"] * datt).sum(1, keepdims=True))
        g["v"] = np.einsum("bt,bth->h", ds, k["H"])
        dH = k["att"][:, :, None] * dpool[:, None] + ds[:, :, None] * self.p["v"]
        dx = np.zeros_like(k["x"])
        T = dx.shape[1]
        for d in "fb":
            part = dH[:, :, :HIDDEN] if d == "f" else dH[:, ::-1, HIDDEN:]
            xd = k["x"] if d == "f" else k["x"][:, ::-1]
            dh = np.zeros((len(dx), HIDDEN), dtype=np.float32)
            dpre = np.zeros((len(dx), T, 3 * HIDDEN), dtype=np.float32)
            U = self.p["U" + d]
            gU = np.zeros_like(U)
            for t in range(T - 1, -1, -1):
                h, un, z, r, n, m = k[d][t]
                dh = dh + part[:, t]
                # the derivative of softsign at x is (1 - |softsign(x)|) squared
                dn = dh * m * (1 - z) * (1 - np.abs(n)) ** 2
                dz = dh * m * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dn * un * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                du = np.concatenate([dz, dr, dn * r], axis=1)
                dpre[:, t] = np.concatenate([dz, dr, dn], axis=1)
                gU += h.T @ du
                dh = dh * (1 - m * (1 - z)) + du @ U.T
            g["U" + d] = gU
            g["W" + d] = np.einsum("bti,btj->ij", xd, dpre)
            g["b" + d] = dpre.sum((0, 1))
            dxd = dpre @ self.p["W" + d].T
            dx += dxd if d == "f" else dxd[:, ::-1]
        return g, dx


def _log_odds(toxic: Counter, clean_: Counter, n1: int, n0: int, least: int = 2) -> dict:
    return {k: float(np.clip(np.log((toxic[k] + 0.5) / (n1 + 1)) - np.log((clean_[k] + 0.5) / (n0 + 1)), -4, 4)) for k in toxic.keys() | clean_.keys() if toxic[k] + clean_[k] >= least}


def _words(texts: list[str]) -> list[list[str]]:
    """The texts' cleaned words, each distinct word one object, as the driver holds all of them."""
    known: dict[str, str] = {}
    one: dict[str, str] = {}
    out = []
    for text in texts:
        words = []
        for t in text.split():
            w = known.get(t)
            if w is None:
                w = clean(t)
                w = known[t] = one.setdefault(w, w)
            words.append(w)
        out.append(words)
    return out


def train(texts: list[str], labels: list[int], seed: int = 1) -> Network | None:
    """Fit on whole texts; None if there aren't documents of both classes, or no words at all. Log odds of document counts start the vectors."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    docs = _words(texts)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    df: dict[int, Counter] = {0: Counter(), 1: Counter()}
    gf: dict[int, Counter] = {0: Counter(), 1: Counter()}
    every = sorted({w for words in docs for w in words})
    if not every:
        return None
    place = {w: i for i, w in enumerate(every)}
    pieces = [grams(every[a:b]) for a, b in slices(len(every), CHUNK)]
    flat, lens = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*pieces, strict=True)) if pieces else grams(every)
    begin = np.cumsum(lens) - lens

    def ranges(rows: np.ndarray) -> np.ndarray:
        """The n-grams of words, one word after another."""
        n = lens[rows]
        return flat[np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    tokens = [np.array([place[w] for w in words], dtype=np.int64) for words in docs]
    for ids, words, label in zip(tokens, docs, labels, strict=True):
        df[label].update(set(words))
        gf[label].update(np.unique(ranges(np.unique(ids))).tolist())
    odds = _log_odds(df[1], df[0], n1, n0)
    gram_odds = np.zeros(GRAMS, dtype=np.float32)
    for k, v in _log_odds(gf[1], gf[0], n1, n0, 3).items():
        gram_odds[k] = v
    vocabulary = {w: i + 1 for i, (w, _) in enumerate(sorted(((w, df[0][w] + df[1][w]) for w in odds), key=lambda x: (-x[1], x[0]))[:WORDS])}

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"E": normal(len(vocabulary) + 1, WORD_DIM, scale=0.05), "G": normal(GRAMS, CHAR_DIM - 1, scale=0.05), "v": normal(2 * HIDDEN, scale=0.3), "w": normal(2 * HIDDEN, scale=0.3), "c": np.array([-1.0], dtype=np.float32)}
    for w, i in vocabulary.items():
        p["E"][i, 0] = odds[w] / 2
    p["G"][:, 0] = gram_odds / 2
    for d in "fb":
        p |= {"W" + d: normal(WORD_DIM + CHAR_DIM, 3 * HIDDEN, scale=0.25), "U" + d: normal(HIDDEN, 3 * HIDDEN, scale=0.25), "b" + d: np.zeros(3 * HIDDEN, dtype=np.float32)}
    net = Network(vocabulary, gram_odds, p)

    word_ids = np.array([vocabulary.get(w, 0) for w in every], dtype=np.int64)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    # windows of all documents: pad with the place after the last word
    windows = []
    for ids in tokens:
        padded = np.full(starts_of(len(ids))[-1] + WINDOW, len(every), dtype=np.int32)
        padded[: len(ids)] = ids
        windows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
    window_ids, window_doc = np.concatenate(windows), np.repeat(np.arange(len(windows), dtype=np.int32), [len(w) for w in windows])
    del windows
    first = np.flatnonzero(np.concatenate([[True], np.diff(window_doc) > 0]))
    counts = np.diff(np.append(first, len(window_doc)))
    gram_part = np.concatenate([np.zeros(0, dtype=np.float32), *(net.inputs(word_ids[a:b], ranges(np.arange(a, b)), lens[a:b])[:, -1] for a, b in slices(len(every), CHUNK))])
    first_odds = np.maximum(gram_part, np.array([odds.get(w, 0.0) for w in every], dtype=np.float32))
    guess = np.append(first_odds, -9)[window_ids].max(1)
    batch = min(BATCH, max(16, len(docs) // 16))
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-UPDATES * batch // len(docs))))
    for epoch in range(epochs):
        if epoch:
            fast = Scorer(net)
            fast.add(every)
            some = slices(len(window_ids), CHUNK)
            guess = np.concatenate([fast.logits(np.where(window_ids[a:b] == len(every), 0, window_ids[a:b] + 1)) for a, b in some])
            del fast
        picked = []
        for i, (a, n) in enumerate(zip(first, counts, strict=True)):
            top = a + int(np.argmax(guess[a : a + n]))
            picked.append(top)
            if not y[i] and n > 1:
                picked.append(a + int(rng.integers(n)))
        picked = np.array(picked)
        rng.shuffle(picked)
        for at in range(0, len(picked), batch):
            rows = picked[at : at + batch]
            ids = window_ids[rows]
            mask = (ids < len(every)).astype(np.float32)
            used, inverse = np.unique(np.minimum(ids, len(every) - 1), return_inverse=True)
            vectors = net.inputs(word_ids[used], ranges(used), lens[used])
            k = net.run(vectors[inverse.reshape(ids.shape)] * mask[:, :, None], mask)
            label = y[window_doc[rows]]
            g, dx = net.back(k, (sigmoid(k["logit"]) - label).astype(np.float32) / len(rows))
            dv = np.zeros_like(vectors)
            np.add.at(dv, inverse.ravel(), (dx * mask[:, :, None]).reshape(-1, dv.shape[1]))
            g["E"] = np.zeros_like(p["E"])
            np.add.at(g["E"], word_ids[used], dv[:, :WORD_DIM])
            g["E"][0] = 0
            g["G"] = np.zeros_like(p["G"])
            np.add.at(g["G"], ranges(used), np.repeat(dv[:, WORD_DIM:-1] / np.maximum(lens[used], 1)[:, None], lens[used], axis=0))
            step += 1
            for name, grad in g.items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                s[name] = 0.999 * s[name] + 0.001 * grad * grad
                p[name] -= (RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Windows' logits with each token's input products looked up; row 0 of the products is padding.

    Products, weights and states of the two gates and of the candidate are kept apart, so that
    every step works on contiguous arrays; attention needs two sums of each state only.
    """

    def __init__(self, net: Network, most: int = CACHE_TOKENS):
        self.net, self.most = net, most
        self.weights = {d: [np.ascontiguousarray(u) for u in np.split(net.p["U" + d], 3, axis=1)] for d in "fb"}
        for w in self.weights.values():
            w[2] *= 0.5  # a reset gate is half of 1 + softsign
        self.out = np.stack([net.p["v"], net.p["w"]], axis=1).reshape(2, HIDDEN, 2)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.products = np.zeros((6, 1, HIDDEN), dtype=np.float32)
        self.filled = 1

    def add(self, tokens: list[str]) -> None:
        p = self.net.p
        for at in range(0, len(tokens), CHUNK):
            some = tokens[at : at + CHUNK]
            words = [clean(t) for t in some]
            x = self.net.inputs(np.array([self.net.words.get(w, 0) for w in words], dtype=np.int64), *grams(words))
            rows = np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], axis=1).reshape(len(some), 6, HIDDEN).transpose(1, 0, 2)
            if self.filled + len(some) > self.products.shape[1]:
                more = np.zeros((6, max(len(some), self.products.shape[1]), HIDDEN), dtype=np.float32)
                self.products = np.concatenate([self.products, more], axis=1)
            self.products[:, self.filled : self.filled + len(some)] = rows
            self.known.update(zip(some, range(self.filled, self.filled + len(some)), strict=True))
            self.filled += len(some)

    def logits(self, ids: np.ndarray) -> np.ndarray:
        """For windows of rows of the products (0 behind a window's last token)."""
        return np.concatenate([self._logits(ids[a:b]) for a, b in slices(len(ids), CHUNK)]) if len(ids) else np.zeros(0, dtype=np.float32)

    def _logits(self, ids: np.ndarray) -> np.ndarray:
        n, T = ids.shape
        columns = np.ascontiguousarray(ids.T)
        live = columns > 0
        cut = int(live.sum(0).min(initial=T))
        sums = np.zeros((T, n, 2), dtype=np.float32)
        for k, d in enumerate("fb"):
            Uz, Ur, Un = self.weights[d]
            Pz, Pr, Pn = self.products[3 * k : 3 * k + 3]
            h = np.zeros((n, HIDDEN), dtype=np.float32)
            t_, u_ = np.empty_like(h), np.empty_like(h)
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                at = columns[t]
                r = Pr.take(at, axis=0)
                r += np.matmul(h, Ur, out=u_)
                r /= np.add(np.abs(r, out=t_), 1, out=t_)
                r += 1
                r *= np.matmul(h, Un, out=u_)
                r += Pn.take(at, axis=0)
                r /= np.add(np.abs(r, out=t_), 1, out=t_)  # the candidate
                r -= h
                z = Pz.take(at, axis=0)
                z += np.matmul(h, Uz, out=u_)
                z /= np.add(np.abs(z, out=t_), 1, out=t_)
                np.subtract(1, z, out=z)
                z *= 0.5
                if t >= cut:
                    z *= live[t][:, None]
                r *= z
                h += r
                sums[t] += h @ self.out[k]
        s = sums[:, :, 0]
        s[~live] = -1e9
        s = np.exp(s - s.max(0))
        s *= live
        s /= np.maximum(s.sum(0), 1e-9)
        return np.einsum("tn,tn->n", s, sums[:, :, 1]) + self.net.p["c"][0]

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities of whole texts; one without tokens scores as an empty window."""
        cut = [t.split() for t in texts]
        new = list({t for x in cut for t in x if t not in self.known})
        if len(self.known) + len(new) > self.most:
            self.clear()
            new = list({t for x in cut for t in x})
        self.add(new)
        known = self.known.__getitem__
        rows, first = [], []
        at = 0
        for tokens in cut:
            n = len(tokens)
            starts = starts_of(n)
            ids = np.zeros(starts[-1] + WINDOW, dtype=np.int64)
            ids[:n] = np.fromiter(map(known, tokens), dtype=np.int64, count=n)
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[::STRIDE])
            first.append(at)
            at += len(rows[-1])
        if not rows:
            return np.zeros(0)
        return sigmoid(np.maximum.reduceat(self.logits(np.concatenate(rows)), first).astype(np.float64))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network | None:
    """Fit on the labelled rows outside the test fold, ``FIT_TOXIC`` and ``FIT_CLEAN`` at most of those with the lowest hashes.

    A key with two labels counts as toxic; rows whose key, text or label is null, or whose text is over ``FIT_CHARS``, aren't
    used. Of a key with several texts the least is.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~is_held_out(F.col(key), 5, 0)).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(n) for y, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.length("_t") <= FIT_CHARS).join(F.broadcast(picked[0].unionByName(picked[1])), "_k").groupBy("_k").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y")).collect()
    rows.sort(key=lambda r: r["_k"])
    return train([r["_t"] for r in rows], [int(r["_y"]) for r in rows])


def scored(df: DataFrame, net: Network | None, text: str = "text", into: str = "score") -> DataFrame:
    """Add double ``into`` for the whole text of each row, all its overlapping windows scored.

    Null and empty texts score as an empty window does; without a network (no
    labels of both classes) every row scores 0. Other columns pass unchanged.
    """
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net_ = pickle.loads(sent.value)
        scorer = Scorer(net_) if net_ else None
        for batch in batches:
            out = [np.zeros(0)]
            for a, b in slices(len(batch), 64):
                out.append(scorer.score([t or "" for t in batch.slice(a, b - a).to_pylist()]) if scorer else np.zeros(b - a))
            yield pa.array(np.concatenate(out), pa.float64())

    return df.withColumn(into, score.asNondeterministic()(F.col(text)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 if score >= 0.5).

    A null key is held out and keeps its score; repeated rows score alike; an empty table gives no rows.
    """
    net = fit(docs.sparkSession, docs, labels)
    out = scored(docs.select("doc_id", "text"), net)
    return out.select("doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
