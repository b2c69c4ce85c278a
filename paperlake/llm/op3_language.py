"""Language by words first, and by shorter and shorter character n-grams where a word is unknown."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import is_held_out, slices, table

#: Expected number of documents of each language that the model is fitted on, those with the lowest hashes.
FIT_DOCS = 1000
#: Languages that are learned, those of the most documents, and words of languages, the most frequent.
FIT_LANGS, FIT_WORDS = 1000, 1_000_000
#: Documents whose words a worker counts before it hands the counts on.
COUNTED = 256
LONGEST = 4
#: Log penalty of each step to a shorter n-gram.
BACK_OFF = float(np.log(0.4))
CACHE_TOKENS = 300_000
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    """Rows of ``logs``, log frequencies by language, of the known words and of the n-grams of all lengths."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray


def _table(counts: list[Counter], least: int) -> tuple[list[str], np.ndarray]:
    """Log frequencies with half a count added; what has fewer than ``least`` in all is left to the backoff."""
    kept = sorted(k for k, n in sum(counts, Counter()).items() if n >= least)
    raw = np.array([[c[k] for c in counts] for k in kept], dtype=np.float64).reshape(len(kept), len(counts)) + 0.5
    return kept, np.log(raw / raw.sum(0))


def train(rows: list[tuple[str, str]]) -> Model:
    """From (text, lang) pairs."""
    words: dict[str, Counter] = {}
    for text, lang in rows:
        words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
    return of_counts(words)


def of_counts(counted: dict[str, Counter]) -> Model:
    """From the counts of words of each language."""
    langs = sorted(counted)
    if not langs:
        return Model([], {}, {}, np.zeros((0, 0)))
    words = [counted[lang] for lang in langs]
    grams = [[Counter() for _ in langs] for _ in range(LONGEST)]
    for i, counts in enumerate(words):
        for w, c in counts.items():
            marked = f"^{w}$"
            for n in range(1, LONGEST + 1):
                for at in range(len(marked) - n + 1):
                    grams[n - 1][i][marked[at : at + n]] += c
    known, logs = _table(words, 3)
    of_grams = [_table(g, 2) for g in grams]
    names = [g for kept, _ in of_grams for g in kept]
    return Model(langs, {w: i for i, w in enumerate(known)}, {g: len(known) + i for i, g in enumerate(names)}, np.concatenate([logs, *(x for _, x in of_grams)]))


class Identifier:
    """Scores texts with the vectors of the tokens met so far; a token's runs of letters add up.

    What a token adds is looked up as rows of the model; the rows of many tokens are added at once.
    """

    def __init__(self, model: Model, most: int = CACHE_TOKENS):
        self.model, self.most = model, most
        #: The model's rows less the penalty of 0, 1, ... steps to shorter n-grams.
        self.logs = np.concatenate([model.logs + k * BACK_OFF for k in range(LONGEST)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs) + 1))

    def rows(self, word: str) -> list[int]:
        """A known word's row; of others, at each place the row of the longest known n-gram."""
        if (own := self.model.words.get(word)) is not None:
            return [own]
        get, size = self.model.grams.get, len(self.model.logs)
        marked = f"^{word}$"
        out = [get(marked[i : i + LONGEST], -1) for i in range(len(marked) - 1)]
        for i, r in enumerate(out):
            if r >= 0:
                continue
            longest = min(LONGEST, len(marked) - i)
            for n in range(longest, 0, -1):
                if (r := get(marked[i : i + n])) is not None:
                    out[i] = r + (longest - n) * size
                    break
        return [r for r in out if r >= 0]

    def learn(self, cut: list[list[str]]) -> None:
        new = list({t for x in cut for t in x if t not in self.known})
        if len(self.known) + len(new) > self.most:
            self.clear()
            new = list({t for x in cut for t in x})
        flat: list[int] = []
        counts: list[int] = []
        owner: list[int] = []
        for i, t in enumerate(new):
            low = t.lower()
            # most tokens are one run, or one with a mark behind it
            runs = [low] if low.isalpha() else [low[:-1]] if low[:-1].isalpha() and not low[-1].isalpha() else LETTERS.findall(low)
            for w in runs:
                rows = self.rows(w)
                flat += rows
                counts.append(len(rows))
                owner.append(i)
        begin = len(self.known)
        self.known.update(zip(new, range(begin, begin + len(new)), strict=True))
        if begin + len(new) > len(self.table):
            more = np.zeros((max(len(new), len(self.table)), self.table.shape[1]))
            self.table = np.concatenate([self.table, more])
        self.table[begin : begin + len(new)] = 0
        if not owner or not self.model.langs:
            return
        places = np.array(counts)
        means = np.zeros((len(owner), len(self.model.langs) + 1))
        means[:, -1] = 1
        some = np.flatnonzero(places)
        if len(some):
            means[some, :-1] = np.add.reduceat(self.logs[flat], (np.cumsum(places) - places)[some]) / places[some, None]
        first = np.flatnonzero(np.concatenate([[True], np.diff(owner) > 0]))
        self.table[begin + np.array(owner)[first]] = np.add.reduceat(means, first)

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        cut = [(t or "").split() for t in texts]
        self.learn(cut)
        known = self.known.__getitem__
        langs, scores = [], []
        for tokens in cut:
            total = self.table[np.fromiter(map(known, tokens), dtype=np.int64, count=len(tokens))].sum(0)
            if not total[-1] or not self.model.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            e = np.exp(total[:-1] - total[:-1].max())
            best = int(np.argmax(e))
            langs.append(self.model.langs[best])
            scores.append(float(e[best] / e.sum()))
        return langs, scores


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on about ``FIT_DOCS`` documents of each language (all of a rarer one) outside the test fold, by a hash of the key.

    Words are counted where the texts lie; only counts come to the driver, those
    of ``FIT_WORDS`` words at most, and of ``FIT_LANGS`` languages. So neither
    long texts nor rows that repeat a key make the model's data grow.
    """
    spark = docs.sparkSession
    rows = docs.where(~is_held_out(F.col(key), 4, 2) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(FIT_LANGS).collect()
    counted: dict[str, Counter] = {r["l"]: Counter() for r in sizes}
    if not sizes:
        return of_counts({})
    shares = spark.createDataFrame([(r["l"], int(min(1.0, FIT_DOCS / r["n"]) * 1_000_000)) for r in sizes], "l string, share int")
    picked = rows.join(F.broadcast(shares), "l").where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < F.col("share")).select("l", "t")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(len(batch), COUNTED):
                found: dict[str, Counter] = {}
                for own, t in zip(langs[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                    found.setdefault(own, Counter()).update(LETTERS.findall(t.lower()))
                for own, c in found.items():
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["l", "w", "n"])

    total = picked.mapInArrow(words, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    for r in total.orderBy(F.desc("n"), "l", "w").limit(FIT_WORDS).toLocalIterator():
        counted[r["l"]][r["w"]] = r["n"]
    return of_counts(counted)


def identified(df: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """Add struct ``into`` (lang_pred, score) for the whole text of each row.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text of a model without languages; of languages that tie the first by name
    is taken. Other columns pass unchanged.
    """
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @arrow_udf("lang_pred string, score double")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        identifier = Identifier(pickle.loads(sent.value))
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for a, b in slices(len(batch), 256):
                x, y = identifier.identify(batch.slice(a, b - a).to_pylist())
                langs += x
                scores += y
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return df.withColumn(into, identify.asNondeterministic()(F.col(text)))


def language(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred and score.

    A null key is held out; repeated rows are each returned; an empty table gives no rows.
    """
    out = identified(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "language.lang_pred", "language.score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))
