"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

Items are cut into segments, and segments' impacts are divided by the score
that a segment has against itself, so that one threshold fits all. Postings are
kept in blocks of segments with each term's largest impact; a passage adds up
those bounds and only blocks that can reach the threshold are scored. What is
retrieved is verified by the shingles of question and answer that the document
has thereabouts. The index is of the test items alone and is cut into parts of
bounded size. As many as a bound of bytes allows are broadcast at once, of which
a worker has one loaded at a time; more are taken in further passes, with the
matches so far written in between.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import free_name, materialise, slices, table

#: Words of a segment; passages have twice as many and overlap by half, so a segment's words stand in one passage.
SEGMENT = 64
K1, B = 1.2, 0.75
#: Share of a segment's own score that retrieves it, and share of an item's shingles that verifies it.
RETRIEVE, VERIFY = 0.5, 0.8
#: Share of the answer's words that must stand by.
ANSWER = 0.5
SHINGLE = 5
BLOCK = 8
#: Postings, and bounds of blocks, in hand at once.
POSTINGS = 1 << 21
#: Characters of test items in one part of the index, and bytes of the parts that are broadcast at once; one part at least.
INDEX_CHARS, SENT_BYTES = 2 << 20, 64 << 20
#: Items whose shingles a worker keeps.
KEPT_ITEMS = 4096

_WORDS = re.compile(r"\w+").findall
MATCHES = "array<struct<item_id:bigint,bm25:double,overlap:double,answer_overlap:double,first_word:bigint>>"


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


@dataclass
class Index:
    """Postings of terms: those of term t lie from ptr[t] to ptr[t + 1], each a block of segments with the
    impacts of its segments and the largest of them. The last term has none: it stands for all other words.
    ``items`` has the items' ids and words; what verification needs is made of the words when an item is first retrieved."""

    terms: dict[str, int]
    ptr: np.ndarray
    block: np.ndarray
    impacts: np.ndarray
    bounds: np.ndarray
    blocks: int
    item: np.ndarray
    items: list[tuple[int, str]]
    facts: dict[int, tuple[int, set, Counter, int]] = field(default_factory=dict, repr=False)

    def fact(self, k: int) -> tuple[int, set, Counter, int]:
        """An item's id, shingles, words of the answer and number of words."""
        if k not in self.facts:
            if len(self.facts) >= KEPT_ITEMS:
                self.facts.clear()
            item_id, text = self.items[k]
            words = text.split(" ")
            self.facts[k] = (item_id, shingles(words), Counter(question_and_answer(words)[1]), len(words))
        return self.facts[k]


def question_and_answer(words: list[str]) -> tuple[list[str], list[str]]:
    """The last quarter of an item's words is its answer, the rest its question."""
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; of fewer words the whole sequence."""
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def build(items: list[tuple[int, str]]) -> Index:
    """Items without words are in no passage and aren't indexed; items of one text are each found."""
    kept = [(i, words_of(t)) for i, t in sorted(items)]
    kept = [(i, w) for i, w in kept if w]
    segments, owner = [], []
    for k, (_, words) in enumerate(kept):
        n = max(1, -(-len(words) // SEGMENT))
        for part in np.array_split(np.arange(len(words)), n):
            segments.append(Counter(words[part[0] : part[-1] + 1]))
            owner.append(k)
    terms = {t: i for i, t in enumerate(sorted({t for s in segments for t in s}))}
    n = len(segments)
    df = Counter(t for s in segments for t in s)
    mean = sum(map(Counter.total, segments)) / max(n, 1)
    term, segment, impact = [], [], []
    for k, s in enumerate(segments):
        size = s.total()
        own = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / mean)) for t, c in s.items()}
        whole = sum(own.values())
        term += [terms[t] for t in own]
        segment += [k] * len(own)
        impact += [v / whole for v in own.values()]
    term, segment = np.array(term, dtype=np.int64), np.array(segment, dtype=np.int64)
    blocks = -(-n // BLOCK)
    key, at = np.unique(term * max(blocks, 1) + segment // BLOCK, return_inverse=True)
    impacts = np.zeros((len(key), BLOCK), dtype=np.float32)
    impacts[at, segment % BLOCK] = impact
    ptr = np.searchsorted(key, np.arange(len(terms) + 2) * max(blocks, 1))
    return Index(terms, ptr, (key % max(blocks, 1)).astype(np.int32), impacts, impacts.max(1, initial=0), blocks, np.array(owner, dtype=np.int64), [(i, " ".join(words)) for i, words in kept])


def retrieved(index: Index, passage: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(passage, segment, score) of all that reach ``RETRIEVE``; the distinct (passage, term) are sorted.

    Bounds of all blocks come first; where they stay below the threshold no segment is scored.
    """
    lens = index.ptr[term + 1] - index.ptr[term]
    ends = np.cumsum(lens)
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    at = 0
    while at < len(starts):
        # as many whole passages as keep the postings and the bounds in hand few; one at least
        a = starts[at]
        before = ends[a] - lens[a]
        most = np.searchsorted(ends[np.append(starts[at + 1 :], len(passage)) - 1], before + POSTINGS, side="right")
        upto = at + max(1, min(int(most), POSTINGS // max(index.blocks, 1)))
        b = starts[upto] if upto < len(starts) else len(passage)
        n = lens[a:b]
        posting = np.repeat(index.ptr[term[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        local = np.repeat(np.cumsum(np.isin(np.arange(a, b), starts[at:upto], assume_unique=True)) - 1, n)
        key = local * index.blocks + index.block[posting]
        bound = np.bincount(key, weights=index.bounds[posting], minlength=(upto - at) * index.blocks)
        reach = np.flatnonzero(bound >= RETRIEVE - 1e-5)
        if len(reach):
            row = np.full(len(bound), -1)
            row[reach] = np.arange(len(reach))
            some = np.flatnonzero(row[key] >= 0)
            scores = np.zeros((len(reach), BLOCK))
            np.add.at(scores, row[key[some]], index.impacts[posting[some]])
            for r, s in np.argwhere(scores >= RETRIEVE - 1e-5).tolist():
                k = int(reach[r])
                yield int(passage[starts[at + k // index.blocks]]), k % index.blocks * BLOCK + s, float(scores[r, s])
        at = upto


def matches(index: Index, texts: list[str]) -> list[list[tuple[int, float, float, float, int]]]:
    """Per text: (item_id, bm25, overlap, answer_overlap, first_word) of each verified item."""
    out: list[list] = [[] for _ in texts]
    if not index.items or not texts:
        return out
    none = len(index.terms)
    get = index.terms.get
    words = [words_of(t) for t in texts]
    flat = np.fromiter((get(w, none) for x in words for w in x), dtype=np.int64)
    lens = np.array([len(x) for x in words])
    first = np.cumsum(lens) - lens
    # passages: 2 * SEGMENT words from every SEGMENT words on; the distinct terms of each
    at = np.arange(len(flat)) - np.repeat(first, lens)
    counts = np.maximum(1, -(-lens // SEGMENT) - 1) * (lens > 0)
    base = np.cumsum(counts) - counts
    block = np.minimum(at // SEGMENT, np.repeat(np.maximum(counts, 1), lens))
    b = np.repeat(base, lens)
    last = np.repeat(counts, lens) - 1
    known = flat < none
    one = known & (block <= last)
    two = known & (block >= 1)
    passage = np.concatenate([(b + block)[one], (b + block - 1)[two]])
    term = np.concatenate([flat[one], flat[two]])
    if not len(term):
        return out
    key = np.unique(passage * none + term)
    passage, term = key // none, key % none
    doc_of = np.repeat(np.arange(len(texts)), counts)
    found: dict[tuple[int, int], list] = {}
    for p, segment, score in retrieved(index, passage, term):
        doc = int(doc_of[p])
        found.setdefault((doc, int(index.item[segment])), []).append((int(p - base[doc]) * SEGMENT, score))
    for (doc, item), hits in sorted(found.items()):
        out_row = verify(index.fact(item), words[doc], hits)
        if out_row:
            out[doc].append(out_row)
    return out


def verify(fact: tuple[int, set, Counter, int], words: list[str], hits: list[tuple[int, float]]) -> tuple[int, float, float, float, int] | None:
    """The item's shingles and answer words around the passages that retrieved it; best passage first."""
    item_id, wanted, answer, size = fact
    best = None
    for at, score in hits:
        near = words[max(0, at - size) : at + 2 * SEGMENT + size]
        overlap = len(wanted & shingles(near)) / len(wanted)
        if overlap < VERIFY:
            continue
        has = Counter(near)
        share = sum(min(c, has[w]) for w, c in answer.items()) / answer.total() if answer else 1.0
        if share >= ANSWER:
            row = (item_id, min(score, 1.0), overlap, share, at)
            best = max(best, row, key=lambda x: (x[1], -x[4])) if best else row
    return best


def _search(sent):
    @arrow_udf(MATCHES)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("item_id", "bm25", "overlap", "answer_overlap", "first_word")
        kind = pa.list_(pa.struct([(n, pa.int64() if n in ("item_id", "first_word") else pa.float64()) for n in names]))
        only = pickle.loads(sent.value[0]) if len(sent.value) == 1 else None
        for batch in batches:
            rows: list[list] = [[] for _ in range(len(batch))]
            for part in sent.value:
                index = only or pickle.loads(part)
                for a, b in slices(len(batch), 64):
                    for i, got in enumerate(matches(index, [t or "" for t in batch.slice(a, b - a).to_pylist()])):
                        rows[a + i] += [dict(zip(names, m, strict=True)) for m in got]
                del index
            yield pa.array(rows, kind)

    return search


def with_matches(docs: DataFrame, items: DataFrame, text: str = "text", into: str = "_matches") -> DataFrame:
    """Add array ``into`` of verified items for the whole text of each row; null and empty texts have none.

    ``items``: item_id and text; those with a null id or text are left out. Items
    are dealt by hash over parts of about ``INDEX_CHARS``.
    """
    spark = docs.sparkSession
    usable = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // INDEX_CHARS))
    out, columns, held, size = docs, [], [], 0

    def searched(out: DataFrame) -> DataFrame:
        columns.append(free_name(out, f"{into}{len(columns)}"))
        return out.withColumn(columns[-1], _search(spark.sparkContext.broadcast(held)).asNondeterministic()(F.col(text)))

    for k in range(parts):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        part = pickle.dumps(build([(r["item_id"], r["text"]) for r in rows]))
        if held and size + len(part) > SENT_BYTES:
            out, held, size = materialise(searched(out), "matches"), [], 0
        held.append(part)
        size += len(part)
    out = searched(out)
    return out.withColumn(into, F.flatten(F.array(*columns)) if len(columns) > 1 else F.col(columns[0])).drop(*columns)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, bm25, overlap, answer_overlap, first_word): the documents that hold a test item, by item.

    Clean documents have no row. An item of fewer than five words is one shingle
    and is in documents of those words alone, not in all that hold a common
    word. Repeated rows of a document are each reported,
    a null doc_id stays null, and empty tables give no rows.
    """
    found = with_matches(docs.select("doc_id", "text"), items)
    return found.select("doc_id", F.explode("_matches").alias("m")).select("doc_id", "m.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
