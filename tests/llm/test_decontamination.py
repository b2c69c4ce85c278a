import pickle
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from paperlake.llm import op9_decontamination as op

SF = "/root/testdata/sf0.01"
RNG = np.random.default_rng(0)
COMMON = [f"w{i}" for i in range(60)]


def prose(n, own=""):
    return " ".join(str(RNG.choice(COMMON)) if RNG.random() < 0.6 else own + "".join(RNG.choice(list("abcdefgh"), 6)) for _ in range(n))


ITEMS = [(i, prose(int(n), "q")) for i, n in enumerate([3, 8, 20, 40, 40, 64, 65, 130, 400, 900, 1])]


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute_scores(items, texts):
    """BM25 of every segment of every item against every passage, as a share of the segment's own."""
    segments = []
    for k, (_, text) in enumerate(items):
        w = words(text)
        n = max(1, -(-len(w) // op.SEGMENT))
        segments += [(k, Counter(w[p[0] : p[-1] + 1])) for p in np.array_split(np.arange(len(w)), n) if len(p)]
    df = Counter(t for _, s in segments for t in s)
    mean = sum(s.total() for _, s in segments) / max(len(segments), 1)

    def weights(s):
        return {t: np.log(1 + (len(segments) - df[t] + 0.5) / (df[t] + 0.5)) * c * (op.K1 + 1) / (c + op.K1 * (1 - op.B + op.B * s.total() / mean)) for t, c in s.items()}

    out = set()
    for d, text in enumerate(texts):
        w = words(text)
        for at in range(0, max(1, len(w) - op.SEGMENT), op.SEGMENT):
            has = set(w[at : at + 2 * op.SEGMENT])
            for k, (_, s) in enumerate(segments):
                own = weights(s)
                if sum(v for t, v in own.items() if t in has) >= op.RETRIEVE * sum(own.values()):
                    out.add((d, at, k))
    return out


@pytest.mark.parametrize("postings", [1, 500, 1 << 21])
def test_no_block_that_reaches_the_threshold_is_skipped(monkeypatch, postings):
    monkeypatch.setattr(op, "POSTINGS", postings)
    texts = [prose(int(RNG.integers(1, 700))) for _ in range(6)] + [prose(150) + " " + t + " " + prose(90) for _, t in ITEMS] + ["", ITEMS[3][1][: len(ITEMS[3][1]) // 2]]
    index, got = op.build(ITEMS), set()
    for d, text in enumerate(texts):
        w = words(text)
        starts = range(0, max(1, len(w) - op.SEGMENT), op.SEGMENT)
        keys = sorted({(p, index.terms[x]) for p, at in enumerate(starts) for x in w[at : at + 2 * op.SEGMENT] if x in index.terms})
        if keys:
            passage, term = (np.array([k[i] for k in keys]) for i in (0, 1))
            got |= {(d, starts[p], s) for p, s, _ in op.retrieved(index, passage, term)}
    assert got == brute_scores(ITEMS, texts)


@pytest.mark.parametrize("before", [0, 1, 63, 64, 65, 127, 500])
@pytest.mark.parametrize("item", range(1, len(ITEMS) - 1))
def test_an_item_anywhere_in_a_document(before, item):
    text = f"{prose(before)}\n{ITEMS[item][1].upper()}.\n{prose(200)}"
    (found,) = op.matches(op.build(ITEMS), [text])
    mine = [m for m in found if m[0] == item]
    assert len(mine) == 1 and mine[0][2] == 1.0 and mine[0][3] == 1.0


def test_an_item_under_five_words_is_its_own_shingle():
    index = op.build(ITEMS)
    assert [[m[0] for m in found] for found in op.matches(index, [ITEMS[0][1], ITEMS[10][1], f"{ITEMS[0][1]} {prose(30)}"])] == [[0], [10], []]


def test_clean_documents_and_parts_of_items_are_left_alone():
    index = op.build(ITEMS[2:10])
    scattered = words(ITEMS[8][1])
    RNG.shuffle(scattered)
    half = " ".join(words(ITEMS[8][1])[:200])
    assert op.matches(index, [prose(2000), " ".join(scattered), half, "", "?!"]) == [[], [], [], [], []]


def test_near_copies_hold_four_fifths_of_the_shingles():
    w = words(ITEMS[8][1])
    some, many = list(w), list(w)
    some[50] = some[200] = some[300] = "changed"
    many[::8] = ["changed"] * len(many[::8])
    index = op.build(ITEMS)
    a, b = op.matches(index, [" ".join(some), " ".join(many)])
    assert [m[0] for m in a] == [8] and op.VERIFY <= a[0][2] < 1 and b == []


def test_question_without_its_answer_is_no_match():
    item = (5, " ".join(f"x{i}" for i in range(300)))
    question, answer = op.question_and_answer(words(item[1]))
    index = op.build([item])
    assert op.matches(index, [" ".join(question) + " " + prose(300)]) == [[]]
    assert [m[0] for m in op.matches(index, [" ".join(question + answer)])[0]] == [5]


def brute(items, docs):
    """(doc_id, item_id) where a document has four fifths of an item's five-word shingles."""
    wanted = {i: op.shingles(words(t)) for i, t in items}
    out = set()
    for d, text in docs:
        own = op.shingles(words(text))
        out |= {(d, i) for i, s in wanted.items() if s and len(s & own) >= op.VERIFY * len(s)}
    return out


def test_whole_table_against_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(items, docs)
    assert len(want) > 10 and {(r["doc_id"], r["item_id"]) for r in op.op9_decontamination(spark, SF).collect()} == want


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, ITEMS[3][1]), (2, ITEMS[3][1]), (3, None), (None, ITEMS[4][1]), (4, "..."), (5, ""), (6, ITEMS[10][1])], "item_id long, text string")
    held = prose(30) + " " + ITEMS[3][1]
    rows = [(1, None), (2, ""), (3, held), (3, held), (None, held), (4, prose(50)), (5, f"{prose(30_000)} {held}"), (6, ITEMS[10][1])]
    docs = spark.createDataFrame([(k, t, "x", 9.0) for k, t in rows], "doc_id long, text string, item_id string, bm25 double")
    got = Counter((r["doc_id"], r["item_id"]) for r in op.contaminated(docs, items).collect())
    assert got == Counter([(3, 1), (3, 2), (3, 1), (3, 2), (None, 1), (None, 2), (5, 1), (5, 2), (6, 6)])


@pytest.mark.parametrize("sent", [1, 10**9])
def test_a_large_benchmark_is_taken_in_parts(spark, monkeypatch, sent):
    """Parts together in one pass, or one part a pass."""
    monkeypatch.setattr(op, "INDEX_CHARS", 400)
    monkeypatch.setattr(op, "SENT_BYTES", sent)
    items = spark.createDataFrame(ITEMS[2:8], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{prose(70)} {t}") for i, t in ITEMS[2:8]] + [(99, prose(80))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in op.contaminated(docs, items).collect()) == [(i, i) for i in range(2, 8)]


def test_a_part_of_the_index_is_small_in_memory():
    """A quarter of a part of full size: what a worker has loaded of a whole one stays within a few hundred MB."""
    rng = np.random.default_rng(0)
    words = ["".join(x) for x in rng.choice(list("abcdefghij"), (20_000, 6))]
    items = [(i, " ".join(rng.choice(words, 90))) for i in range(op.INDEX_CHARS // 4 // 630)]
    tracemalloc.start()
    index = op.build(items)
    built = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pickle.dumps(index)) < 12 << 20 and built < 100 << 20


def test_empty_tables(spark):
    items, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([(1, ITEMS[4][1])], "doc_id long, text string")
    assert op.contaminated(docs.limit(0), items).collect() == [] and op.contaminated(docs, items.limit(0)).collect() == []
