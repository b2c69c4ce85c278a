import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.llm import op4_simhash as op
from paperlake.llm.common import connected_components, spanning_roots

SF = "/root/testdata/sf0.001"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        up[b] = a
    return [find(i) for i in range(n)]


def brute_components(prints, ids):
    fp = np.array(prints, dtype=np.uint64)
    pairs = [(i, int(j) + i + 1) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= 3)]
    part = roots(len(fp), pairs)
    least = {}
    for p, k in zip(part, ids, strict=True):
        least[p] = min(least.get(p, k), k)
    return [least[p] for p in part]


def near(rng, base, most, n):
    out = []
    for _ in range(n):
        x = base
        for b in rng.choice(64, int(rng.integers(0, most + 1)), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "one two", "One TWO three", "a b c a b c", "ÄB äb \x1c x", "nb sp", "x " * 3000])
def test_fingerprint(text):
    assert op.fingerprint(text or "") == brute_print(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80))
def test_fingerprint_of_any_text(text):
    assert op.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_pairs_are_brute_force(radius):
    rng = np.random.default_rng(radius)
    fp, group = [], []
    for g in range(40):
        size = int(rng.integers(1, 90))
        base = int(rng.integers(1 << 63))
        fp += near(rng, base, 4, size)
        group += [g] * size
    fp, group = np.array(fp, dtype=np.uint64), np.array(group)
    i, j = op.near_pairs(fp, group, radius)
    got = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= radius}
    assert got == want and len(i) == len(got)


def test_bands_of_every_level_keep_all_pairs():
    """Two prints within the radius agree on the bits of some path, whatever path of above led there."""
    rng = np.random.default_rng(3)
    masks = op.band_masks(3)
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        paths = [p for p, m in enumerate(masks[0]) if not m & diff]
        assert paths
        for level in masks[1:]:
            paths = [4 * p + k for p in paths for k in range(4) if not level[4 * p + k] & diff]
            assert paths


@pytest.mark.parametrize("bucket", [4, 1024])
def test_divided_buckets_lose_no_link(spark, bucket):
    rng = np.random.default_rng(5)
    prints = [0, *near(rng, 0, 3, 60), *near(rng, 0x0123456789ABCDEF, 5, 120), *(int(x) for x in rng.integers(1 << 63, size=50))]
    prints = sorted(set(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    parts = {r["node"]: r["component"] for r in connected_components(op.links(distinct, bucket), "test").collect()}
    assert [parts.get(i, i) for i in range(len(prints))] == brute_components(prints, range(len(prints)))


def test_odd_rows(spark):
    texts = [(9, None), (4, ""), (7, " \n"), (3, "some words that stand alone here"), (5, "SOME words that stand alone here"), (5, "SOME words that stand alone here"), (8, "x y z " * 9000), (None, "some words that stand alone here"), (None, "only a null key has this text at all")]
    df = spark.createDataFrame([(k, t, "x") for k, t in texts], "doc_id long, text string, fp string")
    got = op.near_duplicates(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]) for r in got) == sorted((k is None, k or 0, f"{brute_print(t):016x}") for k, t in texts)
    part = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    zero = "0" * 16
    assert part[9, zero] == part[4, zero] == part[7, zero] == 4
    same = f"{brute_print(texts[3][1]):016x}"
    assert part[3, same] == part[5, same] == part[None, same] == 3
    assert part[None, f"{brute_print(texts[-1][1]):016x}"] is None


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(r["text"]) for r in rows]
    parts = brute_components(prints, [r["doc_id"] for r in rows])
    got = op.op4_simhash(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(r["doc_id"], f"{f:016x}", p) for r, f, p in zip(rows, prints, parts, strict=True)]


def test_components_of_a_chain_a_hub_and_nulls(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, i) for i in range(501, 900)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7), (None, 3), (160, 100), (900, 899)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, "test").collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 500 for i in range(501, 901)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=30))
def test_spanning_roots(pairs):
    a, b = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    want = roots(16, pairs)
    nodes, found = spanning_roots(a, b)
    assert found.tolist() == [want[n] for n in nodes.tolist()]
