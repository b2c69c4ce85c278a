import hashlib
import json

import pytest

from paperlake.sources.blobs import Blobs, Compaction


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def blobs(spark, tmp_path):
    return Blobs(spark, f"file://{tmp_path}/blobs")


def frame(spark, *contents):
    return spark.createDataFrame([(bytearray(c) if c is not None else None,) for c in contents], "content binary")


def test_contents_are_kept_once(spark, blobs):
    got = blobs.put(frame(spark, b"one", b"two", b"one", b"", None))
    assert sorted(map(tuple, got.collect())) == sorted((sha(c), len(c)) for c in (b"one", b"two", b""))
    blobs.put(frame(spark, b"two", b"three"))
    assert sorted(r["sha256"] for r in blobs.live().collect()) == sorted(map(sha, (b"one", b"two", b"three", b"")))
    assert json.loads(blobs.manifest()) == {"blobs": 4, "bytes": 11}


def test_ranges(spark, blobs):
    blobs.put(frame(spark, b"0123456789"))
    key = sha(b"0123456789")
    assert blobs.get(key) == blobs.get(key.upper()) == b"0123456789" and blobs.length_of(key) == 10
    assert blobs.get(key, 3) == b"3456789" and blobs.get(key, 3, 2) == b"34" and blobs.get(key, 9, 50) == b"9"
    assert blobs.get(key, 10) == b"" and blobs.get(key, 0, 0) == b""
    assert blobs.get("0" * 64) is None and blobs.length_of("no digest") is None
    with pytest.raises(ValueError):
        blobs.get(key, -1)


def test_garbage_and_compaction(spark, blobs):
    assert blobs.collect_garbage(spark.createDataFrame([], "sha256 string")) == 0
    blobs.put(frame(spark, b"keep", b"drop me"))
    named = spark.createDataFrame([(sha(b"keep").upper(),), ("unknown",)], "sha256 string")
    at = blobs.store.version()
    assert blobs.collect_garbage(named) == 1 and blobs.collect_garbage(named) == 0
    assert blobs.get(sha(b"drop me")) is None and blobs.get(sha(b"keep")) == b"keep"
    assert blobs.live(at).count() == 2
    blobs.put(frame(spark, b"drop me"))
    assert blobs.get(sha(b"drop me")) == b"drop me"
    assert blobs.collect_garbage(named) == 1
    blobs.store.vacuum()
    assert blobs.live().count() == 1
    assert blobs.compact() == Compaction(1, 2, 14)
    assert blobs.compact() == Compaction(1, 0, 0)
    blobs.store.vacuum()
    assert [bytes(r["content"]) for r in blobs.live().collect()] == [b"keep"]


def test_files(spark, blobs, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.bin", b"same"), ("b.bin", b"same"), ("c.bin", b"\x00\xff")):
        (tmp_path / "in" / name).write_bytes(data)
    assert blobs.put_files(f"file://{tmp_path}/in").count() == 2
    assert blobs.get(sha(b"\x00\xff")) == b"\x00\xff"
