"""Commits, the change log, and what changes keep of the documents."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlake.operators import constraints as K
from paperlake.session import HIT, DocumentSession, EtagMismatch, ReservedField
from paperlake.sources.store import Conflict, ResyncNeeded, Store
from paperlake.streaming import changes as W


@pytest.fixture
def db(spark, tmp_path):
    return DocumentSession(spark, f"file://{tmp_path}/db")


def docs(db, name, *fields):
    return sorted((tuple(r[x] for x in fields) for r in db.find(name).collect()), key=str)


def meanwhile(db, change):
    """Let another writer commit just before this session's next commit."""
    real = db.store.commit

    def commit(*args, **kwargs):
        db.store.commit = real
        change(DocumentSession(db.spark, db.store.root))
        return real(*args, **kwargs)

    db.store.commit = commit


def test_a_lost_transaction_leaves_no_change(db, spark, tmp_path):
    one, two = db.begin(), db.begin()
    one.insert("a", [{"_id": "1", "v": 1}])
    two.insert("a", [{"_id": "2", "v": 2}])
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert [r["id"] for r in db.store.changes().collect()] == ["1"]
    seen = []
    W.follow(W.read_changes(spark, db.store.root), lambda df, n: seen.extend(df.collect()), f"file://{tmp_path}/cp").awaitTermination(60)
    assert [r["id"] for r in seen] == ["1"]


def test_writers_of_the_same_operation_retry(db):
    db.insert("a", [{"_id": "0", "v": 0}])
    meanwhile(db, lambda other: other.insert("a", [{"_id": "1", "v": 1}]))
    assert db.insert("a", [{"_id": "2", "v": 2}]).affected == 1
    meanwhile(db, lambda other: other.sql("UPDATE a SET v = 10 WHERE _id = '0'"))
    assert db.sql("UPDATE a SET v = 5 WHERE _id = '2'").affected == 1
    assert docs(db, "a", "_id", "v") == [("0", 10), ("1", 1), ("2", 5)]
    seqs = [r["seq"] for r in db.store.changes().collect()]
    assert len(seqs) == len(set(seqs))


def test_nothing_that_a_dead_writer_leaves_blocks_others(db):
    """Complete manifests aside, change files without a commit, a late hint, and a commit whose change files were not moved yet."""
    db.insert("a", [{"_id": "1", "v": 1}])
    store = db.store
    store._put(store._path(f"{store.root}/_manifest/.half"), '{"version": 2', False)
    store.log(2, 1, [("a", "insert", db.spark.createDataFrame([("lost", "{}")], "id string, document string"))])
    store._publish = lambda manifest: None  # dies before it moves them
    db.insert("a", [{"_id": "2", "v": 2}])
    again = DocumentSession(db.spark, store.root)
    store._put(store._path(f"{store.root}/_manifest/_last"), "1", True)
    assert again.store.version() == 2 and again.insert("a", [{"_id": "3", "v": 3}]).affected == 1
    store._put(store._path(f"{store.root}/_manifest/_last"), "garbage", True)
    assert again.store.version() == 3
    assert [r["id"] for r in again.store.changes().orderBy("seq").collect()] == ["1", "2", "3"]


def test_only_one_can_be_a_version(db):
    base = db.store.manifest()
    db.store.commit(base, {})
    with pytest.raises(Conflict):
        db.store.commit(base, {})
    assert db.store.version() == 1


def test_times_and_versions(db):
    moments = []
    for i in range(6):
        db.insert("a", [{"_id": str(i)}])
        moments.append(db.store.manifest()["time"])
    assert [db.store.version_at(m) for m in moments] == [1, 2, 3, 4, 5, 6]
    assert db.store.version_at(moments[0] - 1) == 0 and db.store.version_at(moments[-1] + 9) == 6


def test_catch_up_says_when_a_snapshot_is_needed(db):
    for i in range(4):
        db.insert("a", [{"_id": str(i)}])
    last = db.store.manifest()["seq"]
    assert db.store.catch_up(0).count() == 4 and db.store.catch_up(last).count() == 0
    first = db.store.trim(keep=2)
    assert 0 < first < last and db.store.catch_up(first).count() == 2
    with pytest.raises(ResyncNeeded):
        db.store.catch_up(0)
    with pytest.raises(ResyncNeeded):
        db.store.catch_up(last + 1)
    assert db.store.trim(keep=2) >= first
    copy = db.store.snapshot(db.store.root + "-copy")
    assert copy.manifest()["seq"] == last and copy.catch_up(last).count() == 0


def test_equal_documents_with_one_id_are_told_apart(db):
    with pytest.raises(K.Violation, match="_id must be unique"):
        db.insert("a", [{"_id": "1", "v": 1}, {"_id": "1", "v": 1}])
    r = db.insert("a", [{"_id": "1", "v": 1}, {"_id": "1", "v": 1}, {"_id": "2", "v": 1}], atomic=False)
    assert r.affected == 2 and docs(db, "a", "_id", "v") == [("1", 1), ("2", 1)] and r.df.count() == 1
    with db.begin() as tx, pytest.raises(K.Violation):
        tx.insert("a", [{"_id": "7"}, {"_id": "7"}])
        tx.commit()
    assert db.count("a") == 2


def test_all_ids_of_an_insert_are_returned(db):
    r = db.insert("many", db.spark.range(1500).selectExpr("cast(id AS string) AS k"))
    assert len(set(r.ids)) == 1500 and r.inserted.count() == 1500
    with db.begin() as tx:
        assert tx.insert("more", db.spark.range(1200).selectExpr("cast(id AS string) AS _id")).count() == 1200
        tx.commit()


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [("2.5", "double", [1.0, 2.5]), ("'abc'", "string", ["1", "abc"]), ("true", "string", ["1", "true"]), ("9999999999", "bigint", [1, 9999999999]), ("NULL", "bigint", [None, 1])],
)
def test_update_stores_what_it_is_given(db, value, kind, want):
    db.insert("c", [{"_id": "1", "n": 1, "x": {"y": 1, "z": [1, 2]}}, {"_id": "2", "n": 1, "x": {"y": 1, "z": [1, 2]}}])
    assert db.sql(f"UPDATE c SET n = {value}, x.y = {value}, x.z[1] = {value} WHERE _id = '2'").affected == 1
    df = db.find("c")
    assert dict(df.dtypes)["n"] == kind
    assert sorted((r["n"] for r in df.collect()), key=str) == sorted(want, key=str)
    assert sorted((r[0] for r in df.select("x.y").collect()), key=str) == sorted(want, key=str)
    assert sorted((r[0] for r in df.selectExpr("x.z[1]").collect()), key=str) == sorted([2 if kind == "bigint" else 2.0 if kind == "double" else "2", want[0] if want[0] is None else want[1]], key=str)


def test_update_widens_what_other_parts_hold(db):
    """A part that isn't hit is written again where the field's type changes, and stays where it doesn't."""
    db.insert("c", [{"_id": "1", "n": 1}])
    db.insert("c", [{"_id": "2", "n": 2}])
    before = db.store.manifest()["collections"]["c"]["parts"]
    db.sql("UPDATE c SET n = 5 WHERE _id = '2'")
    assert before[0] in db.store.manifest()["collections"]["c"]["parts"]
    db.sql("UPDATE c SET n = 'five' WHERE _id = '2'")
    assert docs(db, "c", "_id", "n") == [("1", "1"), ("2", "five")]
    db.sql("UPDATE c SET m = 1 WHERE _id = '1'")
    assert docs(db, "c", "_id", "m") == [("1", 1), ("2", None)]


def test_a_timestamp_stays_one(db):
    db.insert("c", [{"_id": "1", "at": "2024-01-01T00:00:00"}])
    db.sql("UPDATE c SET at = '2025-06-01T00:00:00'")
    assert dict(db.find("c").dtypes)["at"].startswith("timestamp") and db.find("c").first()["at"].year == 2025


def test_a_chain_of_cascades_goes_to_its_end(spark):
    """110 documents, each the parent of the next; the rounds are many, so each is kept cheap."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.codegen.wholeStage": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    def written(df):
        rows = [x for r in df.collect() for x in r]
        return spark.sql(f"SELECT explode({'array(' + ', '.join(map(repr, rows)) + ')' if rows else 'cast(array() AS array<string>)'}) AS {df.columns[0]}")

    try:
        frames = {"c": spark.range(0, 110, 1, 1).selectExpr("cast(id AS string) AS _id", "if(id > 0, cast(id - 1 AS string), null) AS parent")}
        rules = {"c": K.Rules(refs=[K.Reference("parent", "c", on_delete="cascade")])}
        plan = K.plan_delete(frames, rules, "c", frames["c"].where("_id = '0'").select("_id"), written)
        assert sorted(int(r["_id"]) for r in plan.gone["c"].collect()) == list(range(110))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_cycle_of_cascades_ends(db):
    db.insert("c", [{"_id": "1", "p": "2"}, {"_id": "2", "p": "3"}, {"_id": "3", "p": "1"}, {"_id": "4", "p": None}])
    db.set_rules("c", K.Rules(refs=[K.Reference("p", "c", on_delete="cascade")]))
    assert db.sql("DELETE FROM c WHERE _id = '2'").affected == 3 and docs(db, "c", "_id") == [("4",)]


def test_patch_operations(db):
    db.insert("c", [{"_id": "1", "sold": 1, "x": {"y": 2}, "flag": True}, {"_id": "2", "sold": 5, "x": None, "flag": None}])
    ops = {"$ops": [{"field": "sold", "op": "inc", "value": 2}, {"field": "x.y", "op": "dec"}, {"field": "flag", "op": "unset"}, {"field": "state", "op": "set", "value": "new"}]}
    etag = db.find_by_id("c", "1").first()["_etag"]
    assert db.patch_by_id("c", "1", ops, etag).affected == 1
    row = db.find_by_id("c", "1").first()
    assert (row["sold"], row["x"]["y"], row["flag"], row["state"]) == (3, 1, None, "new")
    with pytest.raises(EtagMismatch):
        db.patch_by_id("c", "1", ops, etag)
    assert db.patch_by_id("c", "none", ops).affected == 0
    for bad in ({}, {"$ops": []}, {"$ops": [{"field": "a", "op": "mul", "value": 2}]}, {"$ops": [{"field": "a", "op": "inc", "value": "x"}]}, {"$ops": [{"field": "_id", "op": "unset"}]}, {"$ops": {}, "a": 1}):
        with pytest.raises(ValueError):
            db.patch_by_id("c", "1", bad)


def test_by_field(db):
    db.insert("c", [{"_id": "1", "k": 7, "v": "a"}, {"_id": "2", "k": 7, "v": "b"}, {"_id": "3", "k": 8, "v": "c"}])
    assert db.patch_by("c", "k", "7", {"v": "z"}).affected == 1
    assert db.replace_by("c", "k", "8", {"v": "y"}).affected == 1
    assert docs(db, "c", "_id", "k", "v") == [("1", 7, "z"), ("2", 7, "b"), ("3", None, "y")]
    assert db.delete_by("c", "k", "7").affected == 1 and docs(db, "c", "_id") == [("2",), ("3",)]
    assert db.patch_by("c", "k", "99", {"v": 1}).affected == 0 and db.replace_by("c", "k", "99", {}).affected == 0 and db.delete_by("c", "k", "99").affected == 0


def test_reserved_names_are_refused_and_others_are_free(db):
    with pytest.raises(ReservedField):
        db.insert("c", [{HIT: 1}])
    names = ["_hit", "_hit_", "_new0", "_held", "_violations", "_element", "_l0", "_r0", "_ref", "_parent", "_k", "_first", "_b"]
    db.insert("c", [{"_id": "1"} | {n: 1 for n in names}, {"_id": "2"} | {n: 2 for n in names}])
    db.set_rules("c", K.Rules(required=names))
    assert db.sql("UPDATE c SET _hit = 5, _new0 = 6 WHERE _id = '1'").affected == 1
    row = db.find_by_id("c", "1").first()
    assert (row["_hit"], row["_new0"], row["_hit_"]) == (5, 6, 1)
    assert db.query("SELECT a._id, b._id FROM c a JOIN c b ON a._l0 = b._r0").count() == 2
    with pytest.raises(K.Violation):
        db.insert("c", [{"_id": "3"}])


def test_files_are_cut_and_sorted_by_an_index(db, spark):
    db.insert("c", spark.range(10).selectExpr("cast(id AS string) AS _id", "id AS k", "struct(id AS n) AS x"))
    db.create_index("i", "c", ["x.n", "k"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one file
    try:
        db.insert("c", spark.range(10, 5000).selectExpr("cast(id AS string) AS _id", "id AS k", "struct(5000 - id AS n) AS x").repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    part = db.store.manifest()["collections"]["c"]["parts"][-1]
    ranges = spark.read.parquet(part).groupBy(F.input_file_name()).agg(F.min("x.n").alias("a"), F.max("x.n").alias("b")).orderBy("a").collect()
    assert len(ranges) > 1 and all(x["b"] <= y["a"] for x, y in zip(ranges, ranges[1:], strict=False))
    assert db.query("SELECT k FROM c WHERE x.n = 17").count() == 1
    assert db.rebuild_index("i", "c").success and db.count("c") == 5000 and len(db.store.manifest()["collections"]["c"]["parts"]) == 1


def test_a_query_that_fixes_the_key_reads_its_shards(db, spark):
    db.insert("c", spark.range(400).selectExpr("cast(id AS string) AS _id", "id % 40 AS k", "concat('Name', id % 7) AS s"))
    assert db.set_shard_key("c", "k", 8).success
    db.insert("c", [{"_id": "new", "k": 3, "s": "Name3"}])
    old = db.as_of(db.store.version())

    def folders(text):
        return len({r[0] for r in db.query(text).select(F.regexp_extract(F.input_file_name(), "__pl_shard=(\\d+)", 1)).collect()})

    assert db.query("SELECT * FROM c WHERE k = 3 AND s LIKE 'N%'").count() == 11 and folders("SELECT _id FROM c WHERE k = 3") == 1
    assert db.query("SELECT * FROM c WHERE k IN (3, 5.0) OR k = '7'").count() == 31 and folders("SELECT _id FROM c WHERE k IN (3, 5)") <= 2
    assert db.query("SELECT * FROM c WHERE k = 3 OR s = 'Name1'").count() == db.find("c").where("k = 3 OR s = 'Name1'").count()
    assert db.query("SELECT * FROM c WHERE NOT k = 3").count() == 390 and db.query("SELECT * FROM c x WHERE x.k = 3").count() == 11
    assert db.sql("UPDATE c SET k = 39 WHERE k = 3").affected == 11 and db.query("SELECT * FROM c WHERE k = 39").count() == 21
    assert db.set_shard_key("c", "s", 3).success and db.query("SELECT * FROM c WHERE s = 'Name1'").count() == old.query("SELECT * FROM c WHERE s = 'Name1'").count() == 57
    assert old.query("SELECT * FROM c WHERE k = 3").count() == 11 and db.count("c") == 401


def test_a_replicated_collection_is_sent_whole_while_it_is_small(db, monkeypatch):
    db.insert("big", [{"_id": str(i), "k": i} for i in range(20)])
    db.insert("small", [{"_id": str(i), "k": i} for i in range(3)])
    db.set_replicated("small")
    db.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = "SELECT big.k FROM big JOIN small ON big.k = small.k"
        assert "BroadcastHashJoin" in db.sql(text).plan and db.query(text).count() == 3
        monkeypatch.setattr("paperlake.session.REPLICATED_BYTES", 10)
        assert "BroadcastHashJoin" not in db.sql(text).plan
    finally:
        db.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_aliases_and_self_joins(db):
    db.insert("people", [{"_id": "1", "name": "Ann", "boss": None}, {"_id": "2", "name": "Bob", "boss": "1"}, {"_id": "3", "name": "Cy", "boss": "1"}])
    got = db.query("SELECT p.name, b.name FROM people p JOIN people AS b ON p.boss = b._id ORDER BY p.name").collect()
    assert [tuple(r) for r in got] == [("Bob", "Ann"), ("Cy", "Ann")]
    got = db.query("SELECT b.name, COUNT(*) FROM people p LEFT JOIN people b ON p.boss = b._id GROUP BY b.name ORDER BY b.name").collect()
    assert [tuple(r) for r in got] == [(None, 1), ("Ann", 2)]
    assert [r["p.name"] for r in db.query("SELECT p.name FROM people p WHERE p.boss = '1' ORDER BY p.name DESC").collect()] == ["Cy", "Bob"]
    assert db.query("SELECT * FROM people p WHERE p.name = 'Ann' ORDER BY p.name").first()["name"] == "Ann"
    assert not db.sql("SELECT people.name FROM people JOIN people ON people.boss = people._id").success
    assert not db.sql("SELECT * FROM people p q").success


def test_right_join_by_elements_pads_documents_once(db):
    db.insert("codes", [{"_id": "1", "code": "AA"}, {"_id": "2", "code": "BB"}])
    db.insert("trips", [{"_id": "t1", "legs": [{"code": "AA"}, {"code": "ZZ"}]}, {"_id": "t2", "legs": [{"code": "YY"}, {"code": "XX"}]}, {"_id": "t3", "legs": []}, {"_id": "t4", "legs": None}, {"_id": "t5", "legs": [{"code": "AA"}, {"code": "BB"}]}])
    got = db.query("SELECT codes.code, trips._id FROM codes RIGHT JOIN trips ON codes.code = trips.legs[*].code").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([("AA", "t1"), (None, "t2"), (None, "t3"), (None, "t4"), ("AA", "t5"), ("BB", "t5")], key=str)


def test_right_join_by_elements_of_rows_in_another_order_each_time(spark):
    def another_order(batches):
        for b in batches:
            rows = b.to_pylist()
            random.shuffle(rows)
            for r in rows:
                random.shuffle(r["legs"] or [])
            yield pa.RecordBatch.from_pylist(rows, b.schema)

    legs = [None if i % 10 == 0 else [] if i % 10 == 1 else [i % 7, i % 7, None, i % 50 + 7] for i in range(300)]
    trips = spark.createDataFrame(list(enumerate(legs)), "id long, legs array<int>").mapInArrow(another_order, "id long, legs array<int>")
    db = DocumentSession(spark).register("trips", trips).register("codes", spark.createDataFrame([(1,), (2,), (2,), (20,)], "code int"))
    want = []
    for i, x in enumerate(legs):
        want += [(c, i) for c in (1, 2, 2, 20) if c in (x or ())] or [(None, i)]
    for _ in range(2):
        got = db.query("SELECT codes.code, trips.id FROM codes RIGHT JOIN trips ON codes.code = trips.legs[*]").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rules_on_the_wire():
    body = {"required": ["a"], "types": {"a": "integer", "b": "date"}, "checks": [{"field": "a", "op": ">=", "value": 1}, {"field": "b", "op": "!exists"}], "refs": [{"field": "c", "collection": "d", "onDelete": "setnull"}]}
    rules = K.Rules.from_wire(body)
    assert rules.types == {"a": "Int", "b": "DateTime"} and rules.checks == [("a", "Gte", 1), ("b", "NotExists")] and rules.refs[0].on_delete == "setNull"
    wire = rules.to_wire()
    assert wire["checks"] == [{"field": "a", "op": "gte", "value": 1}, {"field": "b", "op": "notExists"}] and wire["refs"][0]["targetField"] == "_id"
    assert K.Rules.from_wire(wire) == rules
    for bad in ({}, {"required": "a"}, {"types": {"a": "uuid"}}, {"checks": [{"field": "a", "op": "~", "value": 1}]}, {"checks": [{"field": "a", "op": "eq"}]}, {"refs": [{"field": "a", "collection": "b", "onDelete": "x"}]}):
        with pytest.raises(ValueError):
            K.Rules.from_wire(bad)


def test_import_of_files(db, spark, tmp_path):
    spark.createDataFrame([(f'{{"_id":"{i}","n":{i},"at":"2024-01-0{i + 1}T00:00:00"}}',) for i in range(5)], "value string").coalesce(1).write.text(f"file://{tmp_path}/in")
    r = db.import_json("c", f"file://{tmp_path}/in")
    assert r.affected == 5 and dict(db.find("c").dtypes)["at"].startswith("timestamp")
    db.create_index("u", "c", ["n"], unique=True)
    assert db.import_json("c", f"file://{tmp_path}/in", atomic=False).affected == 0
    assert db.import_json("d", f"file://{tmp_path}/in", checked=False).affected == 5 and db.store.changes().where("collection = 'd'").count() == 0


def test_a_sweep_that_repeats(db, spark, tmp_path):
    db.insert("h", [{"_id": "1", "at": 1000}, {"_id": "2", "at": 99999999999999}])
    db.set_ttl("h", "at")
    q = W.sweep_every(spark, db.sweep, "1 second", f"file://{tmp_path}/cp")
    try:
        for _ in range(60):
            if db.count("h") == 1:
                break
            q.processAllAvailable()
    finally:
        q.stop()
    assert docs(db, "h", "_id") == [("2",)]


def test_vacuum_keeps_what_is_named(db):
    for i in range(3):
        db.insert("a", [{"_id": str(i)}])
    db.compact("a")
    gone = db.store.vacuum()
    assert len(gone) >= 3 and db.count("a") == 3 and isinstance(db.store, Store)


def test_many_small_parts_are_merged(db, monkeypatch):
    monkeypatch.setattr("paperlake.session.MANY_PARTS", 3)
    for i in range(5):
        db.insert("a", [{"_id": str(i), "v": i}])
    assert len(db.store.manifest()["collections"]["a"]["parts"]) <= 3 and docs(db, "a", "v") == [(i,) for i in range(5)]
    monkeypatch.setattr("paperlake.session.SMALL_PART_BYTES", 10)
    for i in range(5, 9):
        db.insert("a", [{"_id": str(i), "v": i}])
    assert len(db.store.manifest()["collections"]["a"]["parts"]) > 3 and db.count("a") == 9


def test_ids_that_were_drawn_are_not_compared(db):
    db.insert("a", [{"v": 1}])
    new = db._rows(db.store.manifest()["collections"]["a"]["parts"][0], db.find("a").schema)
    entry = db._entry(db.store.manifest(), "a")
    plans = [db._faults("a", entry, new, db.find("a"), db.store.manifest(), drawn)._jdf.queryExecution().analyzed().toString() for drawn in (True, False)]
    assert "Join" not in plans[0] and "Join" in plans[1]


def test_a_rename_takes_a_free_name_alone(db):
    store = db.store
    one, two, target = (store._path(f"{store.root}/_manifest/{n}") for n in ("one", "two", "target"))
    store._put(one, "1", False)
    store._put(two, "2", False)
    store._rename(one, target)
    with pytest.raises(Exception, match="exists|Exists"):
        store._rename(two, target)
    assert store._line(target) == "1"


def test_a_delete_rewrites_the_parts_that_it_touches_and_logs_what_it_changes(db):
    db.insert("p", [{"_id": "p1", "k": 1}, {"_id": "p2", "k": 2}])
    for i in range(3):
        db.insert("kids", [{"_id": f"k{i}", "p": "p1" if i == 1 else "p2", "v": i}])
    db.set_rules("kids", K.Rules(refs=[K.Reference("p", "p", on_delete="setNull")]))
    before = db.store.manifest()["collections"]["kids"]["parts"]
    seq, etags = db.store.manifest()["seq"], {r["_id"]: r["_etag"] for r in db.find("kids").collect()}
    assert db.sql("DELETE FROM p WHERE k = 1").affected == 1
    after = db.store.manifest()["collections"]["kids"]["parts"]
    assert len(set(before) & set(after)) == 2 and docs(db, "kids", "_id", "p", "v") == [("k0", "p2", 0), ("k1", None, 1), ("k2", "p2", 2)]
    assert sorted((r["collection"], r["op"], r["id"]) for r in db.store.changes(seq).collect()) == [("kids", "update", "k1"), ("p", "delete", "p1")]
    assert {k for k, v in etags.items() if db.find_by_id("kids", k).first()["_etag"] != v} == {"k1"}


def test_a_tables_schema_is_read_again_when_it_changes(spark, tmp_path):
    from paperlake.sources.tables import read_table

    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    assert read_table(spark, path).columns == ["id"] and read_table(spark, path).count() == 3
    spark.range(2).selectExpr("id AS k", "'x' AS v").write.mode("overwrite").parquet(path)
    assert read_table(spark, path).columns == ["k", "v"] and read_table(spark, path).count() == 2


def test_changes_of_schemaless_documents(db):
    """Values that conflict make a collection schemaless; updates then change each document by itself."""
    db.insert("m", ['{"_id": "1", "v": 1, "x": {"y": 1, "z": [1, {"q": 2}]}}', '{"_id": "2", "v": "text", "x": "none"}', '{"_id": "3", "v": null, "w": true}'])
    assert dict(db.find("m").dtypes)["_doc"] == "variant"

    def value(path, key):
        return db.query(f"SELECT {path} AS p FROM m WHERE _id = '{key}'").selectExpr("to_json(p)").first()[0]

    assert db.sql("UPDATE m SET v = 2.5, x.y = 'new', n = 7 WHERE _id = '1'").affected == 1
    assert [value("v", k) for k in "123"] == ["2.5", '"text"', "null"] and value("x.y", "1") == '"new"' and value("n", "1") == "7" and value("n", "2") is None
    assert db.sql("UPDATE m SET x.z[1].q = 9, x.none.deep = 1").affected == 3
    assert value("x.z", "1") == '[1,{"q":9}]' and value("x", "2") == '"none"' and value("x", "3") is None
    assert db.update_if("m", [("w", "Eq", True)], [("w", "Unset"), ("v", "Set", 4)]).affected == 1
    assert value("v", "3") == "4" and value("w", "3") is None
    lines = [json.loads(x) for x in db.sql("SELECT * FROM m WHERE _id = '2'").lines()]
    assert {k: v for k, v in lines[1].items() if k != "_etag"} == {"_id": "2", "v": "text", "x": "none"} and len(lines[1]["_etag"]) == 32
    assert db.sql("DELETE FROM m WHERE v = 'text'").affected == 1 and db.count("m") == 2


def test_a_typed_collection_becomes_schemaless_with_what_conflicts(db):
    db.insert("m", [{"_id": "1", "v": 1, "at": "2024-01-01T00:00:00", "none": None}])
    db.insert("m", ['{"_id": "2", "v": 1}', '{"_id": "3", "v": "x"}'])
    db.insert("m", [{"_id": "4", "v": 5}])
    df = db.find("m")
    assert df.columns == ["_id", "_etag", "_doc"] and db.query("SELECT COUNT(*) FROM m WHERE v = 1").first()[0] == 2
    assert db.query("SELECT COUNT(*) FROM m WHERE v = 5").first()[0] == 1 and db.query("SELECT COUNT(*) FROM m WHERE none IS NULL").first()[0] == 4
    with pytest.raises(K.Violation):
        db.insert("m", [{"_id": "4", "v": 6}])
