import json
import time

import pytest
from pyspark.sql import functions as F

from paperlake.fluent import f
from paperlake.operators import constraints as K
from paperlake.session import DocumentSession, EtagMismatch
from paperlake.sources import documents
from paperlake.sources.store import Conflict
from paperlake.streaming import changes as W


@pytest.fixture
def db(spark, tmp_path):
    return DocumentSession(spark, f"file://{tmp_path}/db")


def docs(db, name, *fields):
    return sorted(tuple(r[x] for x in fields) for r in db.find(name).collect())


def test_write_read_and_time_travel(db):
    assert db.sql("""INSERT INTO Users {"name": "Ann", "age": 30}""").affected == 1
    assert db.sql("INSERT INTO users (name, age) VALUES (UPPER('bob'), 25)").success
    v = db.store.version()
    assert docs(db, "users", "name", "age") == [("Ann", 30), ("BOB", 25)]
    assert db.sql("UPDATE users SET age = 31, city = 'X' WHERE name = 'Ann'").affected == 1
    assert docs(db, "users", "name", "age", "city")[0] == ("Ann", 31, "X")
    assert db.sql("DELETE FROM users WHERE age < 30").affected == 1
    assert docs(db, "users", "name") == [("Ann",)]
    assert sorted(r["age"] for r in db.as_of(v).find("users").collect()) == [25, 30]
    assert db.as_of(moment=time.time()).find("users").count() == 1
    assert db.sql("UPDATE nowhere SET a = 1").affected == 0 and db.sql("DELETE FROM nowhere").success
    assert db.store.vacuum() and db.find("users").count() == 1


def test_unique_and_rules(db):
    db.insert("orders", [{"pnr": "A", "n": 1}, {"pnr": "B", "n": None}])
    assert db.sql("CREATE UNIQUE INDEX i ON orders(pnr)").success
    assert not db.sql("""INSERT INTO orders {"pnr": "A", "n": 2}""").success
    assert db.sql("""INSERT INTO orders {"pnr": null, "n": 2}""").success
    assert not db.sql("UPDATE orders SET pnr = 'A' WHERE pnr = 'B'").success
    assert db.sql("UPDATE orders SET n = 5 WHERE pnr = 'B'").success
    db.set_rules("orders", K.Rules(required=["pnr"], types={"n": "Int"}, checks=[("n", "Gte", 0)]))
    r = db.insert("orders", [{"pnr": "C", "n": 1}, {"pnr": "C", "n": 1}, {"pnr": None, "n": 3}, {"pnr": "D", "n": -1}], atomic=False)
    assert r.affected == 1 and r.df.count() == 3
    with pytest.raises(K.Violation):
        db.insert("orders", [{"pnr": "Z", "n": -5}])
    assert db.sql("DROP INDEX i ON orders").success and db.compact("orders", 1).success
    assert K.Rules.from_json(K.Rules(refs=[K.Reference("a", "b")]).to_json()).refs[0].collection == "b"
    with pytest.raises(ValueError, match="required"):
        K.Rules(required=["a"], refs=[K.Reference("a", "b", on_delete="setNull")])


def test_references(db):
    db.insert("customers", [{"_id": "c1"}, {"_id": "c2"}])
    db.insert("orders", [{"_id": "o1", "customerId": "c1"}, {"_id": "o2", "customerId": "c2"}])
    db.insert("lines", [{"_id": "l1", "orderId": "o1"}, {"_id": "l2", "orderId": "o2"}])
    db.set_rules("orders", K.Rules(refs=[K.Reference("customerId", "customers", on_delete="cascade")]))
    db.set_rules("lines", K.Rules(refs=[K.Reference("orderId", "orders", on_delete="setNull")]))
    with pytest.raises(K.Violation):
        db.insert("orders", [{"_id": "o3", "customerId": "none"}])
    assert db.sql("DELETE FROM customers WHERE _id = 'c1'").affected == 1
    assert docs(db, "orders", "_id") == [("o2",)]
    assert {r["_id"]: r["orderId"] for r in db.find("lines").collect()} == {"l1": None, "l2": "o2"}
    db.set_rules("orders", K.Rules(refs=[K.Reference("customerId", "customers", on_delete="restrict")]))
    assert not db.sql("DELETE FROM customers").success


def test_conditional_updates(db):
    db.insert("inv", [{"_id": "s", "seats": 3, "x": {"y": 1}}, {"_id": "t", "seats": None, "x": None}])
    assert db.update_if("inv", [("_id", "Eq", "s"), ("seats", "Gte", 2)], [("seats", "Dec", 2)]).affected == 1
    assert db.update_if("inv", [("seats", "Gte", 2)], [("seats", "Dec", 2)]).affected == 0
    assert db.update_if("inv", [("seats", "NotExists")], [("seats", "Set", 9)]).affected == 1
    assert docs(db, "inv", "_id", "seats") == [("s", 1), ("t", 9)]
    etag = db.find_by_id("inv", "s").first()["_etag"]
    assert db.replace("inv", "s", {"seats": 7}, etag).affected == 1
    with pytest.raises(EtagMismatch):
        db.replace("inv", "s", {"seats": 8}, etag)
    row = db.find_by("inv", "seats", "7").first()
    assert row["_id"] == "s" and row["x"] is None
    assert db.bulk_update("inv", "seats", 7, "seats", 6).affected == 1


def test_transactions(db):
    db.insert("a", [{"_id": "1", "v": 1}])
    with db.begin() as tx:
        tx.insert("b", [{"_id": "9", "w": 1}])
        tx.replace("a", "1", {"v": 2})
        assert tx.read("a").first()["v"] == 2 and db.find("a").first()["v"] == 1 and db.find("b") is None
        tx.commit()
    assert db.find("a").first()["v"] == 2 and db.find("b").count() == 1
    one, two = db.begin(), db.begin()
    one.delete("a", "1")
    two.insert("a", [{"_id": "2", "v": 3}])
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert db.count("a") == 0
    assert db.batch([("insert", "a", {"_id": "5", "v": 1}), ("deleteByField", "b", "w", "1")]).affected == 2


def test_change_feed_and_ttl(db, spark, tmp_path):
    db.insert("h", [{"_id": "1", "at": 1000}, {"_id": "2", "at": 5000}, {"_id": "3", "at": None}])
    base = db.find("h")
    at = db.store.manifest()["seq"]
    db.sql("UPDATE h SET at = 9000 WHERE _id = '2'")
    db.set_ttl("h", "at")
    assert db.sweep(F.timestamp_millis(F.lit(1000))) == 1
    copy = W.apply_changes(base, db.store.changes(at))
    assert sorted((r["_id"], r["at"]) for r in copy.collect() if r["at"]) == [("2", 9000)] and copy.count() == 2
    seen = []
    q = W.follow(W.read_changes(spark, db.store.root), lambda df, n: seen.extend(r.asDict() for r in df.collect()), f"file://{tmp_path}/cp")
    q.awaitTermination(60)
    assert {r["id"]: r["op"] for r in seen} == {"1": "delete", "2": "update", "3": "insert"}


def test_snapshot_export_and_sinks(db, tmp_path):
    db.insert("a", [{"_id": "1", "v": {"w": [1, 2]}}])
    other = db.store.snapshot(f"file://{tmp_path}/copy")
    assert other.read("a").count() == 1
    db.export(f"file://{tmp_path}/out")
    assert documents.read_json(db.spark, f"file://{tmp_path}/out/a").first()["v"]["w"] == [1, 2]
    r = db.sql("SELECT * FROM a")
    lines = list(r.lines())
    assert json.loads(lines[0])["success"] and json.loads(lines[1])["v"] == {"w": [1, 2]}
    assert documents.flatten(db.find("a")).first()["v"] == '{"w":[1,2]}'
    assert "v.w[*]" in db.fields("a") and db.stats()["a"]["documents"] == 1
    assert db.drop_collection("a") and db.find("a") is None


def test_fluent(db):
    q = db.collection("p")
    q.insert({"Name": "x", "Price": 3, "Live": True})
    db.insert("p", [{"name": "y", "price": 5, "live": False}, {"name": "z", "price": None, "live": None}])
    assert q.where(f.price > 2).where(f.name != "y").count() == 1
    assert q.where(~f.live).count() == 2 and q.where(f.live).count() == 1
    assert q.where((f.price == None) | f.name.isin("x")).count() == 2  # noqa: E711
    assert [r["name"] for r in q.order_by_descending(f.price).take(2).to_list()] == ["y", "x"]
    assert q.order_by(f.price).skip(1).first()["name"] == "x"


def test_all_faults_of_a_large_insert_are_returned(db, spark):
    db.insert("many", [{"_id": "a", "k": 2}])
    db.create_index("u", "many", ["k"], unique=True)
    r = db.insert("many", spark.range(10_050).selectExpr("cast(id AS string) AS _id", "bigint(1) AS k"), atomic=False)
    assert r.affected == 1 and r.df.count() == 10_049 and r.df.columns == ["_id", "violations"]
    assert db.query("SELECT * FROM many").count() == 2
