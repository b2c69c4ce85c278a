"""Queries that write to a database of their own, commit, and read back; each with the SQL for what must be there then."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import constraints as K
from .plans import build
from .plans.parser import parse
from .queries import Tables, native, plain, rows_in_store
from .session import DocumentSession, EtagMismatch
from .sources import documents
from .sources.blobs import Blobs
from .sources.store import Conflict, ResyncNeeded, scratch_root
from .streaming import changes as W


# joins and aliases
@native('SELECT a.n_name AS "a.n_name", b.n_name AS "b.n_name" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 3')
def self_join(t: Tables) -> DataFrame:
    q = parse("SELECT a.n_name, b.n_name FROM nation a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 3")
    return build.select(q, t.get_frame)


@native("SELECT o_orderkey AS \"o.o_orderkey\" FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10")
def alias_of_one(t: Tables) -> DataFrame:
    return build.select(parse("SELECT o.o_orderkey FROM orders o WHERE o.o_orderstatus = 'F' ORDER BY o.o_orderkey LIMIT 10"), t.get_frame)


@native("""WITH few AS (SELECT * FROM part WHERE p_size < 10), l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
met AS (SELECT p_partkey, l_orderkey FROM few JOIN l ON p_partkey = l_partkey)
SELECT p_partkey AS "few.p_partkey", l_orderkey AS "orders_doc.o_orderkey" FROM met
UNION ALL SELECT NULL, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM met)""")
def join_array_right(t: Tables) -> DataFrame:
    """A document on the right that no element joins is there once."""
    t["few"] = t["part"].where("p_size < 10")
    return build.select(parse("SELECT few.p_partkey, orders_doc.o_orderkey FROM few RIGHT JOIN orders_doc ON few.p_partkey = orders_doc.lines[*].l_partkey"), t.get_frame)


# updates
@native("SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 2.5 ELSE CAST(n_regionkey AS DOUBLE) END AS n_regionkey FROM nation")
def update_widen(t: Tables) -> DataFrame:
    db = rows_in_store(t, nation="n_nationkey")
    db.sql("UPDATE nation SET n_regionkey = 2.5 WHERE n_nationkey = 7")
    return plain(db, "nation").select("n_nationkey", "n_regionkey")


@native("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'none' ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation")
def update_to_text(t: Tables) -> DataFrame:
    db = rows_in_store(t, nation="n_nationkey")
    db.sql("UPDATE nation SET n_regionkey = 'none' WHERE n_nationkey < 5")
    return plain(db, "nation").select("n_nationkey", "n_regionkey")


@native("SELECT CAST(c_custkey AS VARCHAR) AS _id, c_custkey, CASE WHEN c_nationkey = 3 THEN upper(c_name) ELSE c_name END AS c_name FROM customer WHERE NOT c_acctbal < 0")
def store_update_delete(t: Tables) -> DataFrame:
    """An UPDATE and a DELETE over several parts, of which some stay as they are."""
    db = rows_in_store(t, customer="c_custkey")
    db.sql("UPDATE customer SET c_name = UPPER(c_name) WHERE c_nationkey = 3")
    db.sql("DELETE FROM customer WHERE c_acctbal < 0")
    return db.find("customer").select("_id", "c_custkey", "c_name")


@native("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey <> 3 UNION ALL SELECT 3, 'new', 1, 0.5, NULL")
def replace_by_id(t: Tables) -> DataFrame:
    """What the new document doesn't have is gone."""
    db = rows_in_store(t, customer="c_custkey")
    db.replace("customer", "3", {"c_custkey": 3, "c_name": "new", "c_nationkey": 1, "c_acctbal": 0.5})
    return plain(db, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@native("SELECT 'first' AS name, 1 AS refused")
def replace_if_version(t: Tables) -> DataFrame:
    """Of two who read one version the second to write is refused."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    db.insert("region", t["region"].withColumn("_id", F.col("r_regionkey").cast("string")))
    seen = db.find_by_id("region", "1").first()["_etag"]
    db.replace("region", "1", {"r_regionkey": 1, "r_name": "first"}, seen)
    refused = 0
    try:
        db.replace("region", "1", {"r_regionkey": 1, "r_name": "second"}, seen)
    except EtagMismatch:
        refused = 1
    return db.find_by_id("region", "1").select(F.col("r_name").alias("name"), F.lit(refused).alias("refused"))


@native("SELECT p_partkey, CASE WHEN p_size >= 5 THEN p_size - 5 ELSE p_size END AS p_size FROM part")
def store_conditional_update(t: Tables) -> DataFrame:
    db = rows_in_store(t, part="p_partkey")
    db.update_if("part", [("p_size", "Gte", 5), ("p_partkey", "Exists")], [("p_size", "Dec", 5)])
    return plain(db, "part").select("p_partkey", "p_size")


@native("SELECT s_suppkey, CASE WHEN s_suppkey = 2 THEN s_acctbal + 10 WHEN s_suppkey = 3 THEN NULL ELSE s_acctbal END AS s_acctbal, CASE WHEN s_suppkey = 2 THEN 'x' ELSE s_name END AS s_name FROM supplier")
def patch_operations(t: Tables) -> DataFrame:
    """A patch of operations by id, and a merge by a field."""
    db = rows_in_store(t, supplier="s_suppkey")
    db.patch_by_id("supplier", "2", {"$ops": [{"field": "s_acctbal", "op": "inc", "value": 10}, {"field": "s_name", "op": "set", "value": "x"}]})
    db.patch_by("supplier", "s_suppkey", "3", {"s_acctbal": None})
    return plain(db, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"), "s_name")


@native("SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOMES' ELSE c_mktsegment END AS segment, count(*) AS n FROM customer GROUP BY 1")
def bulk_update(t: Tables) -> DataFrame:
    db = rows_in_store(t, customer="c_custkey")
    db.bulk_update("customer", "c_mktsegment", "BUILDING", "c_mktsegment", "HOMES")
    return db.find("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@native("SELECT n_nationkey, CASE WHEN n_name = (SELECT n_name FROM nation WHERE n_nationkey = 2) THEN 'there' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 5")
def by_field(t: Tables) -> DataFrame:
    """Get, put and delete by a field's text."""
    db = rows_in_store(t, nation="n_nationkey")
    row = db.find_by("nation", "n_nationkey", "2").first()
    db.replace_by("nation", "n_name", row["n_name"], {"n_nationkey": 2, "n_name": "there", "n_regionkey": row["n_regionkey"]})
    db.delete_by("nation", "n_nationkey", "5")
    return plain(db, "nation").select("n_nationkey", "n_name")


# inserts
@native("SELECT DISTINCT CAST(c_custkey % 10 AS VARCHAR) AS _id, (SELECT count(*) - 10 FROM customer) AS faults FROM customer")
def insert_duplicate_ids(t: Tables) -> DataFrame:
    """Of many documents with one id the first stays and the others are faults."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    r = db.insert("c", t["customer"].withColumn("_id", (F.col("c_custkey") % 10).cast("string")), atomic=False)
    return db.find("c").select("_id", F.lit(r.df.count()).cast("long").alias("faults"))


@native("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey UNION ALL SELECT -1, count(*) FROM nation WHERE n_nationkey % 2 = 1")
def insert_tracked(t: Tables) -> DataFrame:
    """An insert that isn't atomic keeps what no rule refuses; the rest is in the result as faults."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    db.set_rules("c", K.Rules(checks=[("even", "Eq", True)]))
    r = db.insert("c", t["nation"].withColumn("even", F.col("n_nationkey") % 2 == 0), atomic=False)
    kept = db.find("c").groupBy(F.col("n_regionkey").cast("long").alias("n_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(r.df.agg(F.lit(-1).cast("long").alias("n_regionkey"), F.count(F.lit(1)).alias("n")))


@native("SELECT r_regionkey, r_name, 0 AS refused FROM region UNION ALL SELECT 99, 'more', 1")
def insert_atomic(t: Tables) -> DataFrame:
    """A refused insert leaves nothing, also not in the change log."""
    db = rows_in_store(t, region="r_regionkey")
    db.create_index("u", "region", ["r_name"], unique=True)
    refused = 0
    try:
        db.insert("region", [{"r_regionkey": 50, "r_name": "fresh"}, {"r_regionkey": 51, "r_name": "fresh"}])
    except K.Violation:
        refused = 1 + db.store.changes().count()
    db.insert("region", [{"r_regionkey": 99, "r_name": "more"}])
    return plain(db, "region").select("r_regionkey", "r_name", F.when(F.col("r_regionkey") == 99, refused).otherwise(0).alias("refused"))


@native("SELECT p_partkey, p_name, p_size FROM part")
def insert_json_files(t: Tables) -> DataFrame:
    """Bulk insert of JSON files."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    path = f"{scratch_root(t.spark)}/in"
    documents.to_json(t["part"].select("p_partkey", "p_name", "p_size")).select(F.col("json").alias("value")).write.text(path)
    db.import_json("part", path)
    return plain(db, "part").select("p_partkey", "p_name", "p_size")


@native("SELECT s_suppkey, s_name FROM supplier")
def stream_lines(t: Tables) -> DataFrame:
    """A result as lines of JSON behind one that describes it, read again."""
    db = rows_in_store(t, supplier="s_suppkey")
    first, *lines = db.sql("SELECT s_suppkey, s_name FROM supplier").lines()
    assert '"success": true' in first
    return documents.from_texts(t.spark, lines).select("s_suppkey", "s_name")


@native("SELECT 'nation' AS collection, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def export_collections(t: Tables) -> DataFrame:
    db = rows_in_store(t, nation="n_nationkey", region="r_regionkey")
    path = scratch_root(t.spark)
    said = db.export(path)
    out = None
    for name in said["collections"]:
        df = documents.read_json(t.spark, f"{path}/{name}").agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("n"))
        out = df if out is None else out.unionByName(df)
    return out


@native("SELECT unnest(['c_custkey', 'c_name', 'o_orderkey', 'lines[*].l_partkey', 'customer.c_name']) AS path")
def field_listing(t: Tables) -> DataFrame:
    from .operators.paths import field_paths

    wanted = {"c_custkey", "c_name", "o_orderkey", "lines[*].l_partkey", "customer.c_name"}
    found = {*field_paths(t["orders_doc"].schema), *field_paths(t["customer"].schema)}
    return t.spark.createDataFrame([(p,) for p in sorted(wanted & found)], "path string")


@native("SELECT 'nation' AS collection, (SELECT count(*) FROM nation) AS documents, 1 AS indexes UNION ALL SELECT 'region', (SELECT count(*) FROM region), 0")
def statistics(t: Tables) -> DataFrame:
    db = rows_in_store(t, nation="n_nationkey", region="r_regionkey")
    db.create_index("i", "nation", ["n_regionkey"])
    return t.spark.createDataFrame([(k, v["documents"], v["indexes"]) for k, v in db.stats().items()], "collection string, documents long, indexes int")


@native("SELECT count(DISTINCT text) AS contents, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT text, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL)")
def blob_contents(t: Tables) -> DataFrame:
    """Contents put twice are kept once."""
    blobs = Blobs(t.spark, scratch_root(t.spark))
    df = t["documents"].select(F.col("text").cast("binary").alias("content"))
    blobs.put(df)
    blobs.put(df)
    return blobs.live().agg(F.count(F.lit(1)).alias("contents"), F.sum("length").alias("bytes"))


# indexes and layout
@native("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice, o_orderkey LIMIT 100")
def index_range_limit(t: Tables) -> DataFrame:
    """A range with a limit on a collection whose files are cut and sorted by the field."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    db.insert("orders", t["orders"].limit(0), checked=False)
    db.create_index("price", "orders", ["o_totalprice"])
    db.insert("orders", t["orders"], checked=False)
    return db.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice, o_orderkey LIMIT 100").drop("_id")


@native("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 11, 13) OR o_custkey = 20")
def shard_routing(t: Tables) -> DataFrame:
    """A collection laid out by a key, of which a query reads the shards that its literals name."""
    db = rows_in_store(t, orders="o_orderkey")
    db.set_shard_key("orders", "o_custkey", 16)
    return db.query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 11, 13) OR o_custkey = 20").drop("_id")


@native("SELECT o_custkey % 5 AS k, count(*) AS n FROM orders GROUP BY 1")
def reshard(t: Tables) -> DataFrame:
    """Laid out anew over more shards while a reader of the old version goes on."""
    db = rows_in_store(t, orders="o_orderkey")
    db.set_shard_key("orders", "o_custkey", 4)
    old = db.find("orders")
    db.set_shard_key("orders", "o_custkey", 6)
    both = db.find("orders").select("o_orderkey", "o_custkey").join(old.select("o_orderkey"), "o_orderkey")
    return both.groupBy((F.col("o_custkey") % 5).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@native("SELECT c_name AS \"customer.c_name\", n_name AS \"nation.n_name\" FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_replicated(t: Tables) -> DataFrame:
    db = rows_in_store(t, customer="c_custkey", nation="n_nationkey")
    db.set_replicated("nation")
    return db.query("SELECT customer.c_name, nation.n_name FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey")


@native("SELECT 2 AS refused, count(*) AS n FROM region")
def unique_index(t: Tables) -> DataFrame:
    """A unique index refuses equal keys until it is dropped; keys that are null are exempt."""
    db = rows_in_store(t, region="r_regionkey")
    refused = int(not db.sql("CREATE UNIQUE INDEX u ON nowhere(r_name)").success)
    db.sql("CREATE UNIQUE INDEX u ON region(r_name)")
    name = t["region"].orderBy("r_regionkey").first()["r_name"]
    refused += int(not db.sql(f"""INSERT INTO region {{"r_regionkey": 70, "r_name": "{name}"}}""").success)
    db.sql("DROP INDEX u ON region")
    db.sql(f"""INSERT INTO region {{"r_regionkey": 70, "r_name": "{name}"}}""")
    db.compact("region", 1)
    return db.find("region").where("r_regionkey < 70").agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


@native("SELECT 0 AS affected, 0 AS collections")
def drop_collection(t: Tables) -> DataFrame:
    db = rows_in_store(t, region="r_regionkey")
    db.drop_collection("region")
    affected = db.sql("UPDATE region SET r_name = 'x'").affected + db.sql("DELETE FROM region").affected
    return t.spark.createDataFrame([(affected, len(db.collections()))], "affected int, collections int")


# transactions
@native("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1 AND n_nationkey <> 0 UNION ALL SELECT 0, 'replaced' UNION ALL SELECT 100, 'new'")
def transaction(t: Tables) -> DataFrame:
    """Staged changes are seen by the transaction's own reads alone, and by all after the commit."""
    db = rows_in_store(t, nation="n_nationkey")
    before = db.count("nation")
    with db.begin() as tx:
        tx.insert("nation", [{"_id": "100", "n_nationkey": 100, "n_name": "new"}])
        tx.delete_by("nation", "n_regionkey", "1")
        tx.replace("nation", "0", {"n_nationkey": 0, "n_name": "replaced"})
        assert tx.read("nation").count() != before == db.count("nation")
        tx.commit()
    return plain(db, "nation").select("n_nationkey", "n_name")


@native("SELECT '1' AS id, 'insert' AS op, 1 AS conflicts")
def transaction_conflict(t: Tables) -> DataFrame:
    """The first to commit wins, and what the other did is nowhere: not in the collections and not in the log."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    one, two = db.begin(), db.begin()
    one.insert("c", [{"_id": "1"}])
    two.insert("c", [{"_id": "2"}])
    one.commit()
    conflicts = 0
    try:
        two.commit()
    except Conflict:
        conflicts = 1
    return db.store.changes().join(db.find("c").select(F.col("_id").alias("id")), "id").select("id", "op", F.lit(conflicts).alias("conflicts"))


@native("SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (2, 3) UNION ALL SELECT 8, 'eight' UNION ALL SELECT 2, 'two'")
def batch(t: Tables) -> DataFrame:
    db = rows_in_store(t, region="r_regionkey")
    db.batch([("insert", "region", {"r_regionkey": 8, "r_name": "eight"}), ("replace", "region", "2", {"r_regionkey": 2, "r_name": "two"}), ("delete", "region", "3")])
    return plain(db, "region").select("r_regionkey", "r_name")


@native("SELECT count(*) AS before, count(*) - 1 AS after FROM region")
def time_travel(t: Tables) -> DataFrame:
    """By version and by moment, and a snapshot of the older version as a store of its own."""
    db = rows_in_store(t, region="r_regionkey")
    version, moment = db.store.version(), time.time()
    db.sql("DELETE FROM region WHERE r_regionkey = 1")
    copy = db.store.snapshot(scratch_root(t.spark), version)
    before = {db.as_of(version).count("region"), db.as_of(moment=moment).count("region"), copy.read("region").count()}
    assert len(before) == 1
    return t.spark.createDataFrame([(before.pop(), db.count("region"))], "before long, after long")


# change feed
@native("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey = 2 THEN 'delete' WHEN n_regionkey = 1 THEN 'update' ELSE 'insert' END AS op FROM nation")
def change_feed(t: Tables) -> DataFrame:
    """The last change of each document, from the log."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    db.insert("nation", t["nation"].withColumn("_id", F.col("n_nationkey").cast("string")))
    db.sql("UPDATE nation SET n_name = LOWER(n_name) WHERE n_regionkey = 1")
    db.sql("DELETE FROM nation WHERE n_regionkey = 2")
    return W.collapse(db.store.changes().select("id", "seq", "op"), ["id"]).select("id", "op")


@native("SELECT 1 AS needed, count(*) AS n FROM region")
def change_catch_up(t: Tables) -> DataFrame:
    """A follower that is too far behind is told; one with a snapshot goes on from there."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    db.insert("region", t["region"].withColumn("_id", F.col("r_regionkey").cast("string")))
    db.sql("UPDATE region SET r_name = LOWER(r_name)")
    first = db.store.trim(keep=1)
    needed = 0
    try:
        db.store.catch_up(0)
    except ResyncNeeded:
        needed = 1
    return db.store.catch_up(first).agg(F.lit(needed).alias("needed"), F.count(F.lit(1)).alias("n"))


@native("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 2")
def follower(t: Tables) -> DataFrame:
    """A copy that the stream of changes keeps up with."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    db.insert("nation", t["nation"].withColumn("_id", F.col("n_nationkey").cast("string")))
    base, at = db.store.snapshot(scratch_root(t.spark)).read("nation"), db.store.manifest()["seq"]
    db.sql("UPDATE nation SET n_name = LOWER(n_name) WHERE n_regionkey = 1")
    db.sql("DELETE FROM nation WHERE n_regionkey = 2")
    path = scratch_root(t.spark)
    W.follow(W.read_changes(t.spark, db.store.root).where(F.col("seq") > at), lambda df, number: df.write.mode("overwrite").parquet(f"{path}/{number}"), f"{path}-checkpoint").awaitTermination()
    return W.apply_changes(base, t.spark.read.parquet(f"{path}/*").select("seq", "op", "id", "document")).select("n_nationkey", "n_name")


@native("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'")
def ttl_sweep(t: Tables) -> DataFrame:
    db = rows_in_store(t, events="event_id")
    db.set_ttl("events", "ts")
    db.sweep(F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return db.find("events").select("event_id")


# constraints, limits and the fluent front end
@native("SELECT s_suppkey, CASE WHEN s_nationkey = 4 THEN NULL ELSE s_nationkey END AS s_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey <> 4) AS customers FROM supplier")
def store_delete_actions(t: Tables) -> DataFrame:
    """Deleting a nation deletes its customers and takes it from its suppliers, in one commit."""
    db = rows_in_store(t, nation="n_nationkey", supplier="s_suppkey", customer="c_custkey")
    db.set_rules("customer", K.Rules.from_wire({"refs": [{"field": "c_nationkey", "collection": "nation", "targetField": "n_nationkey", "onDelete": "cascade"}]}))
    db.set_rules("supplier", K.Rules.from_wire({"refs": [{"field": "s_nationkey", "collection": "nation", "targetField": "n_nationkey", "onDelete": "setNull"}]}))
    db.sql("DELETE FROM nation WHERE n_nationkey = 4")
    return plain(db, "supplier").select("s_suppkey", "s_nationkey", F.lit(db.count("customer")).cast("long").alias("customers"))


@native("SELECT least(count(*), 40) AS n FROM customer")
def auto_limit(t: Tables) -> DataFrame:
    """A session's own limit for queries without one, which stops a scan early."""
    db = DocumentSession(t.spark, auto_limit=40).register("customer", t["customer"])
    return db.query("SELECT c_custkey FROM customer").agg(F.count(F.lit(1)).alias("n"))


@native("SELECT least(count(*), 25) AS n, 1 AS stops_early FROM orders WHERE o_totalprice > 1000")
def limit_early(t: Tables) -> DataFrame:
    """A limit without an order is taken from each task's first rows; which rows isn't said, so they are counted."""
    df = build.select(parse("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 LIMIT 20 OFFSET 5"), t.get_frame)
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df.agg((F.count(F.lit(1)) + 5).alias("n"), F.lit(int("Limit" in plan and "Sort" not in plan)).alias("stops_early"))


@native("SELECT count(*) AS rows, count(*) AS ids, 1 AS moments, 32 AS length FROM nation")
def fn_newid_now(t: Tables) -> DataFrame:
    """A new id for each row, and one moment for a query."""
    df = build.select(parse("SELECT n_name, NEWID() AS id, NOW() AS at FROM nation"), t.get_frame)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.count_distinct("at").cast("int").alias("moments"), F.max(F.length("id")).alias("length"))


@native("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderkey LIMIT 7 OFFSET 3")
def fluent_nested_skip(t: Tables) -> DataFrame:
    from .fluent import f

    s = DocumentSession(t.spark).register("orders", t["orders_doc"])
    return s.collection("orders").where(f.customer.c_mktsegment == "BUILDING").order_by(f.o_orderkey).skip(3).take(7).to_df().select("o_orderkey")


@native('SELECT r_regionkey AS "regionKey", r_name AS name FROM region')
def fluent_insert(t: Tables) -> DataFrame:
    """Objects become documents with names in camel case."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    for r in t["region"].collect():
        db.collection("regions").insert({"RegionKey": r["r_regionkey"], "Name": r["r_name"]})
    return db.find("regions").select("regionKey", "name")
