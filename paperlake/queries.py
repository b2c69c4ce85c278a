"""The catalogue of queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fluent import f
from .operators import constraints as K
from .operators import mutations as M
from .operators import sharding as H
from .plans import build
from .plans.parser import parse
from .session import DocumentSession, deleted, inserted, updated
from .sources import documents
from .sources.store import scratch_root
from .sources.tables import read_table
from .streaming import changes as W

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FLAGSHIP = "SELECT l_returnflag, l_linestatus, SUM(l_quantity), AVG(l_extendedprice), COUNT(*) FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus"


class Tables(dict):
    """Tables that are read when a query first names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name == "orders_doc":
            self[name] = orders_doc(self)
        elif name == "events_var":
            self[name] = self["events"].select(F.parse_json(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}"))).alias("_doc"))
        else:
            self[name] = read_table(self.spark, f"{self.sf_dir}/{name}.parquet")
        return self[name]


    def get_frame(self, name: str) -> DataFrame | None:
        name = name.lower()
        return self[name] if name in self or name in (*TABLES, "orders_doc", "events_var") else None


class TableSession(DocumentSession):
    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.frames = Tables(spark, sf_dir)

    def find(self, name: str, version: int | None = None) -> DataFrame | None:
        return self.frames.get_frame(name)


def orders_doc(t: Tables) -> DataFrame:
    """Orders with their lines and customer nested: one shuffle by order key serves both sides."""
    line = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    lines = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(*line))).alias("lines"))
    customer = t["customer"].select(F.col("c_custkey").alias("o_custkey"), F.struct("c_name", "c_nationkey", "c_mktsegment").alias("customer"))
    return t["orders"].join(lines, "o_orderkey", "left").join(customer, "o_custkey", "left")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.select(*[(F.round(F.col(f"`{x.name}`"), digits) if isinstance(x.dataType, T.DoubleType) else F.col(f"`{x.name}`")).alias(x.name) for x in df.schema.fields])


def dialect(name: str, text: str, sql: str, digits: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = TableSession(spark, sf_dir).query(text)
        return df if digits is None else rounded(df, digits)

    QUERIES[name], SQL[name] = run, sql


def native(sql: str | None):
    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql is not None:
            SQL[make.__name__] = sql
        return make

    return add


# scans, projections and filters
dialect("scan_project", "SELECT o_orderkey, o_orderstatus FROM orders", "SELECT o_orderkey, o_orderstatus FROM orders")
dialect("select_all", "SELECT * FROM nation", "SELECT * FROM nation")
dialect("filter_eq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
dialect("filter_ne", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
dialect("filter_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000")
dialect("filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '1-URGENT')", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
dialect("filter_or_and", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 100000 OR o_orderpriority = '1-URGENT')", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 100000 OR o_orderpriority = '1-URGENT')")
dialect("filter_composite", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND NOT l_quantity < 20", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND NOT coalesce(l_quantity < 20, false)")
dialect("filter_not_2vl", "SELECT documents.doc_id, labels.quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE NOT labels.quality = 1", 'SELECT d.doc_id AS "documents.doc_id", l.quality AS "labels.quality" FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.quality = 1, false)')
dialect("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%A_%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A_%'")
dialect("filter_is_null", "SELECT documents.doc_id FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE labels.quality IS NULL", 'SELECT d.doc_id AS "documents.doc_id" FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL')
dialect("filter_is_not_null", "SELECT documents.doc_id, labels.toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE labels.toxic IS NOT NULL", 'SELECT d.doc_id AS "documents.doc_id", l.toxic AS "labels.toxic" FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL')
dialect("filter_mixed_type", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = '5'", "SELECT o_orderkey, o_totalprice FROM orders WHERE lower(CAST(o_orderkey AS VARCHAR)) = '5'")
dialect("filter_equals_null", "SELECT o_orderkey FROM orders WHERE o_orderstatus = NULL", "SELECT o_orderkey FROM orders WHERE false")
dialect("filter_missing_path", "SELECT o_orderkey FROM orders WHERE NOT nothing.here = 1", "SELECT o_orderkey FROM orders")
dialect("filter_timestamp", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01T00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'")
dialect("filter_fn_lhs", "SELECT c_custkey FROM customer WHERE LOWER(c_mktsegment) = 'building'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
dialect("filter_fn_rhs", "SELECT c_custkey FROM customer WHERE c_mktsegment = UPPER(c_mktsegment)", "SELECT c_custkey FROM customer WHERE c_mktsegment = upper(c_mktsegment)")
dialect("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand NOT IN ('Brand#11')", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT coalesce(p_brand IN ('Brand#11'), false)")
dialect("filter_path_path", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey")
dialect("point_lookup", "SELECT * FROM customer WHERE c_custkey = 7", "SELECT * FROM customer WHERE c_custkey = 7")

# functions
dialect("fn_upper", "SELECT n_nationkey, UPPER(n_name) AS v FROM nation", "SELECT n_nationkey, upper(n_name) AS v FROM nation")
dialect("fn_lower", "SELECT n_nationkey, LOWER(n_name) AS v FROM nation", "SELECT n_nationkey, lower(n_name) AS v FROM nation")
dialect("fn_length", "SELECT p_partkey, LENGTH(p_name) AS v FROM part WHERE LEN(p_name) > 10", "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS v FROM part WHERE length(p_name) > 10")
dialect("fn_trim", "SELECT p_partkey, TRIM(p_name) AS v FROM part", "SELECT p_partkey, trim(p_name, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS v FROM part")
dialect("fn_coalesce", "SELECT documents.doc_id, COALESCE(labels.quality, -1) AS v FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id", 'SELECT d.doc_id AS "documents.doc_id", CAST(coalesce(l.quality, -1) AS BIGINT) AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id')
dialect("fn_nested", "SELECT c_custkey FROM customer WHERE LENGTH(TRIM(LOWER(c_name))) >= 12", "SELECT c_custkey FROM customer WHERE length(trim(lower(c_name))) >= 12")

# joins
dialect("join_inner", "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey", 'SELECT o_orderkey AS "orders.o_orderkey", c_name AS "customer.c_name" FROM orders JOIN customer ON o_custkey = c_custkey')
dialect("join_left", "SELECT orders.o_orderkey, lineitem.l_linenumber FROM orders LEFT OUTER JOIN lineitem ON orders.o_orderkey = lineitem.l_orderkey", 'SELECT o_orderkey AS "orders.o_orderkey", l_linenumber AS "lineitem.l_linenumber" FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey')
dialect("join_right", "SELECT lineitem.l_quantity, orders.o_orderkey FROM lineitem RIGHT JOIN orders ON lineitem.l_orderkey = orders.o_orderkey", 'SELECT l_quantity AS "lineitem.l_quantity", o_orderkey AS "orders.o_orderkey" FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey')
dialect("join_cross", "SELECT region.r_name, nation.n_name FROM region CROSS JOIN nation", 'SELECT r_name AS "region.r_name", n_name AS "nation.n_name" FROM region CROSS JOIN nation')
dialect("join_compound", "SELECT customer.c_custkey, supplier.s_suppkey FROM customer JOIN supplier ON customer.c_nationkey = supplier.s_nationkey AND customer.c_custkey = supplier.s_suppkey", 'SELECT c_custkey AS "customer.c_custkey", s_suppkey AS "supplier.s_suppkey" FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey')
dialect("join_chain", "SELECT customer.c_name, nation.n_name, region.r_name FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey JOIN region ON nation.n_regionkey = region.r_regionkey", 'SELECT c_name AS "customer.c_name", n_name AS "nation.n_name", r_name AS "region.r_name" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey')
dialect("join_array_fanout", "SELECT part.p_partkey, orders_doc.o_orderkey FROM part JOIN orders_doc ON part.p_partkey = orders_doc.lines[*].l_partkey", 'SELECT DISTINCT p_partkey AS "part.p_partkey", l_orderkey AS "orders_doc.o_orderkey" FROM part JOIN lineitem ON p_partkey = l_partkey')
dialect("join_where_pushed", "SELECT orders.o_orderkey, customer.c_mktsegment FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE orders.o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'", 'SELECT o_orderkey AS "orders.o_orderkey", c_mktsegment AS "customer.c_mktsegment" FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = \'F\' AND c_mktsegment = \'BUILDING\'')
dialect("join_group", "SELECT nation.n_name, COUNT(*), SUM(customer.c_acctbal) FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey GROUP BY nation.n_name", 'SELECT n_name AS "nation.n_name", count(*) AS "COUNT(*)", round(sum(c_acctbal), 2) AS "SUM(customer.c_acctbal)" FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name', 2)
dialect("join_missing_left", "SELECT region.r_regionkey, nowhere.x FROM region LEFT JOIN nowhere ON region.r_regionkey = nowhere.x", 'SELECT r_regionkey AS "region.r_regionkey", CAST(NULL AS VARCHAR) AS "nowhere.x" FROM region')
dialect("join_missing_inner", "SELECT region.r_regionkey FROM region JOIN nowhere ON region.r_regionkey = nowhere.x", 'SELECT r_regionkey AS "region.r_regionkey" FROM region WHERE false')

# aggregates
dialect("count_star", "SELECT COUNT(*) FROM lineitem", "SELECT count(*) AS count FROM lineitem")
dialect("count_where", "SELECT COUNT(*) FROM lineitem WHERE l_quantity > 25", "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25")
dialect("count_missing_collection", "SELECT COUNT(*) FROM nowhere", "SELECT CAST(0 AS BIGINT) AS count")
dialect("agg_global", "SELECT SUM(o_totalprice), AVG(o_totalprice), MIN(o_totalprice), MAX(o_totalprice), COUNT(*) FROM orders", 'SELECT round(sum(o_totalprice), 2) AS "SUM(o_totalprice)", round(avg(o_totalprice), 2) AS "AVG(o_totalprice)", min(o_totalprice) AS "MIN(o_totalprice)", max(o_totalprice) AS "MAX(o_totalprice)", count(*) AS "COUNT(*)" FROM orders', 2)
dialect("agg_count_path", "SELECT COUNT(labels.quality), COUNT(documents.doc_id) FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id", 'SELECT count(l.quality) AS "COUNT(labels.quality)", count(d.doc_id) AS "COUNT(documents.doc_id)" FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id')
dialect("agg_group_one", "SELECT o_orderstatus, COUNT(*), AVG(o_totalprice) FROM orders GROUP BY o_orderstatus", 'SELECT o_orderstatus, count(*) AS "COUNT(*)", round(avg(o_totalprice), 2) AS "AVG(o_totalprice)" FROM orders GROUP BY ALL', 2)
dialect("agg_group_two", FLAGSHIP, 'SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS "SUM(l_quantity)", round(avg(l_extendedprice), 2) AS "AVG(l_extendedprice)", count(*) AS "COUNT(*)" FROM lineitem WHERE l_quantity > 10 GROUP BY ALL', 2)
dialect("agg_group_noaggs", "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
dialect("agg_minmax_nonnumeric", "SELECT MIN(o_orderstatus), MAX(o_orderkey) FROM orders", 'SELECT CAST(NULL AS DOUBLE) AS "MIN(o_orderstatus)", CAST(max(o_orderkey) AS DOUBLE) AS "MAX(o_orderkey)" FROM orders')
dialect("agg_having", "SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey HAVING SUM(c_acctbal) > 1000 AND COUNT(*) > 3", 'SELECT c_nationkey, count(*) AS "COUNT(*)" FROM customer GROUP BY c_nationkey HAVING sum(c_acctbal) > 1000 AND count(*) > 3')
dialect("agg_count_distinct", "SELECT COUNT(DISTINCT l_partkey), COUNT(*) FROM lineitem", 'SELECT count(DISTINCT l_partkey) AS "COUNT(DISTINCT l_partkey)", count(*) AS "COUNT(*)" FROM lineitem')
dialect("distinct_one", "SELECT DISTINCT c_mktsegment FROM customer", "SELECT DISTINCT c_mktsegment FROM customer")
dialect("distinct_multi", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
dialect("distinct_nested", "SELECT DISTINCT customer.c_mktsegment FROM orders_doc", 'SELECT DISTINCT c_mktsegment AS "customer.c_mktsegment" FROM orders LEFT JOIN customer ON o_custkey = c_custkey')
dialect("distinct_limit", "SELECT DISTINCT n_regionkey FROM nation ORDER BY n_regionkey LIMIT 3", "SELECT DISTINCT n_regionkey FROM nation ORDER BY n_regionkey LIMIT 3")

# order and paging
dialect("order_asc_limit", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 20", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 20")
dialect("order_desc_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20")
dialect("order_unprojected", "SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 5", "SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 5")
dialect("order_multi", "SELECT n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC LIMIT 7", "SELECT n_name FROM nation ORDER BY n_regionkey DESC NULLS LAST, n_name ASC NULLS FIRST LIMIT 7")
dialect("order_aggregate", "SELECT l_suppkey, COUNT(*) FROM lineitem GROUP BY l_suppkey ORDER BY COUNT(*) DESC, l_suppkey LIMIT 10", 'SELECT l_suppkey, count(*) AS "COUNT(*)" FROM lineitem GROUP BY l_suppkey ORDER BY 2 DESC, 1 LIMIT 10')
dialect("order_nulls", "SELECT documents.doc_id, labels.quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id ORDER BY labels.quality, documents.doc_id LIMIT 15", 'SELECT d.doc_id AS "documents.doc_id", l.quality AS "labels.quality" FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id LIMIT 15')
dialect("offset", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 30", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 30")
dialect("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5")

# nested paths
_FIRST = "(SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS n FROM lineitem)"
dialect("path_nested", "SELECT o_orderkey, customer.c_name FROM orders_doc WHERE customer.c_mktsegment = 'BUILDING'", 'SELECT o_orderkey, c_name AS "customer.c_name" FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = \'BUILDING\'')
dialect("path_index", "SELECT o_orderkey, lines[1].l_partkey FROM orders_doc", f'SELECT o_orderkey, l_partkey AS "lines[1].l_partkey" FROM orders LEFT JOIN {_FIRST} ON o_orderkey = l_orderkey AND n = 2')
dialect("path_oob", "SELECT o_orderkey, lines[999].l_partkey FROM orders_doc", 'SELECT o_orderkey, CAST(NULL AS BIGINT) AS "lines[999].l_partkey" FROM orders')
dialect("path_wildcard_first", "SELECT o_orderkey FROM orders_doc WHERE lines[*].l_quantity > 40", f"SELECT o_orderkey FROM orders JOIN {_FIRST} ON o_orderkey = l_orderkey AND n = 1 WHERE l_quantity > 40")
dialect("path_group", "SELECT customer.c_mktsegment, SUM(lines[0].l_quantity) FROM orders_doc GROUP BY customer.c_mktsegment", f'SELECT c_mktsegment AS "customer.c_mktsegment", round(sum(l_quantity), 2) AS "SUM(lines[0].l_quantity)" FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN {_FIRST} ON o_orderkey = l_orderkey AND n = 1 GROUP BY 1', 2)
dialect("json_path", "SELECT COUNT(*) FROM events_var WHERE props.k > 50 AND type = 'click'", "SELECT count(*) AS count FROM events WHERE CAST(props->>'k' AS BIGINT) > 50 AND event_type = 'click'")
dialect("json_group", "SELECT type, AVG(props.k), MAX(props.k) FROM events_var GROUP BY type", "SELECT event_type AS type, round(avg(CAST(props->>'k' AS BIGINT)), 4) AS \"AVG(props.k)\", CAST(max(CAST(props->>'k' AS BIGINT)) AS DOUBLE) AS \"MAX(props.k)\" FROM events GROUP BY event_type", 4)


@native("SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 49")
def path_wildcard_any(t: Tables) -> DataFrame:
    """As an index on an array finds documents: any element."""
    df = t["orders_doc"]
    ref = build.scope_of(df).ref("lines[*].l_quantity", every=True)
    return df.filter(F.exists(ref.column, lambda x: x > 49)).select("o_orderkey")


@native("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND NOT coalesce(o_totalprice < 1000, false) ORDER BY o_orderkey DESC LIMIT 25")
def fluent_where_order_take(t: Tables) -> DataFrame:
    s = DocumentSession(t.spark).register("orders", t["orders"])
    return s.collection("orders").where(f.o_orderstatus == "F").where(~(f.o_totalprice < 1000)).order_by_descending(f.o_orderkey).take(25).to_df().select("o_orderkey", "o_totalprice")


@native("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'O' OR o_totalprice >= 200000")
def fluent_count(t: Tables) -> DataFrame:
    s = DocumentSession(t.spark).register("orders", t["orders"])
    return s.collection("orders").where((f.o_orderstatus == "O") | (f.o_totalprice >= 200000)).count_df()


@native("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def flatten_grid(t: Tables) -> DataFrame:
    return documents.flatten(t["nation"])


@native("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def json_sink(t: Tables) -> DataFrame:
    return documents.to_json(t["region"])


@native("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_source(t: Tables) -> DataFrame:
    read = t["events"].select("event_id", F.from_json("props", "k long").alias("d"))
    return read.select("event_id", "d.k")


# changes: the collection afterwards
@native("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_nationkey = 3 THEN upper(c_name) ELSE c_name END AS c_name FROM customer")
def update_set(t: Tables) -> DataFrame:
    return updated(t["customer"], parse("UPDATE customer SET c_mktsegment = 'MOVED', c_name = UPPER(c_name) WHERE c_nationkey = 3")).select("c_custkey", "c_mktsegment", "c_name")


@native("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE c_mktsegment END AS seg FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def update_nested(t: Tables) -> DataFrame:
    return updated(t["orders_doc"], parse("UPDATE orders_doc SET customer.c_mktsegment = 'X' WHERE o_orderstatus = 'F'")).select("o_orderkey", F.col("customer.c_mktsegment").alias("seg"))


@native("SELECT * FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def delete_where(t: Tables) -> DataFrame:
    return deleted(t["customer"], parse("DELETE FROM customer WHERE c_acctbal < 0"))


@native("SELECT * FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def insert_tuple(t: Tables) -> DataFrame:
    new = inserted(t.spark, parse("INSERT INTO region (r_regionkey, r_name) VALUES (99, UPPER('Atlantis'))"))
    return t["region"].unionByName(M.aligned(new, t["region"].schema))


@native("SELECT * FROM region UNION ALL SELECT 98, 'It''s'")
def insert_json(t: Tables) -> DataFrame:
    new = inserted(t.spark, parse("""INSERT INTO region {"r_regionkey": 98, "r_name": "It's"}"""))
    return t["region"].unionByName(M.aligned(new, t["region"].schema))


@native("SELECT p_partkey, CASE WHEN p_size >= 5 THEN p_size - 5 ELSE p_size END AS p_size FROM part")
def cas_decrement(t: Tables) -> DataFrame:
    df = t["part"]
    return M.mutate(df, [("p_size", "Dec", 5)], M.holds(df, [("p_size", "Gte", 5), ("p_partkey", "Exists")])).select("p_partkey", "p_size")


@native("SELECT s_suppkey, CASE WHEN s_nationkey = 1 THEN NULL ELSE s_acctbal END AS s_acctbal, CASE WHEN s_nationkey = 1 THEN 'gone' ELSE s_name END AS s_name FROM supplier")
def patch_merge(t: Tables) -> DataFrame:
    df = t["supplier"]
    return M.merge_patch(df, {"s_acctbal": None, "s_name": "gone"}, M.holds(df, [("s_nationkey", "Eq", 1)])).select("s_suppkey", "s_acctbal", "s_name")


# constraints: what breaks them
@native("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(t: Tables) -> DataFrame:
    return K.duplicates(t["lineitem"], ["l_orderkey", "l_linenumber"])


def _labelled(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", "lang").join(t["labels"], "doc_id", "left")


@native("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def required_violations(t: Tables) -> DataFrame:
    return K.violations(_labelled(t), K.Rules(required=["quality"])).where(F.size(K.BROKEN) > 0).select("doc_id")


@native("SELECT doc_id, 'lang must be Int' AS broken FROM documents WHERE lang IS NOT NULL")
def type_violations(t: Tables) -> DataFrame:
    return K.violations(_labelled(t), K.Rules(types={"lang": "Int", "doc_id": "Number"})).select("doc_id", F.explode(K.BROKEN).alias("broken"))


@native("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality < 1")
def check_violations(t: Tables) -> DataFrame:
    return K.violations(_labelled(t), K.Rules(checks=[("quality", "Gte", 1)])).where(F.size(K.BROKEN) > 0).select("doc_id")


@native("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def ref_violations(t: Tables) -> DataFrame:
    return K.dangling(t["orders"], "o_orderkey", t["lineitem"], "l_orderkey").select("o_orderkey")


@native("SELECT 'nation' AS collection, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'region', '1'")
def ref_cascade_set(t: Tables) -> DataFrame:
    """What deleting region 1 takes with it."""
    ids = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey"}
    frames = {n: t[n].withColumn("_id", F.col(k).cast("string")) for n, k in ids.items()}
    rules = {"nation": K.Rules(refs=[K.Reference("n_regionkey", "region", on_delete="cascade")]), "customer": K.Rules(refs=[K.Reference("c_nationkey", "nation", on_delete="cascade")])}
    plan = K.plan_delete(frames, rules, "region", frames["region"].where("r_regionkey = 1"), lambda df: df)
    out = None
    for name, df in sorted(plan.gone.items()):
        part = df.select(F.lit(name).alias("collection"), F.col("_id").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


# time-to-live, change feed, shards
@native("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'")
def ttl_expired(t: Tables) -> DataFrame:
    return t["events"].where(W.expired(t["events"], "ts", F.lit("2024-01-10 00:00:00").cast("timestamp"))).select("event_id")


@native("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def changes_collapse(t: Tables) -> DataFrame:
    return W.collapse(t["events"].select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@native("SELECT o_orderstatus, round(avg(o_totalprice), 2) AS avg, round(sum(o_totalprice), 2) AS sum, count(o_totalprice) AS count, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY o_orderstatus")
def shard_partial_agg(t: Tables) -> DataFrame:
    parts = H.partial_aggregate(t["orders"], H.shard_of(t["orders"], "o_custkey", 8), "o_totalprice", ["o_orderstatus"])
    merged = rounded(H.merge_partials(parts, ["o_orderstatus"]), 2)
    return merged.withColumn("count", F.col("count").cast("long"))


@native("SELECT CAST(o_custkey % 4 AS BIGINT) AS old_shard, CAST(o_custkey % 6 AS BIGINT) AS new_shard, count(*) AS documents FROM orders GROUP BY ALL")
def rebalance_plan(t: Tables) -> DataFrame:
    key = F.col("o_custkey")
    return H.rebalance_plan(t["orders"], F.pmod(key, F.lit(4).cast("long")), F.pmod(key, F.lit(6).cast("long")))


def rows_in_store(t: Tables, **tables: str) -> DocumentSession:
    """A database of its own that holds tables, each with the text of a column as its documents' ``_id``."""
    db = DocumentSession(t.spark, scratch_root(t.spark))
    for name, key in tables.items():
        db.insert(name, t[name].withColumn("_id", F.col(key).cast("string")), checked=False)
    return db


def plain(db: DocumentSession, name: str) -> DataFrame:
    """A collection's own fields."""
    df = db.find(name)
    return df.drop("_id", "_etag")


from . import stored_queries  # noqa: E402, F401  registers the queries that go through the store
