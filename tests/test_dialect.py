import pytest

from paperlake.plans import ast
from paperlake.plans.parser import ParseError, parse
from paperlake.session import DocumentSession
from paperlake.sources import documents

ORDERS = [
    '{"_id":"1","pnr":"A","status":"CONFIRMED","amount":100,"passenger":{"lastName":"Smith"},"flights":[{"code":"AA","from":"X"},{"code":"BA","from":"Y"}]}',
    '{"_id":"2","pnr":"B","status":"CANCELLED","amount":50,"passenger":{"lastName":"Jones"},"flights":[{"code":"BA","from":"Z"}]}',
    '{"_id":"3","pnr":"C","status":"CONFIRMED","amount":500,"passenger":null,"flights":[]}',
    '{"_id":"4","pnr":"D","status":null,"amount":null,"passenger":{"lastName":"smithson"},"flights":null}',
]


@pytest.fixture(scope="module")
def s(spark):
    out = DocumentSession(spark).register("orders", documents.from_texts(spark, ORDERS))
    out.register("carriers", documents.from_texts(spark, ['{"code":"AA","name":"Alpha"}', '{"code":"BA","name":"Beta"}', '{"code":"CC","name":null}']))
    mixed = ['{"n":1,"v":10}', '{"n":2,"v":"10"}', '{"n":3,"v":true}', '{"n":4,"v":null}', '{"n":5,"v":2}', '{"n":6,"v":"b"}', '{"n":7,"v":[1]}']
    return out.register("mixed", documents.from_texts(spark, mixed))


def ids(s, where):
    return sorted(r["pnr"] for r in s.query(f"SELECT pnr FROM orders WHERE {where}").collect())


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ("status = 'CONFIRMED'", "AC"),
        ("NOT status = 'CONFIRMED'", "BD"),
        ("status != 'CONFIRMED'", "B"),
        ("amount > 60 AND amount <= 500", "AC"),
        ("amount = '100'", "A"),
        ("amount < '60'", "ABC"),  # as text
        ("passenger.lastName LIKE 'SMITH%'", "AD"),
        ("NOT passenger.lastName LIKE 'smith%'", "BC"),
        ("passenger.lastName IS NULL", "C"),
        ("nothing.at.all IS NULL", "ABCD"),
        ("NOT nothing = 1", "ABCD"),
        ("amount = NULL", ""),
        ("flights[0].code = 'BA'", "B"),
        ("flights[*].code = 'BA'", "B"),
        ("flights[1].code = 'BA'", "A"),
        ("flights[-1].code = 'BA'", ""),
        ("flights[0].from = 'X'", "A"),
        ("status IN ('CANCELLED', 'X')", "B"),
        ("NOT status IN ('CANCELLED')", "ACD"),
        ("LOWER(status) = 'confirmed' OR amount BETWEEN 40 AND 60", "ABC"),
        ("LENGTH(passenger.lastName) = 5", "AB"),
        ("COALESCE(status, 'none') = 'none'", "D"),
        ("pnr = UPPER(pnr)", "ABCD"),
        ("LOWER(pnr) IN ('a', 'b')", "AB"),
    ],
)
def test_where(s, where, expected):
    assert ids(s, where) == list(expected)


def test_names_and_implicit_id(s):
    assert s.query("SELECT passenger.lastName FROM orders").columns == ["_id", "passenger.lastName"]
    assert s.query("SELECT COUNT(*) FROM orders").collect()[0]["count"] == 4
    assert s.query("SELECT COUNT(*), SUM(amount), MIN(status) FROM orders").collect()[0].asDict() == {"COUNT(*)": 4, "SUM(amount)": 650.0, "MIN(status)": None}


def test_group_by_path_can_be_sorted(s):
    rows = s.query("SELECT status, COUNT(*), SUM(amount) FROM orders GROUP BY status ORDER BY status DESC").collect()
    assert [tuple(r) for r in rows] == [("CONFIRMED", 2, 600.0), ("CANCELLED", 1, 50.0), (None, 1, None)]
    assert [r[0] for r in s.query("SELECT DISTINCT passenger.lastName FROM orders ORDER BY passenger.lastName").collect()] == [None, "Jones", "Smith", "smithson"]


def test_joins_nest(s):
    rows = s.query("SELECT carriers.name, orders.pnr FROM carriers JOIN orders ON carriers.code = orders.flights[*].code").collect()
    assert sorted(map(tuple, rows)) == [("Alpha", "A"), ("Beta", "A"), ("Beta", "B")]
    left = s.query("SELECT * FROM carriers LEFT JOIN orders ON code = flights[0].code WHERE carriers.code = 'CC'").collect()
    assert left[0]["orders"] is None and left[0]["carriers"]["code"] == "CC"
    assert s.query("SELECT COUNT(*) FROM carriers CROSS JOIN orders").collect()[0][0] == 12


def test_schemaless(s):
    assert s.find("mixed").columns == ["_doc"]
    assert [r["n"] for r in s.query("SELECT n FROM mixed WHERE v = 10").select("n").selectExpr("cast(n as int) n").collect()] == [1, 2]
    order = s.query("SELECT n FROM mixed ORDER BY v").selectExpr("cast(n as int) n").collect()
    assert [r["n"] for r in order] == [4, 3, 5, 1, 2, 6, 7]
    assert s.query("SELECT SUM(v), COUNT(v) FROM mixed").collect()[0].asDict() == {"SUM(v)": 12.0, "COUNT(v)": 6}


@pytest.mark.parametrize("text", ["SELECT a FROM", "SELECT a FROM b c d", "SELECT a FROM b WHERE a = 1 x", "SELECT SUM(*) FROM b", "FOO", "INSERT INTO a (x, y) VALUES (1)", "SELECT 1 FROM a", "SELECT a FROM b LIMIT -1", "DROP INDEX x"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)


def test_quotes_and_numbers():
    q = parse(r"SELECT * FROM a.b WHERE x = 'O''Brien' OR y = 'O\'Brien' OR z = 9007199254740993")
    assert q.collection == "a.b"
    assert q.where.left.left.right == ast.Literal("O'Brien") == q.where.left.right.right
    assert q.where.right.right == ast.Literal(9007199254740993)


def test_results_carry_errors(s):
    r = s.sql("SELECT * FROM nowhere")
    assert not r.success and r.code == "collectionNotFound"
    assert not s.sql("SELECT FOO(a) FROM orders").success
    assert not s.sql("SELECT LOWER(a, b) FROM orders").success
    assert s.query("SELECT COUNT(*) FROM nowhere").collect()[0]["count"] == 0


def test_filters_reach_the_scan(spark):
    from paperlake.queries import TableSession

    s = TableSession(spark, "/root/testdata/sf0.001")
    plan = s.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice < 10").plan
    assert "EqualTo(o_orderstatus,F)" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]
    joined = s.sql("SELECT orders.o_orderkey FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE orders.o_orderstatus = 'F'").plan
    assert "EqualTo(o_orderstatus,F)" in joined
