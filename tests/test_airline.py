"""The dialect and the changes over nested bookings, against plain Python over the same documents."""

from collections import Counter

import airline
import pytest

from paperlake.session import DocumentSession

BOOKINGS, FLIGHTS = [airline.booking(i) for i in range(120)], [airline.flight(i) for i in range(20)]


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    out = DocumentSession(spark, f"file://{tmp_path_factory.mktemp('airline')}/db")
    out.insert("orders", BOOKINGS)
    out.insert("flights", FLIGHTS)
    return out


def values(db, text, *names):
    return sorted((tuple(r[n] for n in names) for r in db.query(text).collect()), key=str)


def test_types_of_nested_fields(db):
    kinds = dict(db.find("orders").dtypes)
    assert kinds["createdAt"].startswith("timestamp") and "dateOfBirth:string" in kinds["passenger"] and "departureTime:timestamp" in kinds["flights"]
    assert dict(db.find("flights").dtypes)["operatingDate"] == "string"


def test_first_element_and_any(db):
    want = sorted((b["pnr"],) for b in BOOKINGS if b["flights"][0]["departureAirport"] == "OSL")
    assert values(db, "SELECT pnr FROM orders WHERE flights[0].departureAirport = 'OSL'", "pnr") == want
    assert values(db, "SELECT pnr FROM orders WHERE flights[*].departureAirport = 'OSL'", "pnr") == want
    second = sorted((b["pnr"],) for b in BOOKINGS if len(b["flights"]) > 1)
    assert values(db, "SELECT pnr FROM orders WHERE flights[1].segmentId IS NOT NULL", "pnr") == second


def test_groups_over_paths(db):
    sums, counts = Counter(), Counter()
    for b in BOOKINGS:
        counts[b["passenger"]["lastName"]] += 1
        sums[b["passenger"]["lastName"]] += b["payment"]["amount"] if b["payment"] else 0
    got = db.query("SELECT passenger.lastName, COUNT(*), SUM(payment.amount) FROM orders GROUP BY passenger.lastName").collect()
    assert {r[0]: r[1] for r in got} == counts and all(r[2] == pytest.approx(sums[r[0]]) for r in got)


def test_missing_objects_are_null(db):
    assert db.query("SELECT COUNT(*) FROM orders WHERE payment IS NULL").first()[0] == sum(b["payment"] is None for b in BOOKINGS)
    assert db.query("SELECT COUNT(*) FROM orders WHERE NOT payment.method = 'CARD'").first()[0] == sum((b["payment"] or {}).get("method") != "CARD" for b in BOOKINGS)
    assert db.query("SELECT COUNT(*) FROM orders WHERE remarks[0].code = 'WCHR'").first()[0] == sum(bool(b["remarks"]) and b["remarks"][0]["code"] == "WCHR" for b in BOOKINGS)


@pytest.mark.parametrize("kind", ["", "LEFT ", "RIGHT "])
def test_join_by_elements(db, kind):
    pairs = [(f["flightNumber"], b["pnr"]) for f in FLIGHTS for b in BOOKINGS if f["flightNumber"] in {x["flightNumber"] for x in b["flights"]}]
    if kind == "LEFT ":
        pairs += [(f["flightNumber"], None) for f in FLIGHTS if f["flightNumber"] not in {p[0] for p in pairs}]
    if kind == "RIGHT ":
        pairs += [(None, b["pnr"]) for b in BOOKINGS if b["pnr"] not in {p[1] for p in pairs}]
    got = values(db, f"SELECT f.flightNumber, o.pnr FROM flights f {kind}JOIN orders o ON f.flightNumber = o.flights[*].flightNumber", "f.flightNumber", "o.pnr")
    assert got == sorted(pairs, key=str)


def test_seats_are_sold_once(spark, tmp_path):
    db = DocumentSession(spark, f"file://{tmp_path}/db")
    db.insert("flights", FLIGHTS[:3])
    left = FLIGHTS[0]["capacity"]["BUSINESS"]["available"]
    sell = lambda n: db.update_if("flights", [("_id", "Eq", "f0"), ("capacity.BUSINESS.available", "Gte", n)], [("capacity.BUSINESS.available", "Dec", n), ("capacity.BUSINESS.sold", "Inc", n)])
    assert sell(left + 1).affected == 0 and (not left or sell(left).affected == 1)
    seats = db.find_by_id("flights", "f0").first()["capacity"]["BUSINESS"]
    assert seats["available"] == 0 and seats["sold"] == seats["total"] == 30


def test_an_index_on_a_nested_path_cuts_the_files(spark, tmp_path):
    db = DocumentSession(spark, f"file://{tmp_path}/db")
    db.insert("orders", BOOKINGS[:1])
    db.create_index("departure", "orders", ["flights[0].departureAirport"])
    db.create_index("fare", "orders", ["tickets[0].fare.total"])
    assert db.insert("orders", BOOKINGS[1:]).affected == 119
    part = db.store.manifest()["collections"]["orders"]["parts"][-1]
    found = [r[0] for r in spark.read.parquet(part).selectExpr("flights[0].departureAirport").collect()]
    assert found == sorted(found)
    assert db.query("SELECT pnr FROM orders WHERE flights[0].departureAirport = 'OSL'").count() == sum(b["flights"][0]["departureAirport"] == "OSL" for b in BOOKINGS)
