import duckdb
import pandas as pd
import pytest

from paperlake import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("SET TimeZone='UTC'")
    for t in Q.TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(round(float(v), 6)) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, con, name):
    ours, theirs = Q.QUERIES[name](spark, SF).toPandas(), con.sql(Q.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_imports_without_training_data_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(Q.QUERIES) and set(entry.oracle_sql()) == set(Q.SQL)


def test_windowed_stream(spark, tmp_path):
    from paperlake.streaming.changes import windowed_counts

    spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"file://{tmp_path}/in")
    q = windowed_counts(stream, "ts", "1 day", "1 hour", ["event_type"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg({"count": "sum"}).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
