import duckdb
import pytest

import __spark_entry__
from thalweg.plans import catalogue
from thalweg.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in (r[c] for c in cols)) for r in df.to_dict("records"))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_catalogue_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = got.toPandas(), want.df()
    for k in a.columns:
        if a[k].dtype != b[k].dtype and a[k].dtype.kind in "if" and b[k].dtype.kind in "if":
            a[k], b[k] = a[k].astype(float), b[k].astype(float)
        elif a[k].dtype.kind == "M":
            a[k], b[k] = a[k].astype(str), b[k].astype(str)
    assert rows(a) == rows(b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, tmp_path):
    e = catalogue.events(spark, SF, "click").select("track_id", "event_id", "t")
    e.write.parquet(f"{tmp_path}/in")
    track = catalogue.events(spark, SF, "view").select("track_id", "t", "lat", "lon", "depth")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    live.tag_arrivals(stream, lambda: track, f"{tmp_path}/out", f"{tmp_path}/ck", 3600).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {r.status: r.n for r in catalogue.status_counts(spark, SF).collect()}
