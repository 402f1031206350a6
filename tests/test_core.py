"""Every query against its SQL, and the rules the engine rests on: ties, truncation, order of rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from chronofeat.operators import past, scan
from chronofeat.operators.components import connected_components
from chronofeat.plans import encoding, matrix
from chronofeat.queries import CUTOFF, QUERIES, SQL
from chronofeat.sources.fixtures import stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(frame):
    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, (bool, str)):
            return str(v)
        return f"{float(v):.7g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(one(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    assert canonical(QUERIES[name](spark, sf).toPandas()) == canonical(duck.execute(SQL[name]).df())


TIES = [(1, 0, 5.0), (2, 0, 7.0), (3, 0, 1.0), (4, 10, 2.0), (5, 10, 4.0), (6, 100, 3.0)]


@pytest.fixture(scope="module")
def ties(spark):
    df = spark.createDataFrame([(i, t, "k", v) for i, t, v in TIES], "txn_id long, ts_epoch long, k string, amount double")
    return df.withColumn("ts", F.timestamp_seconds("ts_epoch")).repartition(4)


def test_windows_count_only_earlier_rows_of_a_tied_second(ties):
    out = ties.withColumns({"n": past.count_in_window(("k",), 10), "s": past.sum_in_window(("k",), F.col("amount"), 10)}).orderBy("txn_id").collect()
    for r in out:
        seen = [v for i, t, v in TIES if (t, i) < (r.ts_epoch, r.txn_id) and t >= r.ts_epoch - 10]
        assert (r.n, r.s) == (len(seen), sum(seen))


@pytest.mark.parametrize("bucket", [1, 7, 86_400])
def test_prefix_scan_equals_a_window(ties, bucket):
    out = scan.prefix_scan(ties, ["k"], {"n": F.lit(1), "s": F.col("amount")}, "last", bucket).orderBy("txn_id").collect()
    for k, r in enumerate(out):
        assert (r.n, r.s, r.last) == (k, sum(v for _, _, v in TIES[:k]), TIES[k - 1][1] if k else None)


def test_bucketed_counts_equal_the_window(ties):
    out = scan.bucketed_range_count(ties, ["k"], {"a": 10, "b": 95})
    want = ties.withColumns({"a": past.count_in_window(("k",), 10), "b": past.count_in_window(("k",), 95)})
    assert sorted(map(tuple, out.select("txn_id", "a", "b").collect())) == sorted(map(tuple, want.select("txn_id", "a", "b").collect()))


def test_chained_scans_grow_a_plan_by_addition(spark, sf):
    df = stream(spark, sf)
    text = encoding.build(df, CUTOFF["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") < 60


def test_label_free_matrix_has_each_row_once_and_ignores_the_future(spark, sf):
    df = stream(spark, sf)
    whole = matrix.build_label_free(df)
    cut = matrix.build_label_free(df.where("ts < '2024-01-15'"))
    features = ["cust_prior_n", "cust_n_24h", "amt_z", "dev_prior_ncust", "merch_n_24h", "hour_volume_share", "amt_rank_7d", "cust_stream_age_days"]
    a = {r.txn_id: r for r in whole.select("txn_id", "ts", *features).collect()}
    assert len(a) == df.count()
    for r in cut.select("txn_id", *features).collect():
        for f in features:
            x, y = r[f], a[r.txn_id][f]
            assert x == y or math.isclose(x, y, rel_tol=1e-9), (f, x, y)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    out = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_empty_stream(spark, sf):
    assert matrix.build_label_free(stream(spark, sf).where("txn_id < 0")).count() == 0
