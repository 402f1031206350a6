"""Cases that a review found: results at the edges of arithmetic, and work that grew faster than the tables."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofeat.operators import audit, components, metrics, past
from chronofeat.plans import graph, matrix, velocity
from chronofeat.queries import QUERIES, SQL
from chronofeat.sources.fixtures import stream


def against_sql(spark, folder, name, key="txn_id"):
    """Rows of a query and of its SQL over the tables in a folder, by key."""
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    cur = con.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    want = {r[columns.index(key)]: dict(zip(columns, r)) for r in cur.fetchall()}
    got = {r[key]: r.asDict() for r in QUERIES[name](spark, str(folder)).collect()}
    return got, want


def write_events(folder, rows):
    """rows: event_id, ts, user_id, value, device."""
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, 'view', ?, ?)", [(i, t, u, v, f'{{"k": {k}}}') for i, t, u, v, k in rows])
    con.execute(f"COPY e TO '{folder}/events.parquet' (FORMAT parquet)")


def test_opposite_hours_have_the_direction_of_the_sql(spark, tmp_path):
    start = dt.datetime(2024, 1, 2)
    times = lambda m: [dt.timedelta(minutes=m), dt.timedelta(minutes=m + 720), dt.timedelta(days=2, minutes=(m * 7) % 1440)]
    write_events(tmp_path, [(3 * m + j, start + t, m, 1.0, m % 9) for m in range(720) for j, t in enumerate(times(m))])
    got, want = against_sql(spark, tmp_path, "temporal_circular")
    assert len(got) == 2160 and [i for i in want if got[i] != want[i]] == []


def test_reference_of_few_values_and_many_rows_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RUN", 10, raising=False)
    scores = spark.range(57).select(F.col("id").alias("txn_id"), ((F.col("id") * 31) % 57).alias("score"))
    reference = spark.range(203).select(F.when(F.col("id") < 150, 0.25).otherwise(F.col("id") / 203.0).alias("p"))
    out = metrics.quantile_map(scores, "score", "txn_id", reference, "p", "m")
    rows = sorted(out.collect(), key=lambda r: r.score)
    values = np.sort([0.25 if i < 150 else i / 203 for i in range(203)])
    want = np.interp(np.arange(57) / 56 * 202, np.arange(203), values) + 1e-9 * np.arange(57) / 56
    assert np.allclose([r.m for r in rows], want, atol=1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [__lo" in plan and "SortMergeJoin [__hi" in plan


def test_windows_of_a_key_with_many_rows_take_linear_time(spark, tmp_path):
    start = dt.datetime(2024, 1, 2)
    write_events(tmp_path, [(i, start + dt.timedelta(seconds=13 * (i // 3)), i % 50, (i * 37 % 9973) / 100, i // 3000 % 2) for i in range(6000)])
    got, want = against_sql(spark, tmp_path, "p4_sum_in_window_a")
    assert [i for i in want if got[i] != want[i]] == []
    one = stream(spark, str(tmp_path)).withColumns({"dev": F.lit("D"), "s": past.sum_in_window(("dev",), F.col("amount"), 604_800), "n": past.count_in_window(("dev",), 604_800)})
    frames = one._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding$()" in frames.lower() and "specifiedwindowframe(RangeFrame, -604800" not in frames


def test_window_sums_keep_small_values_beside_large_and_odd_ones(spark):
    values = [1e15, 0.1, 1 / 3, float("nan"), 2.5, float("inf"), 4.75, None, 0.01, -7.0]
    df = spark.createDataFrame([(i, 10 * i, "k", v) for i, v in enumerate(values)], "txn_id long, ts_epoch long, k string, amount double").withColumn("ts", F.timestamp_seconds("ts_epoch"))
    for r in df.withColumn("s", past.sum_in_window(("k",), F.col("amount"), 20)).collect():
        want = sum((v for v in values[max(0, r.txn_id - 2) : r.txn_id] if v is not None), 0.0)
        assert r.s == want or (r.s != r.s and want != want) or abs(r.s - want) <= 1e-12 * abs(want), (r, want)


def test_factors_of_a_long_and_narrow_graph_are_exact(monkeypatch):
    rng = np.random.default_rng(4)
    left, right = np.unique(np.stack([rng.integers(0, 9000, 60_000), rng.integers(0, 40, 60_000)]), axis=1)
    x = np.zeros((9000, 40))
    x[left, right] = 1 / np.sqrt(np.bincount(left, minlength=9000)[left] * np.bincount(right, minlength=40)[right])
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    for a, b in ((left, right), (right, left)):
        p, q = graph.spectral_factors(a, b, a.max() + 1, b.max() + 1, 8, 3)
        p, q = (p, q) if len(p) == 9000 else (q, p)
        assert np.allclose(p @ q.T, (u[:, :8] * s[:8] ** 2) @ vt[:8], atol=1e-12)
        assert np.allclose(q @ q.T, (vt[:8].T * s[:8] ** 2) @ vt[:8], atol=1e-12)
    monkeypatch.setattr(graph, "NARROW", 0, raising=False)
    p, q = graph.spectral_factors(left[:5000], right[:5000], 9000, 40, 8, 3)
    monkeypatch.undo()
    p1, q1 = graph.spectral_factors(left[:5000], right[:5000], 9000, 40, 8, 3)
    assert np.allclose(p @ q.T, p1 @ q1.T, atol=1e-4)


def test_embeddings_do_not_depend_on_the_order_of_edges(spark, sf):
    df = graph.assign_snapshots(stream(spark, sf), least_rows=100)
    one, two = ({(r.snap, r.cust, r.dev, r.merch): r for r in graph.embeddings(x, dim=8).collect()} for x in (df, df.orderBy(F.xxhash64("txn_id")).repartition(5)))
    want = df.where("snap is not null").select("snap", "cust", "dev", "merch").distinct().count()
    assert len(one) == want and one.keys() == two.keys()
    for k, r in one.items():
        assert all(a == b or (a != a and b != b) or abs(a - b) < 1e-7 for a, b in zip(r[4:], two[k][4:])), (r, two[k])


@pytest.mark.parametrize("known", [10, 500_000])
def test_components_of_a_dense_graph_start_from_few_edges(spark, monkeypatch, known):
    monkeypatch.setattr(components, "KNOWN", known, raising=False)
    stored, store = [], components._store
    monkeypatch.setattr(components, "_store", lambda df: (stored.append(x := store(df)), x)[1])
    edges = spark.range(12_000).select(F.concat(F.lit("c"), F.col("id") % 300).alias("a"), F.concat(F.lit("d"), F.col("id") % 2 + 2 * (F.floor(F.col("id") / 300) % 20)).alias("b"))
    edges = edges.union(spark.createDataFrame([("z", "z"), ("x", "y")], "a string, b string"))
    got = {r.node: r.label for r in components.connected_components(edges).collect()}
    up = {}
    pairs = [tuple(r) for r in edges.collect() if r[0] != r[1]]
    for _ in range(50):
        for a, b in pairs:
            up[a] = up[b] = min(up.get(a, a), up.get(b, b))
    assert got == up
    if known > 10:
        assert stored[0].count() < len(set(pairs)) / 2


def test_truncation_of_parts_counts_as_for_one_table(spark, sf):
    df = stream(spark, sf)
    leaky = lambda x: x.crossJoin(x.agg(F.count(F.lit(1)).alias("top"))).select("txn_id", "ts", "top")
    sound = lambda x: x.select("txn_id", "ts", "amount", F.when(F.col("txn_id") % 3 > 0, 1.0).alias("some"))
    cutoff, names = "2024-01-10 00:00:00", ["amount", "top", "some"]
    got = audit.truncation_mismatches_of_parts(lambda x, tasks: iter((leaky(x), sound(x))), df, cutoff, names)
    want = audit.truncation_mismatches(lambda x: leaky(x).join(sound(x).drop("ts"), "txn_id"), df, cutoff, names)
    early = df.where(f"ts <= '{cutoff}'").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("amount", 0), ("some", 0), ("top", early)]
    with pytest.raises(ValueError):
        audit.truncation_mismatches_of_parts(lambda x, tasks: iter((sound(x),)), df, cutoff, names)


def test_parts_of_the_matrix_are_narrow_and_hold_all_features(spark, sf):
    tables = list(matrix.parts(stream(spark, sf), "2024-01-15 00:00:00", use_embeddings=False))
    assert {c for t in tables for c in t.columns} >= {f for f in matrix.FEATURES if f not in {*graph.SPECTRAL, *graph.GNN}}
    assert max(len(t.columns) for t in tables) < 70


def test_counts_of_hubs_have_no_sliding_frame(spark, sf):
    plan = velocity.by_hub(stream(spark, sf), "merch")._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "specifiedwindowframe(RangeFrame, -86400, -1)" not in plan


def test_thinned_edges_link_what_all_edges_do_in_each_week(spark, sf):
    df = graph.assign_snapshots(stream(spark, sf).withColumn("cust", F.col("cust") % 40).withColumn("dev", F.concat(F.lit("D"), F.col("txn_id") % 5)), least_rows=100)
    labels = []
    for edges in (graph.lifetime_edges(df, "cust", "dev"), graph._lifetime_links(df)):
        found = components.connected_components(edges.select(F.format_string("%020dc%s", "snap", F.col("cust").cast("string")).alias("a"), F.format_string("%020dd%s", "snap", "dev").alias("b")))
        labels.append((edges.count(), sorted(map(tuple, found.collect()))))
    assert labels[0][1] == labels[1][1] and labels[1][0] < labels[0][0]


def test_sums_of_several_windows_equal_single_ones(spark, sf):
    df = stream(spark, sf).withColumn("amount", F.when(F.col("txn_id") % 11 > 0, F.col("amount")).otherwise(float("inf")))
    out = past.sums_in_windows(df, ("cust",), F.col("amount"), {"a": 3600, "b": 604_800}).withColumns({n: past.sum_in_window(("cust",), F.col("amount"), w) for n, w in (("x", 3600), ("y", 604_800))})
    assert out.where("not (a <=> x) or not (b <=> y)").count() == 0
