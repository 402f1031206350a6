"""The engine from end to end: raw CSV to ranked CSV, all features under truncation and in any order of rows, the audit, the cache."""

import math

import pytest
from pyspark.sql import functions as F

from chronofeat.config import EngineConfig
from chronofeat.operators import audit
from chronofeat.operators.folds import FOLDS_A
from chronofeat.plans import graph, matrix, model
from chronofeat.sources.fixtures import stream
from chronofeat.sources.stream import RAW, StreamError, cached, read_json, read_results, submission, validate, write_csv

END = "2024-01-20 23:59:59"


def same(x, y):
    return x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9))


@pytest.fixture(scope="module")
def few(spark, sf):
    return stream(spark, sf).where("txn_id % 3 > 0").persist()


@pytest.fixture(scope="module")
def whole(few):
    return {r.txn_id: r for r in matrix.build_matrix(few, END, use_embeddings=False).collect()}


def test_matrix_has_all_features_but_embeddings(few, whole):
    names = set(next(iter(whole.values())).asDict())
    assert set(matrix.FEATURES) - names == {*graph.SPECTRAL, *graph.GNN} and len(matrix.FEATURES) == 200
    assert len(whole) == few.count()


def test_order_of_rows_changes_nothing(few, whole):
    shuffled = few.orderBy(F.xxhash64("txn_id")).repartition(7)
    for r in matrix.build_matrix(shuffled, END, use_embeddings=False).collect():
        for f in matrix.FEATURES:
            if f in whole[r.txn_id]:
                assert same(r[f], whole[r.txn_id][f]), (f, r[f], whole[r.txn_id][f])


def test_audit_raises_on_what_is_wrong(few):
    df = few.withColumns({"n": F.lit(1.0), "gap": F.when(F.col("txn_id") % 7 > 0, F.col("amount")), "leak": F.coalesce("label", F.lit(0.0)), "dark": F.when(F.col("ts") < "2024-01-24", 1.0)})
    ends = ("2024-01-20 23:59:59", "2024-01-21 00:00:00")
    assert audit.run_all(df, ["n", "gap"], *ends)["boundary"].count() >= 1
    for names, options in ((["amount_fraud"], {}), (["leak"], {}), (["dark"], {}), (["n"], {"history": {"cust": ["n"]}})):
        with pytest.raises(audit.LeakageError):
            audit.run_all(df.withColumn("amount_fraud", F.lit(1.0)), names, *ends, **options)
    late = lambda x: x.crossJoin(x.agg(F.count(F.lit(1)).alias("top")))
    with pytest.raises(audit.LeakageError):
        audit.run_all(late(df), ["top"], *ends, build=late, stream=df, cutoff="2024-01-10 00:00:00")


def test_stream_rules_raise(few):
    validate(few)
    for wrong in (few.union(few), few.withColumn("amount", -F.col("amount")), few.withColumn("label", F.lit(1.0)), few.withColumn("is_test", ~F.col("is_test"))):
        with pytest.raises(StreamError):
            validate(wrong)
    with pytest.raises(StreamError):
        validate(few, rows=1)
    with pytest.raises(StreamError):
        submission(few.select("txn_id"), few.limit(1).withColumn("score", F.lit(0.5)))


def test_cache_is_read_again_until_rows_or_columns_change(few, tmp_path):
    built = []
    build = lambda df: (built.append(1), df.withColumn("x", F.col("amount") * 2))[1]
    df = few.select("txn_id", "amount")
    for _ in range(2):
        assert cached(df, build, str(tmp_path)).count() == df.count()
    assert len(built) == 1
    for other, version in ((df.withColumn("amount", F.col("amount") + (F.col("txn_id") == 1).cast("int")), "1"), (df.withColumn("z", F.lit(1)), "1"), (df, "2")):
        cached(other, build, str(tmp_path), version).count()
    assert len(built) == 4


def test_csv_to_ranked_csv(spark, few, tmp_path):
    names = {n: k for k, (n, _) in RAW.items()}
    text = few.select(*(F.col(n).cast("string").alias(names[n]) for n in names), F.col("label").alias("fraud"), "is_test")
    text = text.withColumn("location", F.when(F.col("location") != "__NA__", F.col("location")))
    write_csv(text.where("not is_test").drop("is_test"), f"{tmp_path}/train.csv")
    write_csv(text.where("is_test").drop("is_test", "fraud"), f"{tmp_path}/test.csv")
    out = matrix.from_csv(spark, f"{tmp_path}/train.csv", f"{tmp_path}/test.csv", END, f"{tmp_path}/features", EngineConfig(embed_dim=4, use_signup_inconsistency=True))
    assert "signup_inconsistency_d" in out.columns and set(matrix.FEATURES) <= set(out.columns)
    for part, where in (("train", "not is_test"), ("test", "is_test")):
        table = spark.read.parquet(f"{tmp_path}/features/{part}.parquet")
        assert table.count() == few.where(where).count() and dict(table.dtypes)["amt_z"] == "float"
    rows = read_json(f"{tmp_path}/features/feature_manifest.json")
    assert [x["name"] for x in rows] == matrix.FEATURES and {x["block"] for x in rows} == set(matrix.BLOCKS)
    features = ["amt_z", "cust_n_24h", "hour"]
    valid, results = model.search(out, features, FOLDS_A[0], {"base": (2, 3, 0.1, None)})
    scores = model.final(out, features, {"base": 1.0}, {"base": results[0]["rounds"]}, END, (42,), {"base": (2, 3, 0.1, None)})
    write_csv(few.where("is_test").select("txn_id"), f"{tmp_path}/ids.csv")
    write_csv(spark.createDataFrame(results), f"{tmp_path}/search.csv")
    kept = read_results(spark, f"{tmp_path}/search.csv", "name string, rounds int, val_ap double").first()
    assert (kept.name, kept.rounds) == ("base", results[0]["rounds"]) and abs(kept.val_ap - results[0]["val_ap"]) < 1e-12
    ranked = submission(read_results(spark, f"{tmp_path}/ids.csv"), scores)
    write_csv(ranked, f"{tmp_path}/ranked.csv")
    again = read_results(spark, f"{tmp_path}/ranked.csv", "txn_id string, score double")
    assert again.count() == few.where("is_test").count() and again.where("score between 0 and 1").count() == again.count()
