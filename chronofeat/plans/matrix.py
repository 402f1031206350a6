"""The whole feature matrix: all blocks over one stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.config import EngineConfig
from chronofeat.functions.scalar import safe_div
from chronofeat.operators.metrics import single_feature_ap
from chronofeat.plans import amount, encoding, entity, graph, temporal, velocity
from chronofeat.sources.stream import cached, clean, read_csv, union_stream, validate, write_features, write_json

BLOCKS = {"temporal": temporal, "amount": amount, "velocity": velocity, "entity": entity, "encoding": encoding, "graph": graph}
FEATURES = [n for b in BLOCKS.values() for n in b.NAMES]


def label_free_parts(df: DataFrame, tasks: int | None = None) -> Iterator[DataFrame]:
    """The four blocks that read no label and no snapshot, as narrow tables (txn_id, ts, features) of one key each.

    A table reads the source columns it needs, so that no window sorts or copies rows that are wide with others' features.
    tasks: how many tasks the rows of customers and of devices are dealt to; adaptive execution sees how little is read,
    not how wide its windows make it.
    """

    def of(key: str, *columns: str) -> DataFrame:
        x = df.select("txn_id", "ts", "ts_epoch", key, *columns)
        return x.repartition(tasks, key) if tasks else x

    yield amount.roundness(amount.contexts(amount.ratios(of("cust", "mcat", "ttype", "pay", "amount"))))
    yield velocity.pair(velocity.by_entity(of("cust", "dev", "amount", "account_age_days"), "cust"))
    yield entity.movement(entity.diversity(entity.novelty(of("cust", *entity.ENTITIES.values()))))
    yield temporal.calendar(temporal.circular(entity.age_of(of("cust", "account_age_days"), "cust", df)))
    device, typical = of("dev", "cust", "loc", "amount"), velocity.typical_gap(df, "dev")
    dev = entity.age_of(entity.sharing_of_devices(velocity.by_entity(device, "dev", median=False)), "dev", df)
    yield dev.join(typical, "txn_id").withColumn("dev_dt_vs_typical", safe_div(F.col("dev_dt"), F.col("__typical")))
    merchant = df.select("txn_id", "ts", "ts_epoch", "cust", "dev", "merch")
    yield entity.age_of(entity.sharing_of_merchants(velocity.by_hub(merchant, "merch"), merchant), "merch", merchant)
    yield velocity.by_hub(df.select("txn_id", "ts", "ts_epoch", "loc"), "loc")
    yield temporal.volume_share(df.select("txn_id", "ts", "ts_epoch"))
    yield amount.trailing_ranks(df.select("txn_id", "ts", "ts_epoch", "amount"))


def parts(df: DataFrame, cutoff: str, use_embeddings: bool | None = None, config: EngineConfig = EngineConfig(), tasks: int | None = None) -> Iterator[DataFrame]:
    """All tables that the matrix is joined of, by txn_id; each may be computed alone."""
    yield from label_free_parts(df, tasks)
    labelled = df.select("txn_id", "ts", "ts_epoch", "is_test", "label", "merch", *encoding.COLUMNS.values())
    yield encoding.build(labelled, cutoff, config.te_alpha, config.te_halflife_d)
    if config.use_signup_inconsistency:
        yield temporal.signup_inconsistency(df.select("txn_id", "ts", "ts_epoch", "cust", "account_age_days"))
    linked = df.select("txn_id", "ts", "ts_epoch", "cust", "dev", "merch")
    yield graph.build(linked, config.use_embeddings if use_embeddings is None else use_embeddings, dim=config.embed_dim, seed=config.seed)


def _joined(df: DataFrame, tables: Iterator[DataFrame], wanted: list[str]) -> DataFrame:
    """The stream with the tables' wanted columns, in their order; all joins are by txn_id, so wide rows are shuffled by nothing else."""
    out = df
    for t in tables:
        out = out.join(t.select("txn_id", *(c for c in t.columns if c in wanted and c not in out.columns)), "txn_id")
    return out.select(*df.columns, *(n for n in wanted if n in out.columns and n not in df.columns))


def build_label_free(df: DataFrame) -> DataFrame:
    """The stream with the features of the four blocks that read no label and no snapshot."""
    return _joined(df, label_free_parts(df), [n for b in (temporal, amount, velocity, entity) for n in b.NAMES])


def build_matrix(df: DataFrame, cutoff: str, use_embeddings: bool | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """All 200 features beside the stream's columns (with the config's switch: the inconsistency of signups, too).

    cutoff: the last time whose labels may be read.
    """
    return _joined(df, parts(df, cutoff, use_embeddings, config), [*FEATURES, "signup_inconsistency_d"])


def manifest(df: DataFrame, features: list[str] | None = None) -> list[dict]:
    """name, block and single-feature average precision of each feature."""
    features = features or FEATURES
    ap = {r.feature: max(r.ap_pos or 0.0, r.ap_neg or 0.0) for r in single_feature_ap(df.where("not is_test"), features).collect()}
    block = {n: b for b, m in BLOCKS.items() for n in m.NAMES}
    return [{"name": f, "block": block[f], "single_feature_ap": ap.get(f)} for f in features]


def build_and_write(df: DataFrame, cutoff: str, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Features of labelled and unlabelled rows as two Parquet tables, and the manifest; the matrix, as it is kept."""
    matrix = cached(df, lambda x: build_matrix(x, cutoff, config=config), path, f"{cutoff} {config}")
    features = [f for f in FEATURES if f in matrix.columns]
    narrow = matrix.select("txn_id", "ts", "is_test", "label", *features)
    write_features(narrow.where("not is_test"), f"{path}/train.parquet")
    write_features(narrow.where("is_test"), f"{path}/test.parquet")
    write_json(manifest(matrix, features), f"{path}/feature_manifest.json")
    return matrix


def from_csv(spark: SparkSession, train: str, test: str, cutoff: str, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Two raw CSV files to a checked stream, its matrix, two feature tables and a manifest."""
    df = clean(union_stream(read_csv(spark, train, True), read_csv(spark, test, False)))
    validate(df)
    return build_and_write(df, cutoff, path, config)
