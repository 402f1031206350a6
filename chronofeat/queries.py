"""The engine's queries over the canonical streams, each with DuckDB SQL that computes the same rows.

Doubles are rounded alike on both sides; a nudge far below the last digit comes first, since the engines round exact
halves (means of two or eight amounts) differently.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.config import VELOCITY_WINDOWS, WINDOWS_S
from chronofeat.operators import audit, folds, metrics, past
from chronofeat.plans import amount, encoding, entity, graph, matrix, model, temporal, velocity
from chronofeat.sources.fixtures import DUCK, DUCK_RAW, raw_stream, stream
from chronofeat.sources.stream import add_implied_signup, clean, submission, union_stream, validation_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CUTOFF = {"a": "2024-01-20 23:59:59", "b": "2000-06-30 23:59:59"}


def nudge(digits: int) -> float:
    return 0.31 * 10.0 ** -(digits + 3)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Doubles to so many places, without negative zero; whole numbers as bigint."""
    kinds = dict(df.dtypes)
    one = lambda c: F.round(F.col(c).cast("double") + nudge(digits), digits) + 0.0 if kinds[c] in ("double", "float") else F.col(c).cast("bigint") if kinds[c] in ("int", "bigint", "tinyint", "smallint") else F.col(c)
    return df.select(*(one(c).alias(c) for c in columns))


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE) + {nudge(digits)!r}, {digits}) + 0.0 AS {name}"


def i(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


def add(name: str, which: str, build: Callable[[DataFrame], DataFrame], columns: list[str], sql: str | None = None, key: str = "txn_id", digits: int = 6) -> None:
    """A query over a stream: key and columns of build(stream)."""
    QUERIES[name] = lambda spark, d: rounded(build(stream(spark, d, which)), [key, *columns] if key else columns, digits)
    if sql:
        SQL[name] = f"{DUCK[which]} {sql}"


def win(*keys: str, frame: str = "") -> str:
    return f"(PARTITION BY {', '.join(keys)} ORDER BY ts, txn_id {frame})"


def past_sql(*keys: str) -> str:
    return win(*keys, frame="ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"


EARLIER = "(b.ts < a.ts OR (b.ts = a.ts AND b.txn_id < a.txn_id))"


def reach(keys: list[str], seconds: dict[str, int], sums: bool = False, value: str = "amount") -> str:
    """Counts (and sums) of earlier rows in reach, by self-join."""
    on = " AND ".join(f"b.{k} = a.{k}" for k in keys)
    out = [f"count(b.txn_id) FILTER (b.ts_epoch >= a.ts_epoch - {s}) AS n_{w}" for w, s in seconds.items()]
    out += [f"coalesce(sum(b.{value}) FILTER (b.ts_epoch >= a.ts_epoch - {s}), 0) AS s_{w}" for w, s in seconds.items()] if sums else []
    return f"SELECT a.txn_id, {', '.join(out)} FROM s a LEFT JOIN s b ON {on} AND b.ts_epoch >= a.ts_epoch - {max(seconds.values())} AND {EARLIER} GROUP BY a.txn_id"


# ---- sources -----------------------------------------------------------------------------------------------
for w_ in "ab":
    QUERIES[f"stream_clean_{w_}"] = lambda s, d, w=w_: rounded(clean(raw_stream(s, d, w), indicators=True), ["txn_id", "ts_epoch", "cust", "dev", "merch", "loc", "mcat", "dtype", "pay", "ttype", "amount", "account_age_days", "is_test", "label", "loc_was_missing"])
    SQL[f"stream_clean_{w_}"] = f"SELECT txn_id, CAST(ts_epoch AS BIGINT) AS ts_epoch, cust, coalesce(dev, '__NA__') AS dev, coalesce(merch, '__NA__') AS merch, coalesce(loc, '__NA__') AS loc, mcat, dtype, pay, ttype, {r('amount', 'amount')}, {i('account_age_days', 'account_age_days')}, is_test, {r('label', 'label')}, {i('loc IS NULL', 'loc_was_missing')} FROM ({DUCK_RAW[w_]}) x"
QUERIES["stream_union"] = lambda s, d: rounded(
    union_stream((t := stream(s, d).select("txn_id", "ts", "amount", "label", "is_test")).where("not is_test").drop("is_test"), t.where("is_test").drop("is_test", "label")), ["txn_id", "ts_epoch", "amount", "label", "is_test"]
)
SQL["stream_union"] = f"{DUCK['a']} SELECT txn_id, CAST(ts_epoch AS BIGINT) AS ts_epoch, {r('amount', 'amount')}, {r('label', 'label')}, is_test FROM s"
add("stream_validate", "b", validation_report, ["n_rows", "missing_order", "bad_amounts", "bad_ages", "train_without_label", "test_with_label", "bad_epochs", "train_end", "test_start", "duplicate_ids"],
    f"SELECT count(*) AS n_rows, {i('count(*) FILTER (ts IS NULL OR txn_id IS NULL)', 'missing_order')}, {i('count(*) FILTER (amount IS NULL OR NOT amount > 0)', 'bad_amounts')}, {i('count(*) FILTER (account_age_days < 0)', 'bad_ages')}, {i('count(*) FILTER (NOT is_test AND label IS NULL)', 'train_without_label')}, {i('count(*) FILTER (is_test AND label IS NOT NULL)', 'test_with_label')}, CAST(0 AS BIGINT) AS bad_epochs, {i('max(ts_epoch) FILTER (NOT is_test)', 'train_end')}, {i('min(ts_epoch) FILTER (is_test)', 'test_start')}, {i('count(*) - count(DISTINCT txn_id)', 'duplicate_ids')} FROM s", key="")
add("implied_signup", "a", add_implied_signup, ["implied_signup_day"], f"SELECT txn_id, {i('epoch_us(ts) // 86400000000 - account_age_days', 'implied_signup_day')} FROM s")
QUERIES["submission_join"] = lambda s, d: rounded(submission(stream(s, d).where("is_test").select("txn_id"), stream(s, d).select("txn_id", (F.col("amount") / 7).alias("score"))), ["txn_id", "score"])
SQL["submission_join"] = f"{DUCK['a']} SELECT txn_id, {r('amount / 7', 'score')} FROM s WHERE is_test"

# ---- past-only primitives ----------------------------------------------------------------------------------
P = past_sql("cust")
for w_ in "ab":
    add(f"p2_prior_count_{w_}", w_, lambda df: df.withColumns({"cust_n": past.prior_count("cust"), "dev_n": past.prior_count("dev")}), ["cust_n", "dev_n"],
        f"SELECT txn_id, row_number() OVER {win('cust')} - 1 AS cust_n, row_number() OVER {win('dev')} - 1 AS dev_n FROM s")
    secs = {"1h": 3600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000, "90d": 7_776_000}
    add(f"p3_count_in_window_{w_}", w_, lambda df, s=secs: df.withColumns({f"n_{k}": past.count_in_window(("cust",), v) for k, v in s.items()}), [f"n_{k}" for k in secs], reach(["cust"], secs))
    add(f"p4_sum_in_window_{w_}", w_, lambda df, s=secs: df.withColumns({f"s_{k}": past.sum_in_window(("dev",), F.col("amount"), v) for k, v in s.items()}), [f"s_{k}" for k in secs],
        f"SELECT txn_id, {', '.join(r(f's_{k}', f's_{k}', 3) for k in secs)} FROM ({reach(['dev'], secs, True)}) x", digits=3)
    add(f"p5_prev_gap_{w_}", w_, lambda df: df.withColumns({f"dt{k}": past.prev_gap(("cust",), k) for k in (1, 2, 3)}), ["dt1", "dt2", "dt3"],
        f"SELECT txn_id, {', '.join(r(f'ts_epoch - lag(ts_epoch, {k}) OVER {win('cust')}', f'dt{k}') for k in (1, 2, 3))} FROM s")
    add(f"p6_expanding_{w_}", w_, lambda df: df.withColumns({h: past.expanding(("cust",), F.col("amount"), h) for h in ("mean", "std", "max", "min", "median")}), ["mean", "std", "max", "min", "median"],
        f"SELECT txn_id, {r(f'avg(amount) OVER {P}', 'mean', 4)}, {r(f'stddev_samp(amount) OVER {P}', 'std', 4)}, {r(f'max(amount) OVER {P}', 'max', 4)}, {r(f'min(amount) OVER {P}', 'min', 4)}, {r(f'median(amount) OVER {P}', 'median', 4)} FROM s", digits=4)
    add(f"p7_prev_value_{w_}", w_, lambda df: df.withColumns({f"v{k}": past.prev_value(("cust",), F.col("amount"), k) for k in (1, 4)}), ["v1", "v4"],
        f"SELECT txn_id, {', '.join(r(f'lag(amount, {k}) OVER {win('cust')}', f'v{k}') for k in (1, 4))} FROM s")
    add(f"p8_rolling_mean_{w_}", w_, lambda df: df.withColumns({f"m{k}": past.rolling_mean(("cust",), F.col("amount"), k) for k in (5, 20)}), ["m5", "m20"],
        f"SELECT txn_id, {', '.join(r(f'avg(amount) OVER {win('cust', frame=f'ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING')}', f'm{k}', 4) for k in (5, 20))} FROM s", digits=4)
    add(f"p9_first_occurrence_{w_}", w_, lambda df: df.withColumn("first", past.first_occurrence("cust", "dev")), ["first"], f"SELECT txn_id, {i(f'row_number() OVER {win('cust', 'dev')} = 1', 'first')} FROM s")
    add(f"p10_running_nunique_{w_}", w_, lambda df: past.running_nunique(df, ("dev",), ("cust",), "n"), ["n"], f"SELECT txn_id, count(DISTINCT cust) OVER {past_sql('dev')} AS n FROM s")
    add(f"p11_new_pairs_{w_}", w_, lambda df: past.new_pairs_in_window(df, ("dev",), ("cust",), 604_800, "n"), ["n"],
        f", f AS (SELECT *, (row_number() OVER {win('dev', 'cust')} = 1) AS first FROM s) SELECT a.txn_id, count(b.txn_id) AS n FROM f a LEFT JOIN f b ON b.dev = a.dev AND b.first AND b.ts_epoch >= a.ts_epoch - 604800 AND {EARLIER} GROUP BY a.txn_id")

# ---- temporal ----------------------------------------------------------------------------------------------
H, DOW = "extract(hour FROM ts)", "(extract(isodow FROM ts) - 1)"
TH = f"(({H} + extract(minute FROM ts) / 60.0) * 2 * pi() / 24.0)"
add("temporal_calendar", "a", temporal.calendar, temporal.CALENDAR,
    f"SELECT txn_id, {i(H, 'hour')}, {i(f'{H} * 60 + extract(minute FROM ts)', 'minute_of_day')}, {i(DOW, 'dayofweek')}, {i('extract(day FROM ts)', 'day_of_month')}, {i(f'{DOW} >= 5', 'is_weekend')}, {r(f'sin({TH})', 'hour_sin')}, {r(f'cos({TH})', 'hour_cos')}, {r(f'sin({DOW} * 2 * pi() / 7)', 'dow_sin')}, {r(f'cos({DOW} * 2 * pi() / 7)', 'dow_cos')}, {i(f'{H} < 5', 'is_night')}, {i(f'{H} BETWEEN 1 AND 4', 'is_deep_night')}, {r('ln(1 + account_age_days)', 'account_age_log')}, {r('account_age_days', 'days_since_signup')} FROM s")
add("temporal_circular", "a", temporal.circular, temporal.CIRCULAR,
    f", t AS (SELECT *, {TH} AS th FROM s), m AS (SELECT *, avg(cos(th)) OVER {P} AS c, avg(sin(th)) OVER {P} AS z FROM t), d AS (SELECT *, sqrt(c * c + z * z) AS k, abs(atan2(sin(th - atan2(z, c)), cos(th - atan2(z, c)))) AS o FROM m) SELECT txn_id, {r('k', 'cust_time_concentration', 5)}, {r('o', 'cust_ang_dev', 5)}, {r('o * k', 'cust_ang_dev_weighted', 5)} FROM d", digits=5)
add("hour_volume_share", "a", temporal.volume_share, ["hour_volume_share"],
    f"SELECT txn_id, {r(div(f'row_number() OVER (PARTITION BY {H} ORDER BY ts, txn_id) - 1', 'row_number() OVER (ORDER BY ts, txn_id) - 1'), 'hour_volume_share')} FROM s")
add("signup_inconsistency", "a", temporal.signup_inconsistency, ["signup_inconsistency_d"],
    f", d AS (SELECT *, epoch_us(ts) // 86400000000 - account_age_days AS g FROM s) SELECT txn_id, {r(f'abs(g - median(g) OVER {P})', 'signup_inconsistency_d')} FROM d")

# ---- amount ------------------------------------------------------------------------------------------------
L5, L20 = (f"avg(amount) OVER {win('cust', frame=f'ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING')}" for k in (5, 20))
add("amount_ratios", "b", amount.ratios, ["amount_bdt", "log_amount", *amount.RATIOS],
    f", m AS (SELECT *, avg(amount) OVER {P} AS mean, stddev_samp(amount) OVER {P} AS std, max(amount) OVER {P} AS mx, min(amount) OVER {P} AS mn, median(amount) OVER {P} AS md, lag(amount) OVER {win('cust')} AS l1, {L5} AS l5, {L20} AS l20 FROM s) SELECT txn_id, {r('amount', 'amount_bdt', 4)}, {r('ln(1 + amount)', 'log_amount', 4)}, {r('mean', 'cust_amt_prev_mean', 4)}, {r('std', 'cust_amt_prev_std', 4)}, {r('mx', 'cust_amt_prev_max', 4)}, {r(div('amount', 'mean'), 'amt_ratio_mean', 4)}, {r(div('amount', 'md'), 'amt_ratio_median', 4)}, {r(div('amount', 'mx'), 'amt_ratio_max', 4)}, {r(div('amount', 'mn'), 'amt_ratio_min', 4)}, {r(div('amount - mean', 'std'), 'amt_z', 4)}, {r('ln(1 + amount) - ln(1 + mean)', 'log_amt_ratio_mean', 4)}, {r(div('amount', 'l1'), 'amt_ratio_last1', 4)}, {r(div('amount', 'l5'), 'amt_ratio_last5', 4)}, {r(div('amount', 'l20'), 'amt_ratio_last20', 4)} FROM m", digits=4)
CTX = ", ".join(x for n, c in amount.CONTEXTS.items() for x in (r(div("amount", f"avg(amount) OVER {past_sql('cust', c)}"), f"amt_ratio_mean_by_{n}", 4), r(div(f"amount - avg(amount) OVER {past_sql('cust', c)}", f"stddev_samp(amount) OVER {past_sql('cust', c)}"), f"amt_z_by_{n}", 4), f"row_number() OVER {win('cust', c)} - 1 AS cust_{n}_prior_n"))
add("amount_contexts", "b", amount.contexts, amount.CONTEXT, f"SELECT txn_id, {CTX} FROM s", digits=4)
GRID = "[" + ", ".join(f"{k}/127.0" for k in range(128)) + "]"
rank_sql = ", ".join(f"g{w} AS (SELECT d.day, quantile_cont(p.amount, {GRID}) AS grid FROM days d JOIN x p ON p.day < d.day AND p.ts_epoch >= d.first - {w} * 86400 GROUP BY d.day HAVING count(*) >= 100)" for w in (7, 30))
add("amount_trailing_rank", "a", amount.trailing_ranks, amount.RANKS,
    f", x AS (SELECT *, ts_epoch // 86400 AS day FROM s), days AS (SELECT day, min(ts_epoch) AS first FROM x GROUP BY day), {rank_sql} SELECT txn_id, {', '.join(r(f'len(list_filter(g{w}.grid, lambda g: g <= amount)) / 128.0', f'amt_rank_{w}d') for w in (7, 30))} FROM x LEFT JOIN g7 ON g7.day = x.day LEFT JOIN g30 ON g30.day = x.day")
add("amount_round_flags", "b", amount.roundness, amount.ROUND,
    f", t AS (SELECT *, round_even(amount * 100, 0) / 100 AS two FROM s) SELECT txn_id, {i('two = round_even(two, 0)', 'amt_is_int')}, {i('two % 100 = 0', 'amt_round_100')}, {i('two % 1000 = 0', 'amt_round_1000')} FROM t")

# ---- velocity ----------------------------------------------------------------------------------------------
for k_ in ("cust", "dev"):
    w_s = {w: WINDOWS_S[w] for w in VELOCITY_WINDOWS[k_]}
    out = [f"row_number() OVER {win(k_)} - 1 AS {k_}_prior_n", r("g1", f"{k_}_dt", 4), r("g2", f"{k_}_dt2", 4), r("g3", f"{k_}_dt3", 4), r("ln(1 + g1)", f"{k_}_log_dt", 4), r(div("g1", f"median(coalesce(g1, 0)) OVER {past_sql(k_)}"), f"{k_}_dt_vs_typical", 4)]
    for w in w_s:
        out += [f"n_{w} AS {k_}_n_{w}", r(f"s_{w}", f"{k_}_amt_sum_{w}", 3), r(div(f"s_{w}", f"n_{w}"), f"{k_}_amt_mean_{w}", 3)]
    out += [r(div("n_1h", "n_24h"), f"{k_}_burst_1h_24h", 4)]
    if k_ == "cust":
        out += [r(div("n_24h", "n_168h"), "cust_burst_24h_168h", 4), r(f"(row_number() OVER {win('cust')} - 1) / greatest(account_age_days, 1)", "cust_txn_per_day", 4)]
    order = [o.rsplit(" AS ", 1)[1] for o in out]
    for w_ in "ab":
        add(f"velocity_{k_}_{w_}", w_, lambda df, k=k_: velocity.by_entity(df, k), order,
            f", g AS (SELECT *, ts_epoch - lag(ts_epoch, 1) OVER {win(k_)} AS g1, ts_epoch - lag(ts_epoch, 2) OVER {win(k_)} AS g2, ts_epoch - lag(ts_epoch, 3) OVER {win(k_)} AS g3 FROM s), w AS ({reach([k_], w_s, True)}) SELECT txn_id, {', '.join(o.replace(f'{nudge(4)!r}, 4) + 0.0', f'{nudge(3)!r}, 3) + 0.0') for o in out)} FROM g JOIN w USING (txn_id)", digits=3)
for k_ in ("merch", "loc"):
    w_s = {w: WINDOWS_S[w] for w in VELOCITY_WINDOWS[k_]}
    gap = f"ts_epoch - lag(ts_epoch) OVER {win(k_)}"
    add(f"velocity_{k_}", "a", lambda df, k=k_: velocity.by_hub(df, k), velocity.names(k_),
        f", w AS ({reach([k_], w_s)}) SELECT txn_id, row_number() OVER {win(k_)} - 1 AS {k_}_prior_n, {r(gap, f'{k_}_dt')}, {r(f'ln(1 + ({gap}))', f'{k_}_log_dt')}, {', '.join(f'n_{w} AS {k_}_n_{w}' for w in w_s)} FROM s JOIN w USING (txn_id)")
add("velocity_pair", "b", velocity.pair, velocity.PAIR,
    f", w AS ({reach(['cust', 'dev'], {'24h': 86400})}), c AS ({reach(['cust'], {'24h': 86400})}) SELECT txn_id, row_number() OVER {win('cust', 'dev')} - 1 AS custdev_prior_n, {r(f'ts_epoch - lag(ts_epoch) OVER {win('cust', 'dev')}', 'custdev_dt')}, w.n_24h AS custdev_n_24h, {r(div('w.n_24h', 'c.n_24h'), 'custdev_share_24h')} FROM s JOIN w USING (txn_id) JOIN c USING (txn_id)")

# ---- entity ------------------------------------------------------------------------------------------------
NOV = ", ".join(
    f"{i(f'row_number() OVER {win('cust', c)} = 1 AND row_number() OVER {win('cust')} > 1', f'cust_new_{e}')}, row_number() OVER {win('cust', c)} - 1 AS cust_{e}_prior_n, {r(f'ts_epoch - lag(ts_epoch) OVER {win('cust', c)}', f'cust_{e}_dt')}, {r(div(f'row_number() OVER {win('cust', c)} - 1', f'row_number() OVER {win('cust')} - 1'), f'cust_{e}_share')}"
    for e, c in entity.ENTITIES.items()
)
for w_ in "ab":
    add(f"entity_novelty_{w_}", w_, entity.novelty, entity.NOVELTY, f"SELECT txn_id, {NOV} FROM s")
NEWPAIR = lambda k, e, w: f"(SELECT count(*) FROM f b WHERE b.{k} = a.{k} AND b.first_{k}_{e} AND b.ts_epoch >= a.ts_epoch - {w} AND {EARLIER})"
add("entity_sharing", "b", entity.sharing, entity.SHARING,
    f", f AS (SELECT *, row_number() OVER {win('dev', 'cust')} = 1 AS first_dev_cust FROM s), n AS (SELECT txn_id, count(DISTINCT cust) OVER {past_sql('dev')} AS dc, count(DISTINCT loc) OVER {past_sql('dev')} AS dl, row_number() OVER {win('dev')} - 1 AS dn, count(DISTINCT cust) OVER {past_sql('merch')} AS mc, count(DISTINCT dev) OVER {past_sql('merch')} AS md FROM s) SELECT a.txn_id, n.dc AS dev_prior_ncust, n.dl AS dev_prior_nloc, {NEWPAIR('dev', 'cust', 86400)} AS dev_new_cust_24h, {NEWPAIR('dev', 'cust', 604800)} AS dev_new_cust_168h, {r(div('n.dc', 'n.dn'), 'dev_cust_churn')}, n.mc AS merch_prior_ncust, n.md AS merch_prior_ndev FROM f a JOIN n ON n.txn_id = a.txn_id")
add("entity_diversity", "b", entity.diversity, entity.DIVERSITY,
    f", f AS (SELECT *, row_number() OVER {win('cust', 'dev')} = 1 AS first_cust_dev, row_number() OVER {win('cust', 'loc')} = 1 AS first_cust_loc FROM s), n AS (SELECT txn_id, row_number() OVER {win('cust')} - 1 AS cn, {', '.join(f'count(DISTINCT {e}) OVER {P} AS n{e}' for e in ('dev', 'merch', 'loc', 'mcat'))} FROM s) SELECT a.txn_id, {', '.join(f'n.n{e} AS cust_prior_n{e}' for e in ('dev', 'merch', 'loc', 'mcat'))}, {', '.join(f'{NEWPAIR('cust', e, WINDOWS_S[w])} AS cust_new_{e}_{w}' for w in ('24h', '168h') for e in ('dev', 'loc'))}, {r(div('n.ndev', 'n.cn'), 'cust_dev_per_txn')} FROM f a JOIN n ON n.txn_id = a.txn_id")
add("entity_movement", "b", entity.movement, entity.MOVEMENT,
    f", c AS (SELECT *, coalesce(lag(loc) OVER {win('cust')} <> loc, false) AS ch FROM s) SELECT txn_id, {i('ch', 'loc_changed_vs_prev')}, {r(f'ts_epoch - last_value(CASE WHEN ch THEN ts_epoch END IGNORE NULLS) OVER {win('cust', frame='ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}', 'time_since_loc_change')} FROM c")
AGE_SPAN = "greatest((ts_epoch - min(ts_epoch) OVER ()) / 86400.0, 1e-6)"
AGE = lambda k: f"((ts_epoch - min(ts_epoch) OVER (PARTITION BY {k})) / 86400.0)"
AGE_SQL = ", ".join(f"{r(AGE(k), f'{n}_age_days')}, {r(f'least(greatest({AGE(k)} / {AGE_SPAN}, 0.0), 1.0)', f'{n}_age_frac')}" for k, n in (("dev", "dev"), ("merch", "merch"), ("cust", "cust_stream")))
for w_ in "ab":
    add(f"entity_age_{w_}", w_, entity.age, entity.AGE,
        f"SELECT txn_id, {AGE_SQL}, {', '.join(i(f'row_number() OVER {win(k)} = 1', f'{k}_is_first_seen') for k in ('dev', 'merch'))}, {r(f'(row_number() OVER {win('cust')} - 1) / greatest({AGE('cust')}, 1)', 'cust_txn_per_active_day')} FROM s")

# ---- target encodings --------------------------------------------------------------------------------------
for w_ in "ab":
    cut = CUTOFF[w_]
    base = f", t AS (SELECT *, CASE WHEN NOT is_test AND ts <= TIMESTAMP '{cut}' THEN 1.0 ELSE 0.0 END AS tr, CASE WHEN {H} < 5 THEN 0 WHEN {H} < 12 THEN 1 WHEN {H} < 18 THEN 2 WHEN {H} < 22 THEN 3 ELSE 4 END AS hb FROM s), y AS (SELECT *, CAST(tr * coalesce(label, 0) AS DOUBLE) AS yt, (SELECT avg(label) FROM t WHERE tr = 1) AS prior FROM t)"
    te = lambda keys, name, a=100: r(f"(coalesce(sum(yt) OVER {past_sql(*keys)}, 0) + prior * {a}) / (coalesce(sum(tr) OVER {past_sql(*keys)}, 0) + {a})", name, 9)
    add(f"te_expanding_{w_}", w_, lambda df, c=cut: encoding.build(df, c), [f"te_{c}" for c in encoding.COLUMNS], f"{base} SELECT txn_id, {', '.join(te([c], f'te_{n}') for n, c in encoding.COLUMNS.items())} FROM y", digits=9)
    add(f"te_cross_{w_}", w_, lambda df, c=cut: encoding.build(df, c), encoding.NAMES[-3:], f"{base} SELECT txn_id, {te(['hb', 'dtype'], 'te_hour_bucket_X_device_type')}, {te(['loc', 'ttype'], 'te_location_X_transaction_type')}, {te(['merch'], 'te_merchant_id', 400)} FROM y", digits=9)
    lam = "(ln(2) / (30 * 86400.0))"
    dec = lambda key, name: r(f"(coalesce(sum(yt * exp({lam} * (ts_epoch - t0))) OVER {past_sql(key)}, 0) / exp({lam} * (ts_epoch - t0)) + prior * 100) / (coalesce(sum(tr * exp({lam} * (ts_epoch - t0))) OVER {past_sql(key)}, 0) / exp({lam} * (ts_epoch - t0)) + 100)", name, 8)
    add(f"te_decayed_{w_}", w_, lambda df, c=cut: encoding.build(df, c), [f"te_{c}_decay" for c in encoding.COLUMNS], f"{base}, z AS (SELECT *, min(ts_epoch) OVER () AS t0 FROM y) SELECT txn_id, {', '.join(dec(c, f'te_{n}_decay') for n, c in encoding.COLUMNS.items())} FROM z", digits=8)

# ---- snapshot graphs ---------------------------------------------------------------------------------------
SNAP = ", k AS (SELECT *, ((ts_epoch - 259200) // 604800) * 604800 + 259200 AS wk FROM s), kk AS (SELECT k.*, CASE WHEN wk >= (SELECT min(ts_epoch) // 86400 * 86400 FROM s) AND (SELECT count(*) FROM s b WHERE b.ts_epoch < wk) >= 500 THEN wk END AS snap FROM k), sn AS (SELECT DISTINCT snap FROM kk WHERE snap IS NOT NULL)"
EDGES = ", cd AS (SELECT DISTINCT snap, cust, dev FROM sn JOIN s ON ts_epoch < snap), cm AS (SELECT DISTINCT snap, cust, merch FROM sn JOIN s ON ts_epoch < snap), rd AS (SELECT DISTINCT snap, cust, dev FROM sn JOIN s ON ts_epoch < snap AND ts_epoch >= snap - 604800)"
with_snap = lambda f: lambda df: f(graph.assign_snapshots(df))
zero = lambda x, name: r(f"CASE WHEN kk.snap IS NOT NULL THEN coalesce({x}, 0) END", name)
add("snapshot_assign", "a", lambda df: graph.assign_snapshots(df).withColumn("snap", F.col("snap").cast("double")), ["snap"], f"{SNAP} SELECT txn_id, {r('snap', 'snap')} FROM kk")
add("graph_degree", "a", with_snap(graph.degrees), graph.DEGREES,
    f"{SNAP}{EDGES}, c1 AS (SELECT snap, cust, count(*) AS n FROM cd GROUP BY ALL), d1 AS (SELECT snap, dev, count(*) AS n FROM cd GROUP BY ALL), m1 AS (SELECT snap, cust, count(*) AS n FROM cm GROUP BY ALL) SELECT kk.txn_id, {zero('c1.n', 'g_cust_degree_dev')}, {zero('d1.n', 'g_dev_degree_cust')}, {zero('m1.n', 'g_cust_degree_merch')}, {r('CASE WHEN kk.snap IS NOT NULL THEN coalesce(d1.n, 0) / greatest(coalesce(c1.n, 0), 1) END', 'g_dev_share_of_cust')} FROM kk LEFT JOIN c1 ON c1.snap = kk.snap AND c1.cust = kk.cust LEFT JOIN d1 ON d1.snap = kk.snap AND d1.dev = kk.dev LEFT JOIN m1 ON m1.snap = kk.snap AND m1.cust = kk.cust")
add("graph_2hop", "a", with_snap(graph.two_hops), graph.TWO_HOP,
    f"{SNAP}{EDGES}, c2 AS (SELECT a.snap, a.cust, count(*) AS n FROM cd a JOIN cd b ON a.snap = b.snap AND a.dev = b.dev AND a.cust <> b.cust GROUP BY ALL), d2 AS (SELECT a.snap, a.dev, count(*) AS n FROM cd a JOIN cd b ON a.snap = b.snap AND a.cust = b.cust AND a.dev <> b.dev GROUP BY ALL) SELECT kk.txn_id, {zero('c2.n', 'g_cust_2hop')}, {zero('d2.n', 'g_dev_2hop')} FROM kk LEFT JOIN c2 ON c2.snap = kk.snap AND c2.cust = kk.cust LEFT JOIN d2 ON d2.snap = kk.snap AND d2.dev = kk.dev")


def component_sql(edges: str, prefix: str, extra: str = "") -> str:
    """Labels by recursive reachability of customers over shared devices, with UNION as the fixpoint."""
    return (
        f"{SNAP}{EDGES}, nb AS (SELECT DISTINCT a.snap, a.cust AS x, b.cust AS z FROM {edges} a JOIN {edges} b ON a.snap = b.snap AND a.dev = b.dev),"
        " reach AS (WITH RECURSIVE rr(snap, x, z) AS (SELECT snap, x, z FROM nb UNION SELECT rr.snap, rr.x, nb.z FROM rr JOIN nb ON nb.snap = rr.snap AND nb.x = rr.z) SELECT snap, x, min(z) AS lab FROM rr GROUP BY ALL),"
        f" dl AS (SELECT e.snap, e.dev, min(lab) AS lab FROM {edges} e JOIN reach ON reach.snap = e.snap AND reach.x = e.cust GROUP BY ALL),"
        " sz AS (SELECT snap, lab, sum(c) AS nc, sum(d) AS nd FROM (SELECT snap, lab, 1 AS c, 0 AS d FROM reach UNION ALL SELECT snap, lab, 0, 1 FROM dl) GROUP BY ALL)"
        f" SELECT kk.txn_id, {r('CASE WHEN kk.snap IS NOT NULL THEN coalesce(sz.nc + sz.nd, 1) END', f'{prefix}comp_size')}, {r('CASE WHEN kk.snap IS NOT NULL THEN coalesce(sz.nc, 1) END', f'{prefix}comp_n_cust')}, {r('CASE WHEN kk.snap IS NOT NULL THEN coalesce(sz.nd, 0) END', f'{prefix}comp_n_dev')}, {r('CASE WHEN kk.snap IS NOT NULL THEN coalesce(reach.lab = dl.lab, false)::INT END', f'{prefix}same_component')}{extra}"
        " FROM kk LEFT JOIN reach ON reach.snap = kk.snap AND reach.x = kk.cust LEFT JOIN dl ON dl.snap = kk.snap AND dl.dev = kk.dev LEFT JOIN sz ON sz.snap = reach.snap AND sz.lab = reach.lab"
    )


FRAC = ", " + r("CASE WHEN kk.snap IS NOT NULL THEN coalesce(sz.nc + sz.nd, 1) / (SELECT count(DISTINCT cust) + count(DISTINCT dev) FROM s) END", "g_comp_size_frac")
add("graph_components", "a", with_snap(graph.components), graph.COMPONENTS, component_sql("cd", "g_", FRAC))
add("graph_recent", "a", with_snap(graph.recent), graph.RECENT)
SQL["graph_recent"] = f"{DUCK['a']} " + component_sql("rd", "gr_").replace(" SELECT kk.txn_id,", ", rc AS (SELECT snap, cust, count(*) AS n FROM rd GROUP BY ALL), rv AS (SELECT snap, dev, count(*) AS n FROM rd GROUP BY ALL), r2 AS (SELECT a.snap, a.cust, count(*) AS n FROM rd a JOIN rd b ON a.snap = b.snap AND a.dev = b.dev AND a.cust <> b.cust GROUP BY ALL), lv AS (SELECT snap, dev, count(*) AS n FROM cd GROUP BY ALL) SELECT kk.txn_id,").replace(
    " FROM kk LEFT JOIN reach", f", {zero('rc.n', 'gr_cust_degree_dev')}, {zero('rv.n', 'gr_dev_degree_cust')}, {zero('r2.n', 'gr_cust_2hop')}, {r('CASE WHEN kk.snap IS NOT NULL THEN coalesce(rv.n, 0) / greatest(coalesce(lv.n, 0), 1) END', 'gr_dev_degree_ratio')} FROM kk LEFT JOIN rc ON rc.snap = kk.snap AND rc.cust = kk.cust LEFT JOIN rv ON rv.snap = kk.snap AND rv.dev = kk.dev LEFT JOIN r2 ON r2.snap = kk.snap AND r2.cust = kk.cust LEFT JOIN lv ON lv.snap = kk.snap AND lv.dev = kk.dev LEFT JOIN reach"
)
add("graph_embeddings", "a", with_snap(graph.embedded), [*graph.SPECTRAL, *graph.GNN], digits=4)
add("graph_snapshot_age", "a", lambda df: graph.assign_snapshots(df).withColumn("days_since_graph_snapshot", (F.col("ts_epoch") - F.col("snap")) / 86_400.0), ["days_since_graph_snapshot"], f"{SNAP} SELECT txn_id, {r('(ts_epoch - snap) / 86400.0', 'days_since_graph_snapshot')} FROM kk")

# ---- evaluation --------------------------------------------------------------------------------------------
DESCRIBE = " UNION ALL ".join(
    f"SELECT '{f.name}' AS fold, '{p}' AS part, count(*) AS n, {r('sum(label)', 'positives')}, {r('avg(label)', 'base_rate')} FROM s WHERE NOT is_test AND {c} HAVING count(*) > 0"
    for f in folds.FOLDS_A for p, c in (("train", f"ts <= TIMESTAMP '{f.train_end}'"), ("val", f"ts BETWEEN TIMESTAMP '{f.val_start}' AND TIMESTAMP '{f.val_end}'"))
)
add("folds_describe", "a", lambda df: folds.describe_folds(df, folds.FOLDS_A), ["fold", "part", "n", "positives", "base_rate"], DESCRIBE, key="")
add("fold_embargo", "a", lambda df: df.where(folds.FOLDS_A[0].embargo()), ["ts_epoch"], "SELECT txn_id, CAST(ts_epoch AS BIGINT) AS ts_epoch FROM s WHERE ts_epoch > epoch_us(TIMESTAMP '2024-01-10 23:59:59') // 1000000 - 604800 AND ts_epoch <= epoch_us(TIMESTAMP '2024-01-10 23:59:59') // 1000000")
AP = lambda score, where="label IS NOT NULL": f"(SELECT sum(tp * ctp / cn) / sum(tp) FROM (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM (SELECT {score} AS v, sum(label) AS tp, count(*) AS n FROM s WHERE {where} GROUP BY 1) WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)))"
add("average_precision", "b", lambda df: metrics.average_precision(df.where("label is not null").withColumn("score", F.floor(F.col("amount") / 1000))), ["ap"], f"SELECT {r(AP('floor(amount / 1000)'), 'ap', 9)}", key="", digits=9)
add("single_feature_ap", "b", lambda df: metrics.single_feature_ap(df.withColumn("odd", F.when(F.col("txn_id") % 3 == 0, F.col("amount"))), ["amount", "account_age_days", "odd"]), ["feature", "ap_pos", "ap_neg"],
    " UNION ALL ".join(f"SELECT '{n}' AS feature, {r(AP(f'coalesce({x}, -1e9)'), 'ap_pos', 9)}, {r(AP(f'-coalesce({x}, -1e9)'), 'ap_neg', 9)}" for n, x in (("amount", "amount"), ("account_age_days", "CAST(account_age_days AS DOUBLE)"), ("odd", "CASE WHEN txn_id % 3 = 0 THEN amount END"))), key="", digits=9)
add("rank_average", "a", lambda df: metrics.rank_average(df.withColumn("v", F.round("amount", 0)), "v", "rank"), ["rank"], f", v AS (SELECT *, CAST(round(amount) AS DOUBLE) AS x FROM s) SELECT txn_id, {r('rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0', 'rank')} FROM v")
add("rank_ordinal", "a", lambda df: metrics.rank_ordinal(df.withColumn("v", F.round("amount", 0)), "v", "txn_id", "rank"), ["rank"], "SELECT txn_id, row_number() OVER (ORDER BY round(amount), txn_id) AS rank FROM s")
add("recency_weights", "a", lambda df: df.where("not is_test").withColumn("w", metrics.recency_weight((F.unix_timestamp(F.lit(CUTOFF["a"]).cast("timestamp")) - F.col("ts_epoch")) / 86_400.0, 45.0)), ["w"], f"SELECT txn_id, {r(f'pow(0.5, (epoch_us(TIMESTAMP {CUTOFF['a']!r}) // 1000000 - ts_epoch) / 86400.0 / 45.0)', 'w')} FROM s WHERE NOT is_test")
add("quantile_map", "a", lambda df: metrics.quantile_map(df.where("is_test").select("txn_id", "amount"), "amount", "txn_id", df.where("not is_test").select((F.col("account_age_days") / 500.0).alias("p")), "p", "m"), ["m"],
    f", rf AS (SELECT account_age_days / 500.0 AS p, row_number() OVER (ORDER BY account_age_days) - 1 AS i FROM s WHERE NOT is_test), q AS (SELECT txn_id, (row_number() OVER (ORDER BY amount, txn_id) - 1) / (count(*) OVER () - 1.0) AS q FROM s WHERE is_test), z AS (SELECT *, q * (SELECT count(*) - 1 FROM rf) AS pos FROM q) SELECT txn_id, {r('least(greatest(a.p + (b.p - a.p) * (pos - floor(pos)) + 1e-9 * q, 0), 1)', 'm')} FROM z JOIN rf a ON a.i = floor(pos) JOIN rf b ON b.i = least(floor(pos) + 1, (SELECT count(*) - 1 FROM rf))")

# ---- model layer -------------------------------------------------------------------------------------------
# three scores of labelled rows that need no fitted model, so that SQL can follow them
MEMBERS = {"m1": "amount", "m2": "CAST(account_age_days AS DOUBLE)", "m3": "CAST(txn_id * 7919 % 1009 AS DOUBLE)"}
WEIGHTS = {"m1": 0.5, "m2": 0.3, "m3": 0.2}
members = lambda df: df.withColumns({n: F.expr(x) for n, x in MEMBERS.items()})
AVERAGE = ", ".join(f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) AS r_{n}" for n, x in MEMBERS.items())
BLENDED = " + ".join(f"r_{n} * {w}" for n, w in WEIGHTS.items())
add("weighted_ranks", "b", lambda df: model.weighted_ranks(members(df.where("is_test")), WEIGHTS), ["score"],
    f", k AS (SELECT txn_id, {AVERAGE} FROM s WHERE is_test), z AS (SELECT txn_id, {BLENDED} AS z FROM k) SELECT txn_id, {r('(z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ())', 'score', 9)} FROM z", digits=9)
add("calibrate", "b", lambda df: model.calibrate(df.where("is_test").select("txn_id", F.col("amount").alias("score")), df.where("not is_test").select((F.col("txn_id") * 7919 % 1009 / 2000.0).alias("p")), "p"), ["calibrated"],
    f", rf AS (SELECT txn_id * 7919 % 1009 / 2000.0 AS p, row_number() OVER (ORDER BY txn_id * 7919 % 1009) - 1 AS i FROM s WHERE NOT is_test), q AS (SELECT txn_id, (row_number() OVER (ORDER BY amount, txn_id) - 1) / (count(*) OVER () - 1.0) AS q FROM s WHERE is_test), z AS (SELECT *, q * (SELECT count(*) - 1 FROM rf) AS pos FROM q) SELECT txn_id, {r('least(greatest(a.p + (b.p - a.p) * (pos - floor(pos)) + 1e-9 * q, 0), 1)', 'calibrated')} FROM z JOIN rf a ON a.i = floor(pos) JOIN rf b ON b.i = least(floor(pos) + 1, (SELECT count(*) - 1 FROM rf))")
add("describe_scores", "b", lambda df: metrics.describe(df.where("is_test"), "amount"), ["n", "mean", "std", "least", "largest", "p50", "p99"],
    f"SELECT count(amount) AS n, {r('avg(amount)', 'mean', 3)}, {r('stddev_samp(amount)', 'std', 3)}, {r('min(amount)', 'least', 3)}, {r('max(amount)', 'largest', 3)}, {r('quantile_cont(amount, 0.5)', 'p50', 3)}, {r('quantile_cont(amount, 0.99)', 'p99', 3)} FROM s WHERE is_test", key="", digits=3)
FOLD_AP = " UNION ALL ".join(f"SELECT '{f.name}' AS fold, {AP('amount', f'NOT is_test AND ts BETWEEN TIMESTAMP {f.val_start!r} AND TIMESTAMP {f.val_end!r}')} AS ap_val" for f in folds.FOLDS_A)


def fold_scores(df: DataFrame) -> DataFrame:
    """(fold, ap_val) of the amount as a score, on each fold's validation rows."""
    one = lambda f: metrics.average_precision(df.where(f.validation()), "amount").select(F.lit(f.name).alias("fold"), F.col("ap").alias("ap_val"))
    return reduce(DataFrame.union, map(one, folds.FOLDS_A))


add("fold_summary", "a", lambda df: model.fold_summary(fold_scores(df)), ["folds", "mean_ap", "std_ap", "least_ap", "best_fold"],
    f", f AS ({FOLD_AP}) SELECT count(*) AS folds, {r('avg(ap_val)', 'mean_ap', 9)}, {r('stddev_samp(ap_val)', 'std_ap', 9)}, {r('min(ap_val)', 'least_ap', 9)}, arg_max(fold, ap_val) AS best_fold FROM f", key="", digits=9)
GAINED = {"amount": "amount", "account_age_days": "account_age_days", "hour": "extract(hour FROM ts)", "dayofweek": "extract(day FROM ts)"}
GAINS = " UNION ALL ".join(f"SELECT '{f.name}' AS fold, '{n}' AS feature, sum(CAST({x} AS DOUBLE)) AS gain FROM s WHERE NOT is_test AND ts <= TIMESTAMP '{f.train_end}'" for f in folds.FOLDS_A for n, x in GAINED.items())
GAIN_MEANS = f", g AS ({GAINS}), m AS (SELECT feature, avg(gain / total) AS mean_gain FROM (SELECT *, sum(gain) OVER (PARTITION BY fold) AS total FROM g) x GROUP BY feature)"


def fold_gains(df: DataFrame) -> DataFrame:
    """(fold, feature, gain): sums over each fold's training rows stand for the gains of a fitted model."""
    names = ", ".join(f"'{n}', CAST({x} AS DOUBLE)" for n, x in GAINED.items())
    one = lambda f: df.where(f.train()).selectExpr(f"'{f.name}' AS fold", f"stack({len(GAINED)}, {names}) AS (feature, v)")
    return reduce(DataFrame.union, map(one, folds.FOLDS_A)).groupBy("fold", "feature").agg(F.sum("v").alias("gain"))


add("top_gains", "a", lambda df: model.top_features(model.mean_gains(fold_gains(df)), 3), ["feature", "mean_gain", "place"], f"{GAIN_MEANS} SELECT feature, {r('mean_gain', 'mean_gain', 9)}, row_number() OVER (ORDER BY mean_gain DESC) AS place FROM m QUALIFY place <= 3", key="", digits=9)
add("gain_by_block", "a", lambda df: model.gain_by_block(model.mean_gains(fold_gains(df)), {"amount": ["amount"], "temporal": temporal.NAMES}), ["block", "gain", "features"],
    f"{GAIN_MEANS} SELECT CASE WHEN feature = 'amount' THEN 'amount' ELSE 'temporal' END AS block, {r('sum(mean_gain)', 'gain', 9)}, count(*) AS features FROM m GROUP BY 1", key="", digits=9)
SMALL = {"base": (2, 4, 0.1, None), "hl45": (2, 4, 0.1, 45.0)}
INPUTS = ["amount", "account_age_days", "gap"]


def fitted_scores(df: DataFrame) -> DataFrame:
    """Search on the primary fold, blend of what it found, and final scores of unlabelled rows, with small trees."""
    df = past_gaps(df).persist()
    valid, results = model.search(df, INPUTS, folds.FOLDS_A[0], SMALL)
    spec = model.blend(valid, list(SMALL))
    return model.final(df, INPUTS, spec["weights"], {x["name"]: x["rounds"] for x in results}, CUTOFF["a"], (42,), SMALL)


past_gaps = lambda df: df.withColumn("gap", past.prev_gap(("cust",)))
add("model_scores", "a", fitted_scores, ["score"])
QUERIES["walk_forward"] = lambda s, d: rounded(s.createDataFrame(model.walk_forward(past_gaps(stream(s, d)), lambda df, end: df, INPUTS, folds.FOLDS_A[:2], SMALL["base"])[0]), ["fold", "ap_train", "ap_val", "base_rate", "lift"])

# ---- audit -------------------------------------------------------------------------------------------------
AUDITED = ["amount", "account_age_days", "gap"]
gapped = lambda df: df.withColumn("gap", past.prev_gap(("cust",)))
LONG = f", l AS (SELECT *, ts_epoch - lag(ts_epoch) OVER {win('cust')} AS gap FROM s), u AS (" + " UNION ALL ".join(f"SELECT ts, cust, txn_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM l" for f in AUDITED) + ")"
add("audit_boundary", "a", lambda df: audit.boundary_continuity(gapped(df), AUDITED, CUTOFF["a"], "2024-01-21 00:00:00", days=7), ["feature", "median_pre", "median_post", "norm_shift", "nan_pre", "nan_post", "flag"],
    f"{LONG}, e AS (SELECT *, CASE WHEN ts > TIMESTAMP '2024-01-13 23:59:59' AND ts <= TIMESTAMP '2024-01-20 23:59:59' THEN 'a' WHEN ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-28' THEN 'b' END AS p FROM u), g AS (SELECT feature, median(v) FILTER (p = 'a') AS ma, median(v) FILTER (p = 'b') AS mb, stddev_pop(v) AS sd, avg((v IS NULL)::INT) FILTER (p = 'a') AS na, avg((v IS NULL)::INT) FILTER (p = 'b') AS nb FROM e WHERE p IS NOT NULL GROUP BY feature) SELECT feature, {r('ma', 'median_pre')}, {r('mb', 'median_post')}, {r('abs(mb - ma) / sd', 'norm_shift')}, {r('na', 'nan_pre')}, {r('nb', 'nan_post')}, CASE WHEN abs(mb - ma) / sd > 0.35 THEN 'REVIEW' ELSE 'ok' END AS flag FROM g", key="")
add("audit_tail", "a", lambda df: audit.tail_coverage(gapped(df), AUDITED), ["feature", "nan_tail", "nan_rest", "excess", "failed"],
    f"{LONG}, t AS (SELECT *, ts > (SELECT max(ts) FROM s) - INTERVAL 7 DAYS AS tail FROM u), g AS (SELECT feature, avg((v IS NULL)::INT) FILTER (tail) AS a, avg((v IS NULL)::INT) FILTER (NOT tail) AS b FROM t GROUP BY feature) SELECT feature, {r('a', 'nan_tail')}, {r('b', 'nan_rest')}, {r('a - b', 'excess')}, a - b > 0.1 AS failed FROM g", key="")
add("audit_first_row_null", "a", lambda df: audit.first_row_null(gapped(df), "cust", AUDITED), ["feature", "n_filled"],
    f"{LONG} SELECT feature, count(v) AS n_filled FROM (SELECT *, row_number() OVER (PARTITION BY cust, feature ORDER BY ts, txn_id) AS rn FROM u) WHERE rn = 1 GROUP BY feature", key="")
add("audit_near_perfect", "b", lambda df: audit.near_perfect(df, ["amount", "account_age_days"]), ["feature", "best_ap", "failed"],
    " UNION ALL ".join(f"SELECT feature, {r('greatest(x, y)', 'best_ap', 9)}, greatest(x, y) > 0.85 AS failed FROM (SELECT '{n}' AS feature, {AP(f'CAST({n} AS DOUBLE)')} AS x, {AP(f'-CAST({n} AS DOUBLE)')} AS y)" for n in ("amount", "account_age_days")), key="", digits=9)
# every feature that may read the past only; the audit must find no row of any that later rows change
TRUNCATED = [f for f in matrix.FEATURES if f not in {*graph.SPECTRAL, *graph.GNN, "g_comp_size_frac"}]
add("audit_truncation", "a", lambda df: audit.truncation_mismatches_of_parts(lambda x, tasks: matrix.parts(x, "2024-01-15 00:00:00", use_embeddings=False, tasks=tasks), df, "2024-01-15 00:00:00", TRUNCATED), ["feature", "n_mismatched"],
    " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(0 AS BIGINT) AS n_mismatched" for f in TRUNCATED), key="")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and device velocity, amounts and entities of stream a: the label-free matrix."""
    return matrix.build_label_free(stream(spark, sf_dir))
