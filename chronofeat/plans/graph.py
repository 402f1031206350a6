"""Snapshot-graph features (29): weekly graphs of customers, devices and merchants from strictly earlier rows.

A snapshot is a Sunday at midnight; rows of the week after it read the graph of all rows before it (lifetime) or of
the seven days before it (recent). Degrees, two-hop path counts and components are joins and aggregates keyed by
(snapshot, node). Spectral and propagated embeddings are computed with numpy, one snapshot's graph in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.config import EMBED_DIM, GRAPH_LEAST_ROWS
from chronofeat.operators.components import connected_components, forest

DEGREES = ["g_cust_degree_dev", "g_dev_degree_cust", "g_cust_degree_merch", "g_dev_share_of_cust"]
TWO_HOP = ["g_cust_2hop", "g_dev_2hop"]
COMPONENTS = ["g_comp_size", "g_comp_n_cust", "g_comp_n_dev", "g_same_component", "g_comp_size_frac"]
RECENT = ["gr_comp_size", "gr_comp_n_cust", "gr_comp_n_dev", "gr_cust_degree_dev", "gr_dev_degree_cust", "gr_cust_2hop", "gr_same_component", "gr_dev_degree_ratio"]
SPECTRAL = ["g_cd_cos", "g_cm_cos", "g_cust_emb_drift", "g_cust_emb_norm", "g_dev_emb_norm"]
GNN = ["gnn_cd_cos", "gnn_cd_score", "gnn_cust_emb_drift", "gnn_cm_cos"]
NAMES = [*DEGREES, *TWO_HOP, *COMPONENTS, *RECENT, *SPECTRAL, *GNN, "days_since_graph_snapshot"]

WEEK_S = 7 * 86_400
#: Change of singular values, as a part of the largest, at which the iteration ends; and rounds at most.
TOLERANCE, ITERATIONS = 1e-10, 500
#: Nodes of a side up to which its products are decomposed directly; rows of the other side, and of results, at a time.
NARROW, BLOCK, CHUNK = 512, 4096, 50_000
#: Links that refinement by link prediction takes at least.
LEAST_LINKS = 100
#: 1970-01-04 was a Sunday.
FIRST_SUNDAY_S = 3 * 86_400


def week_start(epoch):
    """The Sunday midnight at or before a time, in seconds."""
    return (F.floor((epoch - FIRST_SUNDAY_S) / WEEK_S) * WEEK_S + FIRST_SUNDAY_S).cast("long")


def assign_snapshots(df: DataFrame, least_rows: int = GRAPH_LEAST_ROWS, base: DataFrame | None = None) -> DataFrame:
    """Adds snap: the row's snapshot in epoch seconds; null before the first Sunday and with too few earlier rows."""
    df = df.withColumn("__week", week_start(F.col("ts_epoch")))
    weeks = (df if base is None else base.withColumn("__week", week_start(F.col("ts_epoch")))).groupBy("__week").agg(F.count(F.lit(1)).alias("n"), F.min("ts_epoch").alias("t"))
    start = weeks.agg((F.floor(F.min("t") / 86_400) * 86_400).alias("first_day"))
    earlier = weeks.alias("a").join(F.broadcast(weeks.select(F.col("__week").alias("w"), "n")).alias("b"), F.col("b.w") < F.col("a.__week"), "left")  # a row for each week of the stream
    hist = earlier.groupBy("__week").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("hist")).crossJoin(F.broadcast(start))
    ok = hist.select("__week", F.when((F.col("__week") >= F.col("first_day")) & (F.col("hist") >= least_rows), F.col("__week")).alias("snap"))
    return df.join(F.broadcast(ok), "__week").drop("__week")


def _snapshots(df: DataFrame) -> DataFrame:
    return df.where("snap is not null").select("snap").distinct()


def lifetime_edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """(snap, a, b): pairs that occur before each snapshot."""
    first = df.groupBy(a, b).agg(F.min("ts_epoch").alias("t"))
    return first.join(F.broadcast(_snapshots(df)), F.col("t") < F.col("snap")).select("snap", a, b)  # a row for each week


def recent_edges(df: DataFrame) -> DataFrame:
    """(snap, cust, dev): pairs of the seven days before each snapshot."""
    last = df.select((week_start(F.col("ts_epoch")) + WEEK_S).alias("snap"), "cust", "dev").distinct()
    return last.join(F.broadcast(_snapshots(df)), "snap")


def _degree(edges: DataFrame, key: str, name: str) -> DataFrame:
    return edges.groupBy("snap", key).agg(F.count(F.lit(1)).alias(name))


def lifetime_degree(df: DataFrame, base: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """(snap, key, name): the other side's nodes that a node met before a snapshot, for those that rows of df read.

    A pair counts from the first Sunday after it, and counts are added up from week to week: no pair is repeated
    for every week after its first.
    """
    first = base.groupBy(key, other).agg(F.min("ts_epoch").alias("t"))
    gained = first.select(key, (week_start(F.col("t")) + WEEK_S).alias("snap"), F.lit(1).alias("__new"), F.lit(False).alias("__read"))
    read = df.where("snap is not null").select(key, "snap", F.lit(0).alias("__new"), F.lit(True).alias("__read"))
    weeks = gained.union(read).groupBy(key, "snap").agg(F.sum("__new").alias("__new"), F.max("__read").alias("__read"))
    so_far = Window.partitionBy(key).orderBy("snap").rowsBetween(Window.unboundedPreceding, 0)
    return weeks.withColumn(name, F.sum("__new").over(so_far)).where("__read").select("snap", key, name)


def _attach(df: DataFrame, table: DataFrame, keys: list[str], names: dict[str, float]) -> DataFrame:
    """Left join on (snap, keys); nodes that the graph lacks get the given values, rows without a snapshot null."""
    df = df.join(table, ["snap", *keys], "left")
    return df.withColumns({n: F.when(F.col("snap").isNotNull(), F.coalesce(F.col(n).cast("double"), F.lit(float(v)))) for n, v in names.items()})


def degrees(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    base = df if base is None else base
    for key, other, name in (("cust", "dev", "g_cust_degree_dev"), ("dev", "cust", "g_dev_degree_cust"), ("cust", "merch", "g_cust_degree_merch")):
        df = _attach(df, lifetime_degree(base, base, key, other, name), [key], {name: 0})
    return df.withColumn("g_dev_share_of_cust", F.col("g_dev_degree_cust") / F.greatest("g_cust_degree_dev", F.lit(1.0)))


def _two_hop(edges: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """Paths to another node of the same side: over a node's neighbours, their other neighbours."""
    return edges.join(_degree(edges, other, "__d"), ["snap", other]).groupBy("snap", key).agg(F.sum(F.col("__d") - 1).alias(name))


def two_hops(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    cd = lifetime_edges(df if base is None else base, "cust", "dev")
    df = _attach(df, _two_hop(cd, "cust", "dev", "g_cust_2hop"), ["cust"], {"g_cust_2hop": 0})
    return _attach(df, _two_hop(cd, "dev", "cust", "g_dev_2hop"), ["dev"], {"g_dev_2hop": 0})


def _lifetime_links(df: DataFrame) -> DataFrame:
    """(snap, cust, dev): of lifetime_edges those that link what all do, before each snapshot.

    An edge that closes a cycle with none that come later links nothing new in any week, so edges are thinned out
    before they are repeated for each week after their first.
    """
    first = df.groupBy("cust", "dev").agg(F.min("ts_epoch").alias("t"))
    node = lambda side, c: F.format_string(f"{side}%s", F.col(c).cast("string"))
    kept = forest(first.select(node("d", "dev").alias("u"), node("c", "cust").alias("v"), (week_start(F.col("t")) + WEEK_S).alias("week")), "week")
    kept = kept.join(F.broadcast(_snapshots(df)), F.col("week") <= F.col("snap"))  # a row for each week
    return kept.select("snap", F.expr("substring(v, 2)").alias("cust"), F.expr("substring(u, 2)").alias("dev"))


def _component_tables(edges: DataFrame, cust: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(snap, cust, label, size, customers) and (snap, dev, label); cust: the type of customers."""
    node = lambda side, c: F.format_string(f"%020d{side}%s", F.col("snap"), F.col(c).cast("string"))
    found = connected_components(edges.select(node("c", "cust").alias("a"), node("d", "dev").alias("b")))
    is_cust = F.substring("node", 21, 1) == "c"
    size = found.groupBy("label").agg(F.count(F.lit(1)).alias(f"__{prefix}size"), F.count_if(is_cust).alias(f"__{prefix}nc"))
    nodes = found.join(size, "label").select(F.substring("node", 1, 20).cast("long").alias("snap"), is_cust.alias("is_cust"), F.expr("substring(node, 22)").alias("id"), "label", f"__{prefix}size", f"__{prefix}nc")
    custs = nodes.where("is_cust").select("snap", F.col("id").try_cast(cust).alias("cust"), F.col("label").alias(f"__{prefix}lc"), f"__{prefix}size", f"__{prefix}nc")
    return custs, nodes.where("not is_cust").select("snap", F.col("id").alias("dev"), F.col("label").alias(f"__{prefix}ld"))


def _component_columns(df: DataFrame, prefix: str) -> DataFrame:
    """Columns from those of the two tables, which df was joined to."""
    here = F.col("snap").isNotNull()
    size, nc, lc, ld = (F.col(f"__{prefix}{x}") for x in ("size", "nc", "lc", "ld"))
    df = df.withColumns(
        {
            f"{prefix}comp_size": F.when(here, F.coalesce(size, F.lit(1)).cast("double")),
            f"{prefix}comp_n_cust": F.when(here, F.coalesce(nc, F.lit(1)).cast("double")),
            f"{prefix}comp_n_dev": F.when(here, F.coalesce(size - nc, F.lit(0)).cast("double")),
            f"{prefix}same_component": F.when(here, F.coalesce(lc == ld, F.lit(False)).cast("double")),
        }
    )
    return df.drop(*(f"__{prefix}{x}" for x in ("size", "nc", "lc", "ld")))


def _with_components(df: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    custs, devs = _component_tables(edges, dict(df.dtypes)["cust"], prefix)
    return _component_columns(df.join(custs, ["snap", "cust"], "left").join(devs, ["snap", "dev"], "left"), prefix)


def _frac(df: DataFrame, base: DataFrame) -> DataFrame:
    nodes = base.agg(F.countDistinct("cust").alias("c"), F.countDistinct("dev").alias("d")).select((F.col("c") + F.col("d")).alias("__nodes"))
    df = df.crossJoin(F.broadcast(nodes))  # one row
    return df.withColumn("g_comp_size_frac", F.col("g_comp_size") / F.greatest("__nodes", F.lit(1))).drop("__nodes")


def components(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    base = df if base is None else base
    return _frac(_with_components(df, _lifetime_links(base), "g_"), base)


def recent(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    base = df if base is None else base
    r = recent_edges(base)
    df = _with_components(df, r, "gr_")
    df = _attach(df, _degree(r, "cust", "gr_cust_degree_dev"), ["cust"], {"gr_cust_degree_dev": 0})
    df = _attach(df, _degree(r, "dev", "gr_dev_degree_cust"), ["dev"], {"gr_dev_degree_cust": 0})
    df = _attach(df, _two_hop(r, "cust", "dev", "gr_cust_2hop"), ["cust"], {"gr_cust_2hop": 0})
    df = _attach(df, lifetime_degree(base, base, "dev", "cust", "__life"), ["dev"], {"__life": 0})
    return df.withColumn("gr_dev_degree_ratio", F.col("gr_dev_degree_cust") / F.greatest("__life", F.lit(1.0))).drop("__life")


def _by_narrow_side(long: np.ndarray, narrow: np.ndarray, w: np.ndarray, n_long: int, n_narrow: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors from the eigenvectors of the narrow side's products: two passes over blocks of the long side's rows."""
    order = np.argsort(long, kind="stable")
    long, narrow, w = long[order], narrow[order], w[order]
    starts = range(0, n_long, BLOCK)
    cuts = np.searchsorted(long, [*starts, n_long])

    def block(i: int) -> np.ndarray:
        here = slice(cuts[i], cuts[i + 1])
        x = np.zeros((min(BLOCK, n_long - i * BLOCK), n_narrow))
        x[long[here] - i * BLOCK, narrow[here]] = w[here]
        return x

    products = sum((x.T @ x for x in map(block, range(len(starts)))), np.zeros((n_narrow, n_narrow)))
    values, vectors = np.linalg.eigh(products)
    v = vectors[:, ::-1][:, :k]
    return np.concatenate([block(i) @ v for i in range(len(starts))]), v * np.sqrt(np.maximum(values[::-1][:k], 0))


def spectral_factors(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int, dim: int = EMBED_DIM, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular vectors of the degree-normalised incidence matrix, times the singular values."""
    out = np.zeros((n_left, dim)), np.zeros((n_right, dim))
    k = min(dim, min(n_left, n_right) - 1)
    if k < 2 or not len(left):
        return out
    w = 1 / np.sqrt(np.bincount(left, minlength=n_left)[left] * np.bincount(right, minlength=n_right)[right])
    if min(n_left, n_right) <= NARROW:
        if n_left < n_right:
            b, a = _by_narrow_side(right, left, w, n_right, n_left, k)
        else:
            a, b = _by_narrow_side(left, right, w, n_left, n_right, k)
        out[0][:, :k], out[1][:, :k] = a, b
        return out

    def times(rows: np.ndarray, columns: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(rows, w * x[columns, j], n) for j in range(x.shape[1])], 1)

    # subspace iteration with sparse products, until the values stand still
    wide = min(2 * k + 8, n_left, n_right)
    q, before = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_right, wide)))[0], None
    for _ in range(ITERATIONS):
        z, s, _ = np.linalg.svd(times(left, right, q, n_left), full_matrices=False)
        if before is not None and np.abs(s[:k] - before[:k]).max() <= TOLERANCE * s[0]:
            break
        q, before = np.linalg.qr(times(right, left, z, n_right))[0], s
    u, s, wt = np.linalg.svd(times(left, right, q, n_left), full_matrices=False)
    u, s, v = u[:, :k], s[:k], (q @ wt.T)[:, :k]
    out[0][:, :k], out[1][:, :k] = u * s, v * s
    return out


def _cos(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return np.where(d > 1e-12, (a * b).sum(1) / np.maximum(d, 1e-9), np.nan)


def propagate(h: list[np.ndarray], weights: tuple[np.ndarray, np.ndarray], cd: tuple[np.ndarray, np.ndarray], cm: tuple[np.ndarray, np.ndarray], layers: int = 2, customers_first: bool = True) -> list[np.ndarray]:
    """Neighbourhood means through two tanh layers; devices and merchants see the customers' new state, or
    (where links are refined afterwards) the one before the layer.
    """

    def mean(rows: np.ndarray, columns: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        total = np.stack([np.bincount(rows, y[columns], n) for y in np.ascontiguousarray(x.T)], 1)
        return total / np.maximum(np.bincount(rows, minlength=n), 1)[:, None]

    c, d, m = h
    w1, w2 = weights
    for _ in range(layers):
        new = np.tanh(c @ w1 + (0.5 * mean(*cd, d, len(c)) + 0.5 * mean(*cm, m, len(c))) @ w2)
        seen = new if customers_first else c
        d = np.tanh(d @ w1 + mean(cd[1], cd[0], seen, len(d)) @ w2)
        m = np.tanh(m @ w1 + mean(cm[1], cm[0], seen, len(m)) @ w2)
        c = new
    return [c, d, m]


def refine_links(c: np.ndarray, d: np.ndarray, src: np.ndarray, dst: np.ndarray, epochs: int = 30, rate: float = 0.01, batch: int = 20_000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Link prediction with one negative an edge: Adam on the softplus loss of the two sides' dot products."""
    rng, p = np.random.default_rng(seed), [c.copy(), d.copy()]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    n = min(len(src), batch)
    for t in range(1, epochs + 1):
        i, neg = rng.integers(0, len(src), n), rng.integers(0, len(d), n)
        s, e = src[i], dst[i]
        up = -1 / (1 + np.exp((p[0][s] * p[1][e]).sum(1))) / n
        down = 1 / (1 + np.exp(-(p[0][s] * p[1][neg]).sum(1))) / n
        g = [np.zeros_like(x) for x in p]
        np.add.at(g[0], s, up[:, None] * p[1][e] + down[:, None] * p[1][neg])
        np.add.at(g[1], e, up[:, None] * p[0][s])
        np.add.at(g[1], neg, down[:, None] * p[0][s])
        for j in (0, 1):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g[j], 0.999 * v[j] + 0.001 * g[j] ** 2
            p[j] = p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1]


def embeddings(df: DataFrame, dim: int = EMBED_DIM, seed: int = 42, train_links: bool = False) -> DataFrame:
    """(snap, cust, dev, merch) of the rows that read a snapshot, with its spectral and propagated features.

    State goes from snapshot to snapshot, so the distinct edges are read by one task, as codes: this tier is for graphs
    whose nodes' vectors and coded edges fit one executor; the structural columns have no such bound.
    """
    edges = df.where("cust is not null").groupBy("cust", "dev", "merch").agg(F.min("ts_epoch").alias("t"), F.collect_set("snap").alias("snaps"))
    schema = "snap long, cust {0}, dev string, merch string, ".format(dict(df.dtypes)["cust"]) + ", ".join(f"{c} double" for c in (*SPECTRAL, *GNN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, t, row, at, read = [_Codes() for _ in range(3)], [], [], [], 0
        for batch in batches:
            for codes, column in zip(coded, batch.columns):
                codes.add(column)
            t.append(batch.column(3).to_numpy())
            n = pc.list_value_length(batch.column(4)).to_numpy()
            row.append(np.repeat(np.arange(read, read + len(n)), n))
            at.append(batch.column(4).flatten().to_numpy())
            read += len(n)
        if not read:
            return
        (c, cu), (d, du), (m, mu) = (codes.sorted() for codes in coded)
        t, row, at = np.concatenate(t), np.concatenate(row), np.concatenate(at)
        # rows in the order of their keys, whatever order they came in
        place = np.empty(read, np.int64)
        order = np.lexsort((m, d, c))
        place[order] = np.arange(read)
        c, d, m, t, row = c[order], d[order], m[order], t[order], place[row]
        by_row = np.lexsort((row, at))
        row, at = row[by_row], at[by_row]
        snaps, starts = np.unique(at, return_index=True)
        cd_all, cm_all = _pairs(c, d, t, len(du)), _pairs(c, m, t, len(mu))
        rng = np.random.default_rng(seed)
        h = [rng.standard_normal((len(u), dim)) / np.sqrt(dim) for u in (cu, du, mu)]
        w = tuple(np.eye(dim) + rng.standard_normal((dim, dim)) * 0.01 for _ in range(2))
        spectral_before = gnn_before = None
        for number, (snap, start, end) in enumerate(zip(snaps, starts, [*starts[1:], len(at)])):
            cd, cm = (tuple(x[first < snap] for x in (a, b)) for a, b, first in (cd_all, cm_all))
            sc, sd = spectral_factors(*cd, len(cu), len(du), dim, seed + number)
            tc, tm = spectral_factors(*cm, len(cu), len(mu), dim, seed + 1000 + number)
            refined = train_links and len(cd[0]) >= LEAST_LINKS
            h = propagate(h, w, cd, cm, customers_first=not refined)
            if refined:
                h[0], h[1] = refine_links(h[0], h[1], *cd, seed=seed + number)
            turned = None if spectral_before is None else _aligned(spectral_before, sc)
            for i in (row[x : min(x + CHUNK, end)] for x in range(start, end, CHUNK)):
                bc, bd, bm = c[i], d[i], m[i]
                none = np.full(len(i), np.nan)
                out = [
                    _cos(sc[bc], sd[bd]), _cos(tc[bc], tm[bm]), none if turned is None else 1 - _cos(sc[bc], turned[bc]),
                    np.linalg.norm(sc[bc], axis=1), np.linalg.norm(sd[bd], axis=1),
                    _cos(h[0][bc], h[1][bd]), (h[0][bc] * h[1][bd]).sum(1), none if gnn_before is None else 1 - _cos(h[0][bc], gnn_before[bc]), _cos(h[0][bc], h[2][bm]),
                ]
                keys = [pa.array(np.full(len(i), snap, np.int64)), *(u.take(pa.array(x)) for u, x in ((cu, bc), (du, bd), (mu, bm)))]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, out)], ["snap", "cust", "dev", "merch", *SPECTRAL, *GNN])
            spectral_before, gnn_before = sc, h[0].copy()

    return edges.repartition(1).mapInArrow(run, schema)


class _Codes:
    """Numbers of the distinct values of a column that comes in batches, in the end in the values' order."""

    def __init__(self) -> None:
        self.known, self.parts, self.type = {}, [], None

    def add(self, column: pa.Array) -> None:
        self.type = column.type
        found = column.dictionary_encode()
        new = np.array([self.known.setdefault(v, len(self.known)) for v in found.dictionary.to_pylist()], np.int64)
        self.parts.append(new[found.indices.to_numpy()])

    def sorted(self) -> tuple[np.ndarray, pa.Array]:
        values = sorted(self.known)
        rank = np.empty(len(values), np.int64)
        rank[[self.known[v] for v in values]] = np.arange(len(values))
        return rank[np.concatenate(self.parts)], pa.array(values, self.type)


def _pairs(a: np.ndarray, b: np.ndarray, t: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, each with its first time."""
    key = a * n + b
    order = np.argsort(key, kind="stable")
    pairs, starts = np.unique(key[order], return_index=True)
    return pairs // n, pairs % n, np.minimum.reduceat(t[order], starts)


def _aligned(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """old, turned (orthogonally) to lie as near to new as it can: two decompositions share no axes."""
    u, _, vt = np.linalg.svd(old.T @ new)
    return old @ (u @ vt)


def embedded(df: DataFrame, base: DataFrame | None = None, **options) -> DataFrame:
    e = embeddings(df if base is None else base, **options)
    df = df.join(e, ["snap", "cust", "dev", "merch"], "left")
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in (*SPECTRAL, *GNN)})


def build(df: DataFrame, use_embeddings: bool = True, base: DataFrame | None = None, **options) -> DataFrame:
    """All columns; tables of customers are joined first and those of devices then, so rows are dealt out twice in all."""
    base = df if base is None else base
    df, base = assign_snapshots(df, base=base), assign_snapshots(base)
    life, now = lifetime_edges(base, "cust", "dev"), recent_edges(base)
    components_of = {p: _component_tables(e, dict(df.dtypes)["cust"], p) for p, e in (("g_", _lifetime_links(base)), ("gr_", now))}
    met = lambda key, other, name: (lifetime_degree(base, base, key, other, name), name)
    hops = lambda edges, key, other, name: (_two_hop(edges, key, other, name), name)
    of = {
        "cust": [met("cust", "dev", "g_cust_degree_dev"), met("cust", "merch", "g_cust_degree_merch"), hops(life, "cust", "dev", "g_cust_2hop"), (_degree(now, "cust", "gr_cust_degree_dev"), "gr_cust_degree_dev"), hops(now, "cust", "dev", "gr_cust_2hop")],
        "dev": [met("dev", "cust", "g_dev_degree_cust"), hops(life, "dev", "cust", "g_dev_2hop"), (_degree(now, "dev", "gr_dev_degree_cust"), "gr_dev_degree_cust")],
    }
    for i, (key, tables) in enumerate(of.items()):
        for table, name in tables:
            df = _attach(df, table, [key], {name: 0})
        for both in components_of.values():
            df = df.join(both[i], ["snap", key], "left")
    for prefix in components_of:
        df = _component_columns(df, prefix)
    df = _frac(df, base).withColumns({"g_dev_share_of_cust": F.col("g_dev_degree_cust") / F.greatest("g_cust_degree_dev", F.lit(1.0)), "gr_dev_degree_ratio": F.col("gr_dev_degree_cust") / F.greatest("g_dev_degree_cust", F.lit(1.0))})
    df = df.withColumn("days_since_graph_snapshot", (F.col("ts_epoch") - F.col("snap")) / 86_400.0)
    return (embedded(df, base, **options) if use_embeddings else df).drop("snap")
