"""Parameters of the feature engine. Dates and sizes of one data set are parameters, not constants of the code."""

from __future__ import annotations

from dataclasses import dataclass

# Windows in seconds, smoothing, half-life, snapshot and embedding sizes, and names that may be no features,
# of the engine this one matches.
WINDOWS_S = {"1h": 3600, "6h": 21_600, "24h": 86_400, "72h": 259_200, "168h": 604_800}
VELOCITY_WINDOWS = {"cust": ["1h", "6h", "24h", "72h", "168h"], "dev": ["1h", "6h", "24h", "168h"], "merch": ["1h", "24h"], "loc": ["1h", "24h"]}
RANK_WINDOWS_D = (7, 30)
RANK_GRID, RANK_LEAST_ROWS = 128, 100
TE_ALPHA, TE_HALFLIFE_D = 100.0, 30.0
GRAPH_LEAST_ROWS, EMBED_DIM = 500, 32
MISSING = "__NA__"
EMBARGO_S = WINDOWS_S["168h"]
BANNED = frozenset({"txn_id", "ts", "label", "ts_epoch", "is_test", "row_order", "cust", "merch", "dev"})
SUSPICIOUS = ("fraud", "target", "label", "_y", "epoch")


@dataclass(frozen=True)
class EngineConfig:
    """What a run may change."""

    te_alpha: float = TE_ALPHA
    te_halflife_d: float = TE_HALFLIFE_D
    use_signup_inconsistency: bool = False
    use_embeddings: bool = True
    embed_dim: int = EMBED_DIM
    seed: int = 42
