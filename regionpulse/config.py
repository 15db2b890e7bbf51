"""One frozen parameter object for the whole pipeline."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PipelineConfig:
    # time binning
    interval: str = "3 hours"
    # visitor ratio: how many favourite venues per user
    top_k: int = 4
    # low-activity cut: totals below these are dropped (reference defaults)
    min_interval_obs: int = 20
    min_region_obs: int = 300
    # biased matrix factorization (reference run: K=250, alpha=beta=0.001, 20 epochs)
    rank: int = 250
    learning_rate: float = 0.001
    regularization: float = 0.001
    epochs: int = 20
    error_scale: float = 2.0
    # stratified SGD: number of row/column blocks.  Part of the model (it fixes the order of
    # the updates), so never taken from data size or cores; raise it with the cluster
    blocks: int = 2
    # evaluation models
    forest_depth: int = 30
    fourier_components: int = 100
    landmarks: int = 100
    train_partitions: int = 8
    network_iterations: int = 100
    score_threshold: float = 0.5
    keep_observed: bool = False
    # sampling / evaluation
    seed: int = 0
    test_fraction: float = 0.3
    folds: int = 5
    # label alignment: "drop" reproduces the reference (quiet intervals vanish)
    quiet_intervals: str = "drop"

    def with_(self, **kw) -> "PipelineConfig":
        return replace(self, **kw)


DEFAULT = PipelineConfig()

# Names and order of the five dynamic features (fixed values of the reference).
FEATURES = (
    "visitor_count",
    "obs_freq",
    "visitor_entropy",
    "visitor_ratio",
    "region_popularity",
)
