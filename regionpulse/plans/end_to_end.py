"""End-to-end: check-ins + incidents -> features -> cut -> factorization -> aligned frames.

Stage outputs that later stages re-read many times (the kept matrix, the dense
features) are written to the shared checkpoint folder: lineage stays short and a
lost executor costs one stage, not the whole pipeline.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from regionpulse.config import PipelineConfig
from regionpulse import sources as src
from regionpulse.operators import clean
from regionpulse.operators import factorize as fz
from regionpulse.operators import features as feat
from regionpulse.operators import geo
from regionpulse.operators import grid
from regionpulse.operators import labels as lab
from regionpulse.plans.evaluate import evaluation_frame
from regionpulse.session import materialize


@dataclass
class DynamicFeatures:
    matrix: DataFrame        # kept sparse features (t, region, 5 features)
    dense: DataFrame         # factorized features, same cells
    labels: DataFrame        # (t, region, label), observed pairs
    aligned: DataFrame       # kept sparse features + label, on label intervals
    frame: DataFrame         # evaluation frame: label + s_* + d_* columns
    model: fz.FactorModel


def build(checkins: DataFrame, incidents: DataFrame, config: PipelineConfig = PipelineConfig(),
          method: str = "sgd") -> DynamicFeatures:
    # the matrix feeds the cut three times (rows, two totals): compute it once
    m = materialize(feat.feature_matrix(checkins, config), "feature-matrix")
    kept = materialize(grid.low_activity_filter(m, None, config.min_interval_obs, config.min_region_obs), "kept")
    dense, model = fz.dynamic_features(kept, config, method)
    dense = materialize(dense, "dense")
    labels = lab.binary_labels(lab.incident_counts(incidents, config.interval))
    aligned = lab.align_features_labels(kept, labels, config.quiet_intervals)
    frame = evaluation_frame(kept, dense, aligned)
    return DynamicFeatures(kept, dense, labels, aligned, frame, model)


def raw_to_labels(spark: SparkSession, checkins_path: str, incidents_path: str, regions: DataFrame, start: str, end: str, category: str | None,
                  config: PipelineConfig = PipelineConfig(), cell: float = 0.01) -> DataFrame:
    """From raw CSV to aligned features and labels: load, clean, place both kinds of events
    in their polygons, compute the five features on the dense grid and the labels, and
    join them: (t, region, <five features>, label)."""
    checkins = src.load_checkins(spark, checkins_path).withColumnRenamed("region", "_given").withColumnsRenamed({"longitude": "lon", "latitude": "lat"})
    incidents = clean.clean_incidents(src.load_incidents(spark, incidents_path), start, end, category).withColumnRenamed("region", "_given").withColumnsRenamed({"longitude": "lon", "latitude": "lat"})
    placed = geo.assign_region(checkins, regions, cell=cell)
    matrix = materialize(feat.feature_matrix(placed, config), "feature-matrix")
    labels = lab.binary_labels(lab.incident_counts(geo.assign_region(incidents, regions, cell=cell), config.interval))
    return lab.align_features_labels(matrix, labels, config.quiet_intervals)
