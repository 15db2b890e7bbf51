"""Registered queries: each callable takes (spark, sf_dir) and returns a DataFrame.

The result is lazy; queries whose operators write shared stages or fit models run those
jobs when they are called.

Doubles in the outputs are rounded to 6 places so that results compare exactly with
the SQL oracles (summation order differs between engines).
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionpulse.config import PipelineConfig
from regionpulse.operators import features as feat
from regionpulse.operators import grid
from regionpulse.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# thresholds for the low-activity cut on the events fixture (fixed for the SQL check)
FIXTURE_MIN_INTERVAL_OBS = 26
FIXTURE_MIN_REGION_OBS = 775


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _binned(spark, sf_dir, interval="3 hours"):
    return feat.binned_checkins(td.event_checkins(spark, sf_dir), interval)


# ---------------------------------------------------------------- grid & features

@register("interval_spine")
def q_interval_spine(spark, sf_dir):
    return grid.interval_spine(td.event_checkins(spark, sf_dir), "ts", "3 hours")


@register("obs_freq")
def q_obs_freq(spark, sf_dir):
    return feat.obs_freq(_binned(spark, sf_dir))


@register("visitor_count")
def q_visitor_count(spark, sf_dir):
    return feat.visitor_count(_binned(spark, sf_dir))


@register("user_cell_visits")
def q_user_cell_visits(spark, sf_dir):
    return feat.user_cell_visits(_binned(spark, sf_dir)).drop("n_rows")


@register("user_totals")
def q_user_totals(spark, sf_dir):
    return feat.user_totals(_binned(spark, sf_dir))


@register("visit_probability")
def q_visit_probability(spark, sf_dir):
    p = feat.visit_probability(_binned(spark, sf_dir))
    return rounded(p.select("t", "region", "user_id", "reg_time_visits", "total_visits", "probability"))


@register("visitor_entropy")
def q_visitor_entropy(spark, sf_dir):
    return rounded(feat.visitor_entropy(_binned(spark, sf_dir)))


@register("region_popularity")
def q_region_popularity(spark, sf_dir):
    return rounded(feat.region_popularity(feat.obs_freq(_binned(spark, sf_dir))))


@register("user_venue_count")
def q_user_venue_count(spark, sf_dir):
    return feat.user_venue_count(_binned(spark, sf_dir))


@register("top_venues")
def q_top_venues(spark, sf_dir):
    return feat.top_venues(feat.user_venue_count(_binned(spark, sf_dir)), 4)


@register("first_visits")
def q_first_visits(spark, sf_dir):
    return feat.first_visits(_binned(spark, sf_dir), 4)


@register("visitor_ratio")
def q_visitor_ratio(spark, sf_dir):
    return rounded(feat.visitor_ratio(_binned(spark, sf_dir), 4))


@register("densify_grid")
def q_densify_grid(spark, sf_dir):
    b = _binned(spark, sf_dir)
    g = grid.grid_of(b.select("region"), b)
    return grid.densify_grid(feat.obs_freq(b), g, ["obs_freq"])


@register("feature_matrix")
def q_feature_matrix(spark, sf_dir):
    return rounded(feat.feature_matrix(td.event_checkins(spark, sf_dir)))


@register("feature_matrix_nations")
def q_feature_matrix_nations(spark, sf_dir):
    """Scale fixture: lineitem check-ins in 25 nation regions, weekly bins."""
    cfg = PipelineConfig(interval="7 days")
    return rounded(feat.feature_matrix(td.lineitem_checkins(spark, sf_dir), cfg))


@register("low_activity_filter")
def q_low_activity_filter(spark, sf_dir):
    return rounded(_kept_matrix(spark, sf_dir))


@register("feature_pivot")
def q_feature_pivot(spark, sf_dir):
    regions = grid.region_list(td.event_checkins(spark, sf_dir))
    return grid.feature_pivot(feat.obs_freq(_binned(spark, sf_dir)), regions, "obs_freq", fill=0)


@register("region_one_hot")
def q_region_one_hot(spark, sf_dir):
    ck = td.event_checkins(spark, sf_dir).select("seq", "region")
    regions = grid.region_list(ck)
    return grid.region_one_hot(ck, regions)


# ---------------------------------------------------------------- cleaning & IO

from regionpulse.operators import clean as cln  # noqa: E402
from regionpulse.operators import geo  # noqa: E402
from regionpulse.operators import labels as lab  # noqa: E402
from regionpulse.operators import measures as ms  # noqa: E402
from regionpulse import sources as src  # noqa: E402
from regionpulse.session import files_exist, materialize, scratch_path  # noqa: E402

# inclusive date range and offence used by the cleaning queries
RANGE_START, RANGE_END = "2024-01-05", "2024-01-20"
CATEGORY = "GRAND LARCENY"


def incident_text(spark, sf_dir):
    """Raw incident text rows derived from 'error' events by a fixed rule: a value
    below 1 gets an impossible date, above 300 the time '24:00:00'; value > 50 is
    the kept offence."""
    ev = td.table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(
        F.col("event_id").alias("incident_id"),
        F.when(F.col("value") < 1, F.lit("13/13/2012")).otherwise(F.date_format("ts", "MM/dd/yyyy")).alias("date_text"),
        F.when(F.col("value") > 300, F.lit("24:00:00")).otherwise(F.date_format("ts", "HH:mm:ss")).alias("time_text"),
        F.when(F.col("value") > 50, F.lit(CATEGORY)).otherwise(F.lit("PETIT LARCENY")).alias("offense"),
        F.concat(F.lit("r"), (k % 10).cast("string")).alias("region"),
    )


@register("parse_incident_time")
def q_parse_incident_time(spark, sf_dir):
    p = cln.parse_incident_time(incident_text(spark, sf_dir))
    return p.select("incident_id", "ts", "offense", "region")


@register("filter_date_range")
def q_filter_date_range(spark, sf_dir):
    ck = td.event_checkins(spark, sf_dir)
    return cln.filter_date_range(ck, RANGE_START, RANGE_END).orderBy("ts", "seq")


@register("filter_category")
def q_filter_category(spark, sf_dir):
    return cln.filter_category(incident_text(spark, sf_dir), CATEGORY).select("incident_id", "offense", "region")


@register("load_incidents")
def q_load_incidents(spark, sf_dir):
    path = scratch_path(spark, "incidents-csv")
    src.write_csv(incident_text(spark, sf_dir), path)
    raw = src.load_incidents(spark, path, "incident_id BIGINT, date_text STRING, time_text STRING, offense STRING, region STRING")
    c = cln.clean_incidents(raw, RANGE_START, RANGE_END, CATEGORY)
    return c.select("incident_id", "ts", "offense", "region")


@register("load_checkins")
def q_load_checkins(spark, sf_dir):
    path = scratch_path(spark, "checkins-csv")
    src.write_csv(td.event_checkins(spark, sf_dir), path)
    return src.load_checkins(spark, path, "user_id BIGINT, venue_id BIGINT, region STRING, ts TIMESTAMP_NTZ, seq BIGINT")


@register("load_checkin_points")
def q_load_checkin_points(spark, sf_dir):
    """PF4: check-ins with coordinates (derived from the venue), written with the columns in
    another order, read back by header with their (lon, lat) points."""
    path = scratch_path(spark, "checkin-points-csv")
    ck = td.event_checkins(spark, sf_dir)
    lon, lat = (F.col("venue_id") % 10) / 4.0 - 0.5, F.col("venue_id") / 64.0 - 0.75
    src.write_csv(ck.select(lat.alias("latitude"), "ts", lon.alias("longitude"), F.concat(F.lit("v"), "venue_id").alias("venue_id"), "seq", "region", "user_id"), path)
    df = src.load_checkins(spark, path)
    return df.select("seq", "user_id", "venue_id", "ts", F.col("point.lon").alias("lon"), F.col("point.lat").alias("lat"))


@register("roundtrip_checkins")
def q_roundtrip_checkins(spark, sf_dir):
    path = scratch_path(spark, "checkins-parquet")
    ck = td.event_checkins(spark, sf_dir).withColumn("date", F.to_date("ts"))
    src.write_table(ck, path, partition_by=["date"])
    return src.read_table(spark, path).select("user_id", "venue_id", "region", "ts", "seq")


@register("roundtrip_labels")
def q_roundtrip_labels(spark, sf_dir):
    path = scratch_path(spark, "labels-parquet")
    labels = lab.binary_labels(lab.incident_counts(td.event_incidents(spark, sf_dir)))
    src.write_table(labels, path)
    return src.read_table(spark, path)


# ---------------------------------------------------------------- labels

def _labels(spark, sf_dir):
    return lab.binary_labels(lab.incident_counts(td.event_incidents(spark, sf_dir)))


def _kept_matrix(spark, sf_dir):
    """Feature matrix after the low-activity cut.  The matrix is written once: the cut
    reads it three times and the label/factorization queries read the result again."""
    m = materialize(feat.feature_matrix(td.event_checkins(spark, sf_dir)), "feature-matrix")
    return grid.low_activity_filter(m, None, FIXTURE_MIN_INTERVAL_OBS, FIXTURE_MIN_REGION_OBS)


@register("incident_counts")
def q_incident_counts(spark, sf_dir):
    return lab.incident_counts(td.event_incidents(spark, sf_dir))


@register("binary_labels")
def q_binary_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


@register("align_features_labels")
def q_align_features_labels(spark, sf_dir):
    return rounded(lab.align_features_labels(_kept_matrix(spark, sf_dir), _labels(spark, sf_dir)))


@register("percent_labeled")
def q_percent_labeled(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    aligned = lab.align_features_labels(_kept_matrix(spark, sf_dir), labels)
    return rounded(lab.percent_labeled(aligned, labels))


@register("class_frequency")
def q_class_frequency(spark, sf_dir):
    aligned = lab.align_features_labels(_kept_matrix(spark, sf_dir), _labels(spark, sf_dir))
    return lab.class_frequency(aligned)


# ---------------------------------------------------------------- geo

GEO_CELL = 0.05
EXCLUDED_COUNTIES = ("4",)
CORRECTIONS = [("ALGERIA", "0", "drop", None), ("BRAZIL", "1", "rename", "BRAZIL SOUTH")]


@register("assign_region")
def q_assign_region(spark, sf_dir):
    pts = td.embedding_points(spark, sf_dir)
    polys = td.nation_polygons(spark, sf_dir)
    return geo.assign_region(pts, polys, cell=GEO_CELL).select("point_id", "lon", "lat", "region_id", "region")


@register("filter_regions")
def q_filter_regions(spark, sf_dir):
    polys = td.nation_polygons(spark, sf_dir)
    return geo.filter_regions(polys, "World", EXCLUDED_COUNTIES).select("region_id", "name", "county", "city")


@register("apply_region_corrections")
def q_apply_region_corrections(spark, sf_dir):
    polys = td.nation_polygons(spark, sf_dir)
    return geo.apply_region_corrections(polys, CORRECTIONS).select("region_id", "name", "county")


@register("duplicate_regions")
def q_duplicate_regions(spark, sf_dir):
    """Polygons named after their TPC-H region: five names over 25 polygons."""
    polys = td.nation_polygons(spark, sf_dir)
    names = td.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("county"), "r_name")
    renamed = polys.join(names, "county").select("region_id", F.col("r_name").alias("name"))
    return geo.duplicate_regions(renamed)


@register("load_regions")
def q_load_regions(spark, sf_dir):
    path = scratch_path(spark, "regions-geojson")
    polys = td.nation_polygons(spark, sf_dir)
    coords = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    geom = F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))
    polys.select("region_id", F.col("name").alias("Name"), F.col("county").alias("County"),
                 F.col("city").alias("City"), geom.alias("geometry")).write.parquet(path)
    r = src.load_regions(spark, path)
    flat = F.flatten("rings")
    return r.select(
        "region_id", "name", "county", "city",
        F.size("rings").alias("n_rings"), F.size(flat).alias("n_vertices"),
        F.aggregate(flat, F.lit(0.0), lambda a, p: a + p["lon"]).alias("sum_lon"),
        F.aggregate(flat, F.lit(0.0), lambda a, p: a + p["lat"]).alias("sum_lat"),
    ).transform(rounded)


# ---------------------------------------------------------------- measures

@register("area_incident_density")
def q_area_incident_density(spark, sf_dir):
    d = ms.area_incident_density(td.event_incidents(spark, sf_dir), td.region_attributes(spark, sf_dir), 7)
    return rounded(d.withColumn("day", F.col("day").cast("timestamp_ntz")))


@register("population_incident_density")
def q_population_incident_density(spark, sf_dir):
    d = ms.population_incident_density(td.event_incidents(spark, sf_dir), td.region_attributes(spark, sf_dir), 7)
    return rounded(d.withColumn("day", F.col("day").cast("timestamp_ntz")))


@register("venue_category_share")
def q_venue_category_share(spark, sf_dir):
    return rounded(ms.venue_category_share(td.event_venues(spark, sf_dir)))


@register("venue_category_density")
def q_venue_category_density(spark, sf_dir):
    return rounded(ms.venue_category_density(td.event_venues(spark, sf_dir), td.region_attributes(spark, sf_dir)))


@register("regional_diversity")
def q_regional_diversity(spark, sf_dir):
    return rounded(ms.regional_diversity(ms.venue_category_share(td.event_venues(spark, sf_dir))))


@register("visitor_count_overall")
def q_visitor_count_overall(spark, sf_dir):
    return ms.visitor_count_overall(td.event_checkins(spark, sf_dir))


@register("region_cosine")
def q_region_cosine(spark, sf_dir):
    """Cosine of the obs_freq time series of each region and the next region by name."""
    obs = feat.obs_freq(_binned(spark, sf_dir)).withColumnRenamed("obs_freq", "value")
    regs = obs.select("region").distinct()
    from pyspark.sql import Window

    # the distinct region list is small (one row per region): an unpartitioned lead is fine
    pairs = regs.select(
        F.col("region").alias("region_a"), F.lead("region").over(Window.orderBy("region")).alias("region_b")
    ).filter(F.col("region_b").isNotNull())
    return rounded(ms.region_cosine(obs, pairs))


@register("vector_cosine")
def q_vector_cosine(spark, sf_dir):
    """Cosine of each embedding with the next vec_id's embedding."""
    e = td.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), "embedding")
    return rounded(ms.vector_cosine(e, nxt, "vec_id"))


# ---------------------------------------------------------------- factorization

from regionpulse.operators import factorize as fz  # noqa: E402
from regionpulse.operators import metrics as mt  # noqa: E402
from regionpulse.operators import sampling as sp  # noqa: E402

GIVEN_RANK = 4
GIVEN_BETA = 0.001


def given_factors(rows: DataFrame, cols: DataFrame, k: int = GIVEN_RANK) -> DataFrame:
    """Factors fixed by a rule of the ids, to check prediction and cost exactly:
    P_i[k] = ((7i + 3k) % 11 - 5) / 10, b_i = (i % 5 - 2) / 10,
    Q_j[k] = ((5j + 2k) % 13 - 6) / 10, b_j = (j % 3 - 1) / 10."""
    ks = F.sequence(F.lit(0), F.lit(k - 1))
    p = rows.select(
        F.lit("P").alias("side"), F.col("i").alias("id"),
        ((F.col("i") % 5 - 2) / 10.0).alias("bias"),
        F.transform(ks, lambda x: ((F.col("i") * 7 + x * 3) % 11 - 5) / 10.0).alias("factors"),
    )
    q = cols.select(
        F.lit("Q").alias("side"), F.col("j").alias("id"),
        ((F.col("j") % 3 - 1) / 10.0).alias("bias"),
        F.transform(ks, lambda x: ((F.col("j") * 5 + x * 2) % 13 - 6) / 10.0).alias("factors"),
    )
    return p.unionByName(q)


def _coo(spark, sf_dir):
    return fz.sparse_cells(_materialized_matrix(spark, sf_dir))


@register("sparse_cells")
def q_sparse_cells(spark, sf_dir):
    coo, rows, cols = _coo(spark, sf_dir)
    return rounded(coo.join(rows, "i").join(cols, "j").select("i", "j", "t", "feature", "region", "value"))


@register("nonzero_mean")
def q_nonzero_mean(spark, sf_dir):
    coo, _, _ = _coo(spark, sf_dir)
    return rounded(fz.nonzero_mean(coo))


@register("predict_cells")
def q_predict_cells(spark, sf_dir):
    coo, rows, cols = _coo(spark, sf_dir)
    mean = fz.nonzero_mean(coo).select("mean").scalar()
    return rounded(fz.predict_cells(coo, given_factors(rows, cols), mean))


@register("dense_matrix")
def q_dense_matrix(spark, sf_dir):
    m = _materialized_matrix(spark, sf_dir)
    coo, rows, cols = fz.sparse_cells(m)
    mean = fz.nonzero_mean(coo).select("mean").scalar()
    return rounded(fz.dense_matrix(m, given_factors(rows, cols), mean, rows, cols))


@register("fit_error")
def q_fit_error(spark, sf_dir):
    coo, rows, cols = _coo(spark, sf_dir)
    mean = fz.nonzero_mean(coo).select("mean").scalar()
    return rounded(fz.fit_error(coo, given_factors(rows, cols), mean, GIVEN_BETA))


@register("sgd_epoch")
def q_sgd_epoch(spark, sf_dir):
    """MF2, MF4: one epoch over all cells in (row, column) order, from the factors of the rule."""
    coo, rows, cols = _coo(spark, sf_dir)
    config = PipelineConfig(rank=GIVEN_RANK, epochs=1, blocks=1, learning_rate=0.01, regularization=0.05)
    fitted = fz.densify_sgd(coo, rows, cols, config, track_history=False, shuffle=False, init=given_factors(rows, cols)).factors
    return rounded(fitted.select("side", "id", "bias", *[F.get("factors", F.lit(k)).alias(f"f{k}") for k in range(GIVEN_RANK)]))


@register("history_given")
def q_history_given(spark, sf_dir):
    """MF8: the cost after one epoch from the factors of the rule."""
    coo, rows, cols = _coo(spark, sf_dir)
    config = PipelineConfig(rank=GIVEN_RANK, epochs=1, blocks=1, learning_rate=0.01, regularization=0.05)
    return rounded(fz.densify_sgd(coo, rows, cols, config, shuffle=False, init=given_factors(rows, cols)).history, 5)


@register("matrix_shape")
def q_matrix_shape(spark, sf_dir):
    return fz.matrix_shape(_kept_matrix(spark, sf_dir), 250)


def _materialized_matrix(spark, sf_dir):
    return materialize(_kept_matrix(spark, sf_dir), "kept-matrix")


@register("densify_sgd")
def q_densify_sgd(spark, sf_dir):
    """The reference run: K=250, alpha=beta=0.001, 20 epochs, dense (t, region, 5 features)."""
    dense, _ = fz.dynamic_features(_materialized_matrix(spark, sf_dir), PipelineConfig(), "sgd")
    return dense


@register("training_history")
def q_training_history(spark, sf_dir):
    m = _materialized_matrix(spark, sf_dir)
    coo, rows, cols = fz.sparse_cells(m)
    return fz.densify_sgd(coo, rows, cols, PipelineConfig()).history


@register("densify_als")
def q_densify_als(spark, sf_dir):
    dense, _ = fz.dynamic_features(_materialized_matrix(spark, sf_dir), PipelineConfig(rank=10), "als")
    return dense


# ---------------------------------------------------------------- sampling & metrics

def _aligned(spark, sf_dir):
    return lab.align_features_labels(_kept_matrix(spark, sf_dir), _labels(spark, sf_dir))


@register("undersample")
def q_undersample(spark, sf_dir):
    return sp.undersample(_aligned(spark, sf_dir), seed=0).select("t", "region", "label")


@register("train_test_split")
def q_train_test_split(spark, sf_dir):
    s = sp.undersample(_aligned(spark, sf_dir), seed=0)
    return sp.train_test_split(s, test_fraction=0.3, seed=0).select("t", "region", "label", "is_test")


@register("cv_folds")
def q_cv_folds(spark, sf_dir):
    s = sp.undersample(_aligned(spark, sf_dir), seed=0)
    return sp.cv_folds(s, 5).select("t", "region", "label", "fold")


@register("standardize")
def q_standardize(spark, sf_dir):
    from regionpulse.config import FEATURES

    s = sp.undersample(_aligned(spark, sf_dir), seed=0)
    z = sp.standardize(s, FEATURES, suffix="_z")
    return rounded(z.select("t", "region", *[f"{f}_z" for f in FEATURES]))


def _doc_scores(spark, sf_dir):
    lb = td.table(spark, sf_dir, "labels")
    docs = td.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lb.join(docs, "doc_id").select("doc_id", "toxic", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    return rounded(mt.roc_auc(_doc_scores(spark, sf_dir), "score", "label", ["toxic"]))


@register("cv_auc")
def q_cv_auc(spark, sf_dir):
    """ML4: five folds by document id, on a score fixed by a rule."""
    folded = _doc_scores(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    return rounded(mt.cv_auc(folded, "score", "label", "fold", ["toxic"]))


@register("threshold_scores")
def q_threshold_scores(spark, sf_dir):
    return mt.threshold_scores(_doc_scores(spark, sf_dir), "score", 2000.0).select("doc_id", "prediction")


@register("f1_accuracy")
def q_f1_accuracy(spark, sf_dir):
    pred = mt.threshold_scores(_doc_scores(spark, sf_dir), "score", 2000.0)
    return rounded(mt.f1_accuracy(pred, "prediction", "label", ["toxic"]))


# ---------------------------------------------------------------- models & evaluation

from regionpulse.operators import models as md  # noqa: E402
from regionpulse.plans import evaluate as ev  # noqa: E402
from regionpulse.plans import end_to_end as pl  # noqa: E402

# the network's fits have a few hundred rows each here: one training partition
FIXTURE_CONFIG = PipelineConfig(min_interval_obs=FIXTURE_MIN_INTERVAL_OBS, min_region_obs=FIXTURE_MIN_REGION_OBS, train_partitions=1)


_BUILT: dict = {}
_BUILDING = threading.Lock()


def _dynamic(spark, sf_dir, config=FIXTURE_CONFIG):
    """The end-to-end build, shared by the model queries of one Spark application while
    their input files stay the same (path, size and modification time); only the last one
    is remembered.  Its stages are written tables, so later queries read them instead of
    factorizing again, as long as all their files are there.  Queries of several threads wait
    for one build."""
    files = td.table(spark, sf_dir, "events").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, tuple(state), config)
    with _BUILDING:
        built = _BUILT.get(key)
        if built is None or not files_exist(spark, built.frame.inputFiles()):
            _BUILT.clear()
            built = _BUILT[key] = pl.build(td.event_checkins(spark, sf_dir), td.event_incidents(spark, sf_dir), config)
        return built


@register("raw_to_labels")
def q_raw_to_labels(spark, sf_dir):
    """Raw CSV to aligned features and labels; each venue number k has a fixed point."""
    def with_point(df, k):
        return df.withColumn("longitude", (k * 37 % 100) / 100.0 - 0.497).withColumn("latitude", (k * 53 % 100) / 100.0 - 0.497)

    ck_path, inc_path = scratch_path(spark, "raw-checkins"), scratch_path(spark, "raw-incidents")
    ck = td.event_checkins(spark, sf_dir)
    src.write_csv(with_point(ck.withColumn("region", F.lit("?")), F.col("venue_id")), ck_path)
    k = td.table(spark, sf_dir, "events").select(F.col("event_id").alias("incident_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    src.write_csv(with_point(incident_text(spark, sf_dir).withColumn("region", F.lit("?")).join(k, "incident_id"), F.col("k")), inc_path)
    polys = td.nation_polygons(spark, sf_dir)
    return rounded(pl.raw_to_labels(spark, ck_path, inc_path, polys, RANGE_START, RANGE_END, CATEGORY, cell=GEO_CELL))


@register("dynamic_features")
def q_dynamic_features(spark, sf_dir):
    """Dense features aligned with labels (the input of the model comparison)."""
    d = _dynamic(spark, sf_dir)
    return d.frame


def _given_frame(spark, sf_dir):
    m = _materialized_matrix(spark, sf_dir)
    coo, rows, cols = fz.sparse_cells(m)
    dense = fz.dense_matrix(m, given_factors(rows, cols), fz.nonzero_mean(coo).select("mean").scalar(), rows, cols)
    return ev.evaluation_frame(m, dense, lab.align_features_labels(m, _labels(spark, sf_dir)))


@register("given_features")
def q_given_features(spark, sf_dir):
    """MF10: sparse and dense features side by side with the labels, on the factors of the rule."""
    return rounded(_given_frame(spark, sf_dir))


@register("model_table")
def q_model_table(spark, sf_dir):
    """IO6: the dense features of the rule's factors written as a model table and read back."""
    from pyspark.ml.functions import vector_to_array

    from regionpulse.config import FEATURES

    path = scratch_path(spark, "model-table")
    _given_frame(spark, sf_dir).select(*[F.col(f"d_{f}").alias(f) for f in FEATURES], F.col("label").alias("crime")).write.parquet(path)
    t = src.load_model_table(spark, path, "crime").select(vector_to_array("features").alias("x"), "label")
    return rounded(t.select(*[F.get("x", F.lit(k)).alias(f) for k, f in enumerate(FEATURES)], "label"))


@register("report_given")
def q_report_given(spark, sf_dir):
    """ML14 on given metrics: each region's mean features stand for the metrics of its two feature sets."""
    frame = _given_frame(spark, sf_dir)
    metrics = {"cv_mean": "visitor_entropy", "auc": "visitor_ratio", "f1": "region_popularity", "accuracy": "visitor_count"}
    sets = [frame.groupBy("region").agg(*[F.avg(f"{p}_{f}").alias(m) for m, f in metrics.items()])
            .select("region", F.lit("rule").alias("model"), F.lit(name).alias("feature_set"), F.lit(False).alias("scaled"), *metrics) for name, p in (("sparse", "s"), ("dynamic", "d"))]
    return rounded(ev.comparison_report(sets[0].union(sets[1])))


@register("region_panel")
def q_region_panel(spark, sf_dir):
    """PF19: one region's rows of the aligned matrix (first kept region by name)."""
    aligned = _aligned(spark, sf_dir)
    first = aligned.agg(F.min("region").alias("r")).select("r").scalar()
    return rounded(aligned.filter(F.col("region") == first))


def _eval_model(model):
    def q(spark, sf_dir):
        d = _dynamic(spark, sf_dir)
        return ev.evaluate_region(d.frame, None, FIXTURE_CONFIG, [model])
    q.__name__ = f"q_eval_{model}"
    return q


for _m in md.MODELS:
    register(f"eval_{_m}")(_eval_model(_m))


@register("evaluate_region")
def q_evaluate_region(spark, sf_dir):
    d = _dynamic(spark, sf_dir)
    region = d.frame.agg(F.min("region")).first()[0]
    return ev.evaluate_region(d.frame, region, FIXTURE_CONFIG)


@register("evaluate_regions")
def q_evaluate_regions(spark, sf_dir):
    """Every region in one call: logistic regression, SVM and forest of all regions train together."""
    return ev.evaluate_regions(_dynamic(spark, sf_dir).frame, FIXTURE_CONFIG, ["lr", "svm", "rf"])


@register("repeat_evaluation")
def q_repeat_evaluation(spark, sf_dir):
    """The reference experiment: one region, the average of 14 runs, which train together."""
    d = _dynamic(spark, sf_dir)
    region = d.frame.agg(F.min("region")).first()[0]
    return ev.repeat_evaluation(d.frame, region, 14, FIXTURE_CONFIG, ["lr", "svm", "rf"])


@register("comparison_report")
def q_comparison_report(spark, sf_dir):
    """Every region of the table, with all four models."""
    return ev.comparison_report(ev.evaluate_each_region(_dynamic(spark, sf_dir).frame, FIXTURE_CONFIG))


@register("logistic_regions")
def q_logistic_regions(spark, sf_dir):
    """ML6 for all regions, folds and the test split at once: ten Newton steps on the
    standardised sparse features."""
    from regionpulse.operators import batched as bt

    sample = ev.sample_runs(_aligned(spark, sf_dir), PipelineConfig(), [0])
    rows = bt.fit_rows(sample, 5, scaled=[True], sets=[("sparse", "")])
    betas = bt.logistic(rows.filter("not held_out"), iterations=10, tolerance=None)
    return rounded(betas.select("region", "fold", *[F.get("beta", F.lit(k)).alias(f"beta{k}") for k in range(6)]), 5)


@register("load_model_table")
def q_load_model_table(spark, sf_dir):
    """IO6: the aligned dense features written as a model table and read back."""
    from regionpulse.config import FEATURES

    d = _dynamic(spark, sf_dir)
    path = scratch_path(spark, "model-table")
    d.frame.select(*[F.col(f"d_{f}").alias(f) for f in FEATURES], F.col("label").alias("crime")).write.parquet(path)
    from pyspark.ml.functions import vector_to_array

    t = src.load_model_table(spark, path, "crime")
    return t.select(vector_to_array("features").alias("features"), "label")


@register("preview_features")
def q_preview_features(spark, sf_dir):
    """WN5: the first rows of the feature matrix in (t, region) order (the limit is the feature)."""
    m = feat.feature_matrix(td.event_checkins(spark, sf_dir))
    return rounded(m.orderBy("t", "region").limit(5))


# ---------------------------------------------------------------- streaming

@register("streaming_obs_freq")
def q_streaming_obs_freq(spark, sf_dir):
    """obs_freq per 3-hour bin, computed incrementally: the events table is read as a file
    stream and aggregated with a watermark; every change of a bin is upserted (with a
    checkpoint, so a restart is exactly-once), so the bins still open at the end of the
    input are there too."""
    from regionpulse import streaming as st

    schema = td.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    agg = st.streaming_cell_counts(td.checkins_of_events(stream), "3 hours", watermark="6 hours")
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    st.upsert_stream_to_table(agg, out, ckpt).awaitTermination()
    return st.latest_bins(spark, out).select("t", "region", "obs_freq")
