"""Scaling, detectors, vote and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    CONTAMINATION_CTE,
    DISTANCE,
    NUMERIC,
    FEATURES_CTE,
    ORDERS_CTE,
    PARAMS,
    POINTS_CTE,
    SPACE,
    adjusted_orders,
    derived,
    order_contamination,
    order_features,
    order_points,
    orders,
    price_index,
    query,
    table,
    thresholds_cte,
    train_of,
)
from spendguard.detectors.gmm import fit_gmm, fit_mixtures, score_gmm
from spendguard.detectors.iforest import fit_iforest, score_iforest
from spendguard.detectors.knn import knn_score, knn_scores
from spendguard.detectors.lof import lof_reference, lof_score
from spendguard.detectors.neighbors import knn_join, nearest, pack_blocks
from spendguard.detectors.ocsvm import GAP, fit_ocsvm, score_ocsvm
from spendguard.detectors.silhouette import amount_silhouette, silhouette
from spendguard.detectors.space import Space, apply_scaler, fit_buckets, fit_scaler
from spendguard.detectors.thresholds import ensemble, fit_threshold, flag_scores, minmax_scores, widen
from spendguard.operators import explain
from spendguard.plans import load_models, predict, run, save_models, score_records, single_category_forest
from spendguard.scratch import materialise, scratch_path


@query(
    "scaler",
    f"WITH {POINTS_CTE} SELECT category_key, n, "
    + ", ".join(f"round(mean_{c}, 6) AS mean_{c}, round(scale_{c}, 6) AS scale_{c}" for c in NUMERIC) + " FROM scaler",
)
def scaler(spark, sf_dir):
    found = fit_scaler(train_of(order_features(spark, sf_dir)), SPACE)
    return found.select("category_key", "n", *[F.round(c, 6).alias(c) for c in found.columns if c not in ("category_key", "n")])


@query(
    "bucket_weights",
    f"""WITH {POINTS_CTE} SELECT category_key, 'fav_bucket' AS feature, fav_bucket AS bucket, round(w_fav_bucket, 6) AS weight FROM w_fav_bucket
    UNION ALL SELECT category_key, 'cta_bucket', cta_bucket, round(w_cta_bucket, 6) FROM w_cta_bucket""",
)
def bucket_weights(spark, sf_dir):
    found = fit_buckets(train_of(order_features(spark, sf_dir)), SPACE)
    return found.select("category_key", "feature", "bucket", F.round("weight", 6).alias("weight"))


@query(
    "scaled_points",
    f"WITH {POINTS_CTE} SELECT record_id, category_key, "
    + ", ".join(f"round(z_{c}, 6) AS z_{c}" for c in NUMERIC)
    + ", fav_bucket, cta_bucket, round(w_fav, 6) AS w_fav_bucket, round(w_cta, 6) AS w_cta_bucket FROM pts",
)
def scaled_points(spark, sf_dir):
    found = order_points(spark, sf_dir).drop("split")
    keep = ("record_id", "category_key", "fav_bucket", "cta_bucket")
    return found.select(*[c if c in keep else F.round(c, 6).alias(c) for c in found.columns])


_K = 5
_NEAR = f"""{POINTS_CTE},
tt AS (SELECT q.category_key AS category_key, q.record_id AS record_id, min_by({{'n': r.record_id, 'd': {DISTANCE}}}, {DISTANCE}, {_K}) AS near
    FROM pts q JOIN pts r ON q.category_key = r.category_key AND r.split = 'train' AND q.record_id <> r.record_id WHERE q.split = 'train' GROUP BY ALL),
qt AS (SELECT q.category_key AS category_key, q.record_id AS record_id, min_by({{'n': r.record_id, 'd': {DISTANCE}}}, {DISTANCE}, {_K}) AS near
    FROM pts q JOIN pts r ON q.category_key = r.category_key AND r.split = 'train' WHERE q.split <> 'train' GROUP BY ALL)"""


@query(
    "knn_join",
    f"""WITH {_NEAR} SELECT category_key, record_id, CAST(i AS INTEGER) AS rank, near[i].n AS neighbor_id, round(near[i].d, 6) AS distance
    FROM qt, range(1, {_K + 1}) t(i)""",
)
def knn_edges(spark, sf_dir):
    points = order_points(spark, sf_dir)
    found = knn_join(points.where("split <> 'train'"), points.where("split = 'train'"), _K, SPACE)
    return found.withColumn("distance", F.round("distance", 6))


_VECTORS = Space(numeric=tuple(f"e{i}" for i in range(64)), buckets=(), sizes=(), names=())


@query(
    "knn_join_vectors",
    """WITH near AS (SELECT q.label AS label, q.vec_id AS record_id, min_by({'n': r.vec_id, 'd': array_distance(q.v, r.v)}, array_distance(q.v, r.v), 4) AS near
    FROM (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings) q JOIN (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings) r
    ON q.label = r.label AND q.vec_id <> r.vec_id GROUP BY ALL)
    SELECT label::VARCHAR AS category_key, record_id, CAST(i AS INTEGER) AS rank, near[i].n AS neighbor_id, round(near[i].d, 5) AS distance
    FROM near, range(1, 5) t(i) WHERE i <= len(near)""",
)
def knn_join_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("record_id"), F.col("label").cast("string").alias("category_key"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"z_e{i}") for i in range(64)],
    )
    found = knn_join(vectors, vectors, 4, _VECTORS, exclude_self=True)
    return found.withColumn("distance", F.round("distance", 5))


def _train_found(spark, sf_dir):
    def build():
        blocks = pack_blocks(order_points(spark, sf_dir).where("split = 'train'"), SPACE)
        return nearest(blocks, blocks, _K, SPACE, exclude_self=True)

    return derived(spark, sf_dir, "train_found", build)


def _query_found(spark, sf_dir):
    def build():
        points = order_points(spark, sf_dir)
        return nearest(
            pack_blocks(points.where("split <> 'train'"), SPACE), pack_blocks(points.where("split = 'train'"), SPACE), _K, SPACE
        )

    return derived(spark, sf_dir, "query_found", build)


_LOF = f"""{_NEAR},
kd AS (SELECT category_key, record_id, near[{_K}].d AS kd FROM tt),
te AS (SELECT category_key, record_id, unnest(near) AS e FROM tt), qe AS (SELECT category_key, record_id, unnest(near) AS e FROM qt),
lrd AS (SELECT te.record_id, 1 / (avg(greatest(e.d, kd)) + 1e-10) AS lrd FROM te JOIN kd ON kd.record_id = e.n GROUP BY ALL),
qlrd AS (SELECT qe.record_id, 1 / (avg(greatest(e.d, kd)) + 1e-10) AS lrd FROM qe JOIN kd ON kd.record_id = e.n GROUP BY ALL),
lof_t AS (SELECT te.category_key, te.record_id, avg(l.lrd) / any_value(o.lrd) AS score FROM te JOIN lrd l ON l.record_id = e.n JOIN lrd o ON o.record_id = te.record_id GROUP BY ALL),
lof_q AS (SELECT qe.category_key, qe.record_id, avg(l.lrd) / any_value(o.lrd) AS score FROM qe JOIN lrd l ON l.record_id = e.n JOIN qlrd o ON o.record_id = qe.record_id GROUP BY ALL)"""


@query("lof_train_scores", f"WITH {_LOF} SELECT category_key, record_id, round(score, 6) AS score FROM lof_t")
def lof_train_scores(spark, sf_dir):
    return lof_reference(_train_found(spark, sf_dir), [_K]).select(
        "category_key", "record_id", F.round(f"s_{_K}", 6).alias("score")
    )


def _neighbour_models(spark, sf_dir):
    """Raw scores of k-NN and LOF for training and new records, k fixed."""
    train, new = _train_found(spark, sf_dir), _query_found(spark, sf_dir)
    chosen = train.select("category_key").distinct().withColumn("best_k", F.lit(_K))
    reference = derived(spark, sf_dir, "lof_ref", lambda: lof_reference(train, [_K]))
    ref = reference.select(
        "category_key", "record_id", F.lit(_K).alias("best_k"), F.col(f"kd_{_K}").alias("k_distance"),
        F.col(f"lrd_{_K}").alias("density"),
    )
    named = lambda df, m: df.select("category_key", "record_id", F.lit(m).alias("model"), "score")
    fitted = named(knn_scores(train, [_K]).withColumnRenamed(f"s_{_K}", "score"), "knn").unionByName(
        named(reference.withColumnRenamed(f"s_{_K}", "score"), "lof")
    )
    scored = named(knn_score(new, chosen), "knn").unionByName(named(lof_score(new, ref), "lof"))
    return materialise(fitted, "nb_train"), materialise(scored, "nb_scored")


_LIMITS = f"""{_LOF},{CONTAMINATION_CTE},
raw_t AS (SELECT category_key, record_id, 'knn' AS model, near[{_K}].d AS score FROM tt UNION ALL SELECT category_key, record_id, 'lof', score FROM lof_t),
raw_q AS (SELECT category_key, record_id, 'knn' AS model, near[{_K}].d AS score FROM qt UNION ALL SELECT category_key, record_id, 'lof', score FROM lof_q),
{thresholds_cte('cuts', 'raw_t', 'category_key, model', 'score', 'threshold')},
lims AS (SELECT category_key, model, threshold, min(score) AS score_min, max(score) AS score_max FROM raw_t JOIN cuts USING (category_key, model) GROUP BY ALL)"""


@query(
    "score_thresholds",
    f"""WITH {_LIMITS} SELECT category_key, model, round(threshold, 6) AS threshold, round(score_min, 6) AS score_min,
    round(score_max, 6) AS score_max FROM lims""",
)
def score_thresholds(spark, sf_dir):
    fitted, _ = _neighbour_models(spark, sf_dir)
    found = fit_threshold(fitted, order_contamination(spark, sf_dir))
    return found.select("category_key", "model", *[F.round(c, 6).alias(c) for c in ("threshold", "score_min", "score_max")])


def _vote_sql(scale: str, need: str) -> str:
    return f"""WITH {_LIMITS},
    s AS (SELECT category_key, record_id, model, CAST(score > threshold AS INTEGER) AS flag, {scale} AS score
        FROM raw_q JOIN lims USING (category_key, model) WINDOW w AS (PARTITION BY category_key, model)),
    v AS (SELECT category_key, record_id, max(CASE WHEN model = 'knn' THEN flag END) AS anomaly_knn, max(CASE WHEN model = 'lof' THEN flag END) AS anomaly_lof,
        max(CASE WHEN model = 'knn' THEN score END) AS score_knn, max(CASE WHEN model = 'lof' THEN score END) AS score_lof FROM s GROUP BY ALL)
    SELECT category_key, record_id, anomaly_knn, anomaly_lof, round(score_knn, 5) AS score_knn, round(score_lof, 5) AS score_lof,
    CAST(anomaly_knn + anomaly_lof {need} AS INTEGER) AS ensemble_flag, round((score_knn + score_lof) / 2, 5) AS ensemble_score FROM v"""


def _vote(spark, sf_dir, frozen: bool, strategy: str):
    fitted, scored = _neighbour_models(spark, sf_dir)
    models = ("knn", "lof")
    limits = materialise(fit_threshold(fitted, order_contamination(spark, sf_dir)), "nb_limits")
    flagged = flag_scores(widen(scored, models), limits, models)
    out = ensemble(minmax_scores(flagged, models, limits if frozen else None), models, strategy)
    return out.select(
        "category_key", "record_id", "anomaly_knn", "anomaly_lof", F.round("score_knn", 5).alias("score_knn"),
        F.round("score_lof", 5).alias("score_lof"), "ensemble_flag", F.round("ensemble_score", 5).alias("ensemble_score"),
    )


@query(
    "neighbour_vote",
    _vote_sql("(score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w)", "= 2"),
)
def neighbour_vote(spark, sf_dir):
    return _vote(spark, sf_dir, False, "consensus")


@query(
    "neighbour_vote_frozen",
    _vote_sql("greatest(0.0, least(1.0, (score - score_min) / (score_max - score_min)))", ">= 1"),
)
def neighbour_vote_frozen(spark, sf_dir):
    return _vote(spark, sf_dir, True, "any")


@query(
    "silhouette",
    f"""WITH {POINTS_CTE}, l AS (SELECT *, CAST(z_valor_adjusted > 0 AS INTEGER) AS label FROM pts WHERE split = 'infer'),
    p AS (SELECT q.category_key AS category_key, q.record_id AS record_id, q.label AS a, r.label AS b, sum({DISTANCE}) AS s FROM l q JOIN l r ON q.category_key = r.category_key GROUP BY ALL),
    n AS (SELECT category_key, label, count(*) AS n FROM l GROUP BY ALL),
    m AS (SELECT p.category_key AS category_key, record_id, sum(CASE WHEN a = b THEN s / (n - 1) END) AS inside, sum(CASE WHEN a <> b THEN s / n END) AS outside
        FROM p JOIN n ON n.category_key = p.category_key AND n.label = p.b GROUP BY ALL)
    SELECT category_key, 0::INTEGER AS labelling, round(avg((outside - inside) / greatest(inside, outside)), 6) AS silhouette FROM m GROUP BY category_key""",
)
def silhouette_of_labels(spark, sf_dir):
    labelled = order_points(spark, sf_dir).where("split = 'infer'").withColumn(
        "labels", F.array((F.col("z_valor_adjusted") > 0).cast("int"))
    )
    return silhouette(labelled, SPACE).withColumn("silhouette", F.round("silhouette", 6))


_FLAT = Space(numeric=("valor_adjusted", "mean_value"), buckets=(), sizes=(), names=())


@query(
    "gaussian_log_density",
    f"""WITH {POINTS_CTE}, s AS (SELECT category_key, avg(z_valor_adjusted) AS mx, avg(z_mean_value) AS my, var_pop(z_valor_adjusted) + 1e-4 AS vx,
    var_pop(z_mean_value) + 1e-4 AS vy, covar_pop(z_valor_adjusted, z_mean_value) AS cxy FROM pts WHERE split = 'train' GROUP BY category_key)
    SELECT category_key, record_id, round(ln(2 * pi()) + 0.5 * ln(vx * vy - cxy * cxy) + 0.5 * (vy * pow(z_valor_adjusted - mx, 2)
    - 2 * cxy * (z_valor_adjusted - mx) * (z_mean_value - my) + vx * pow(z_mean_value - my, 2)) / (vx * vy - cxy * cxy), 6) AS score
    FROM pts JOIN s USING (category_key) WHERE split <> 'train'""",
)
def gaussian_log_density(spark, sf_dir):
    """A mixture with one component has a closed form, so fit and score can be compared."""
    params = PARAMS.with_(gmm_max_components=1)
    points = order_points(spark, sf_dir).select("record_id", "category_key", "split", *_FLAT.z)
    train = points.where("split = 'train'")
    empty = points.select("category_key").distinct().selectExpr(
        "category_key", "cast(null as string) feature", "cast(null as int) bucket", "0d share"
    )
    model = fit_gmm(train, empty, params, _FLAT)
    scored = score_gmm(points.where("split <> 'train'"), model, params, _FLAT)
    return scored.withColumn("score", F.round("score", 6))


# ── Model-based detectors: no SQL twin, checked against brute force in the tests ─────────────────────


def _split_points(spark, sf_dir):
    points = order_points(spark, sf_dir)
    return points.where("split = 'train'").drop("split"), points.where("split <> 'train'").drop("split")


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    train, new = _split_points(spark, sf_dir)
    return score_iforest(new, fit_iforest(train, PARAMS, SPACE), PARAMS, SPACE)


@query("gaussian_mixture")
def gaussian_mixture(spark, sf_dir):
    train, new = _split_points(spark, sf_dir)
    model = fit_gmm(train, fit_buckets(train_of(order_features(spark, sf_dir)), SPACE), PARAMS, SPACE)
    return score_gmm(new, model, PARAMS, SPACE)


@query(
    "mixture_sizes",
    f"""WITH {FEATURES_CTE} SELECT category_key, {PARAMS.gmm_max_components} AS n_sizes, count(*) AS n_rows, 0.0::DOUBLE AS bic_gap
    FROM feat WHERE split = 'train' GROUP BY category_key""",
)
def mixture_sizes(spark, sf_dir):
    """Every size is fitted to every training row, and the criterion follows from the stored log-likelihood."""
    train, _ = _split_points(spark, sf_dir)
    fitted = fit_mixtures(train, fit_buckets(train_of(order_features(spark, sf_dir)), SPACE), PARAMS, SPACE)
    d, k, n = SPACE.width, F.col("n_components").cast("double"), F.col("n_rows").cast("double")
    free = k * (1 + d + d * (d + 1) / 2) - 1
    gap = F.abs(F.col("bic") - (free * F.log(n) - 2 * n * F.col("log_likelihood"))) / F.greatest(F.abs("bic"), F.lit(1.0))
    return fitted.groupBy("category_key").agg(
        F.count_distinct("n_components").cast("int").alias("n_sizes"), F.min("n_rows").alias("n_rows"),
        F.round(F.max(gap), 9).alias("bic_gap"),
    )


@query("one_class_svm")
def one_class_svm(spark, sf_dir):
    train, new = _split_points(spark, sf_dir)
    return score_ocsvm(new, fit_ocsvm(train, PARAMS, SPACE), PARAMS, SPACE)


@query(
    "one_class_svm_gap",
    f"""WITH {FEATURES_CTE} SELECT category_key, count(*) AS n_rows, {PARAMS.ocsvm_nu}::DOUBLE AS share_above, TRUE AS gap_is_small
    FROM feat WHERE split = 'train' GROUP BY category_key""",
)
def one_class_svm_gap(spark, sf_dir):
    """Every category's vector is proven close to the best one, and its offset cuts off the wanted share of rows."""
    train, _ = _split_points(spark, sf_dir)
    model = fit_ocsvm(train, PARAMS, SPACE)
    squares = F.aggregate("weights", F.lit(0.0), lambda total, x: total + x * x)
    shares = score_ocsvm(train, model, PARAMS, SPACE).groupBy("category_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg((F.col("score") > 0).cast("double")), 2).alias("share_above")
    )
    return shares.join(model.select("category_key", (F.col("gap") <= GAP * squares).alias("gap_is_small")), "category_key")


_FULL = PARAMS.with_(include_sod=True)
_RUNS: dict[tuple, object] = {}


def full_run(spark, sf_dir):
    """Everything on `orders`, all six detectors; kept per application because many queries read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = run(orders(spark, sf_dir), price_index(spark), _FULL)
    return _RUNS[key]


@query("full_run_predictions")
def full_run_predictions(spark, sf_dir):
    return full_run(spark, sf_dir).predictions


@query(
    "full_run_vote",
    f"""WITH {FEATURES_CTE} SELECT category_key, count(*) AS n_records, 0::BIGINT AS wrong_votes, 0::BIGINT AS wrong_scores,
    0::BIGINT AS outside_range FROM feat WHERE split IN ('test', 'infer') GROUP BY category_key""",
)
def full_run_vote(spark, sf_dir):
    """A record is flagged if all six detectors flag it; its score is their mean; all scores lie in 0 to 1."""
    models = _FULL.active_detectors()
    votes, total = (sum((F.col(f"{p}_{m}") for m in models), F.lit(0)) for p in ("anomaly", "score"))
    inside = F.lit(True)
    for m in models:
        inside = inside & F.col(f"score_{m}").between(0, 1)
    return full_run(spark, sf_dir).predictions.groupBy("category_key").agg(
        F.count("*").alias("n_records"),
        F.count_if((votes == len(models)) != (F.col("ensemble_flag") == 1)).alias("wrong_votes"),
        F.count_if(F.abs(total / len(models) - F.col("ensemble_score")) > 1e-9).alias("wrong_scores"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside_range"),
    )


@query("full_run_metrics")
def full_run_metrics(spark, sf_dir):
    found = full_run(spark, sf_dir).metrics
    return found.select("category", "n_records", "n_flagged_ensemble", "flagged_pct", "iqr_baseline_pct", "reduction_factor")


@query("full_run_flagged")
def full_run_flagged(spark, sf_dir):
    return full_run(spark, sf_dir).flagged


@query("tree_attributions")
def tree_attributions(spark, sf_dir):
    """Attributions of the records that the forest alone flags."""
    done = full_run(spark, sf_dir)
    flagged = done.predictions.where("anomaly_iforest = 1")
    points = apply_scaler(flagged, done.models["scaler"], done.models["buckets"], SPACE)
    found = explain.explain(flagged, points, done.models["iforest"], done.models["buckets"], _FULL, SPACE)
    return explain.top_features(found)


@query("model_registry")
def model_registry(spark, sf_dir):
    return full_run(spark, sf_dir).models.registry().withColumn("models", F.array_join("models", ","))


@query("models_saved_and_loaded")
def models_saved_and_loaded(spark, sf_dir):
    """Predictions with models written to disk and read back."""
    done = full_run(spark, sf_dir)
    path = scratch_path(spark, "saved_models")
    save_models(done.models, path)
    loaded = load_models(spark, path, done.models.params)
    return predict(done.features.where("split <> 'train'"), loaded).select(
        "category_key", "record_id", "ensemble_flag", F.round("ensemble_score", 6).alias("ensemble_score")
    )


def scoring_input(spark, sf_dir):
    """All orders as new records; every seventh category name is unknown."""
    rows = orders(spark, sf_dir).drop("is_reversal", "year")
    return rows.withColumn("verba", F.when(F.col("record_id") % 7 == 0, "UNSEEN").otherwise(F.col("verba")))


@query("score_records")
def score_new_records(spark, sf_dir):
    models = full_run(spark, sf_dir).models
    scored = score_records(scoring_input(spark, sf_dir), price_index(spark), models["group_means"], models)
    return scored.select("record_id", "category_key", "ensemble_flag", F.round("ensemble_score", 6).alias("ensemble_score"), "error")


@query("forest_with_fewer_features")
def forest_with_fewer_features(spark, sf_dir):
    """The single-detector variant: one forest on amount and spender mean, positive amounts only."""
    train, new = _split_points(spark, sf_dir)
    return score_iforest(new, fit_iforest(train, PARAMS, _FLAT), PARAMS, _FLAT)


@query("single_category_forest")
def single_category(spark, sf_dir):
    """One order priority with one-hot encoded status, principal components and a forest."""
    rows = adjusted_orders(spark, sf_dir)
    found = single_category_forest(rows, F.col("verba") == "5-LOW", PARAMS, k=4)
    return found.select("record_id", F.round("score", 8).alias("score"), "anomaly")


@query(
    "amount_silhouette",
    f"""WITH {ORDERS_CTE}, l AS (SELECT verba, valor, CAST(valor > 30000 AS INTEGER) AS label FROM adj),
    s AS (SELECT verba, label, valor, count(*) OVER c AS n, sum(valor) OVER c AS t,
        count(*) OVER (PARTITION BY verba) AS n_all, sum(valor) OVER (PARTITION BY verba) AS t_all,
        count(*) OVER o AS k, sum(valor) OVER o AS u, count(*) OVER a AS k_all, sum(valor) OVER a AS u_all
        FROM l WINDOW c AS (PARTITION BY verba, label), o AS (PARTITION BY verba, label ORDER BY valor), a AS (PARTITION BY verba ORDER BY valor)),
    d AS (SELECT verba, n, n_all - n AS m, valor * k - u + (t - u) - valor * (n - k) AS inside,
        valor * k_all - u_all + (t_all - u_all) - valor * (n_all - k_all) AS every FROM s),
    w AS (SELECT verba, inside / (n - 1) AS a, (every - inside) / m AS b FROM d)
    SELECT verba, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM w GROUP BY verba""",
)
def amount_silhouette_of_orders(spark, sf_dir):
    labelled = adjusted_orders(spark, sf_dir).withColumn("label", (F.col("valor") > 30000).cast("int"))
    return amount_silhouette(labelled, "valor", "label", ["verba"]).withColumn("silhouette", F.round("silhouette", 6))
