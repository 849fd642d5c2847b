"""Contamination, metrics, profiles and distributions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from checks.base import (
    CONTAMINATION_CTE,
    FEATURES_CTE,
    LINEITEM_CTE,
    ORDERS_CTE,
    PANEL,
    PANEL_CTE,
    PARAMS,
    adjusted_lineitems,
    adjusted_orders,
    order_contamination,
    order_features,
    order_panel,
    query,
    table,
)
from spendguard.detectors.thresholds import iqr_fences, outside_fences
from spendguard.functions import audit_score, category_key
from spendguard.operators import features, metrics, profile, stats
from spendguard.operators.quantiles import exact_quantiles
from spendguard.operators.rank import top_per_category
from spendguard.operators.summaries import QUANTILES, merge_summaries, new_values, store_summaries, stored_summaries, summarise
from spendguard.scratch import materialise, scratch_path


def iqr_ranked(spark, sf_dir):
    """Amounts outside the training fences of their category, the ten most material per category."""
    rows = adjusted_orders(spark, sf_dir).withColumn("category_key", category_key(F.col("verba")))
    train = rows.where(F.col("split") == "train")
    fences = iqr_fences(train, PARAMS)
    scored = (
        rows.where(F.col("split").isin("test", "infer"))
        .join(fences, "category_key")
        .withColumn("iqr_flag", outside_fences().cast("int"))
        .withColumn("ensemble_score", F.abs(F.col("valor_adjusted") - F.col("q1")) / (F.col("q3") - F.col("q1")))
        .withColumn("audit_score", audit_score(F.col("ensemble_score"), F.col("valor_adjusted")))
    )
    return top_per_category(scored, 10).select(
        "category_key", "category_position", "record_id", "iqr_flag",
        F.round("valor_adjusted", 4).alias("valor_adjusted"), F.round("audit_score", 6).alias("audit_score"),
    )


query(
    "iqr_ranked",
    f"""WITH {ORDERS_CTE}, k AS (SELECT *, upper(replace(verba, ' ', '_')) AS category_key FROM adj),
    q AS (SELECT category_key, quantile_cont(valor_adjusted, 0.25) AS q1, quantile_cont(valor_adjusted, 0.75) AS q3
        FROM k WHERE split = 'train' GROUP BY ALL),
    s AS (SELECT k.*, CAST(valor_adjusted < q1 - 1.5 * (q3 - q1) OR valor_adjusted > q3 + 1.5 * (q3 - q1) AS INTEGER) AS iqr_flag,
        abs(valor_adjusted - q1) / (q3 - q1) * ln(1 + greatest(valor_adjusted, 0)) AS audit_score
        FROM k JOIN q USING (category_key) WHERE split IN ('test', 'infer'))
    SELECT category_key, CAST(row_number() OVER (PARTITION BY category_key ORDER BY audit_score DESC, record_id) AS INTEGER) AS category_position,
    record_id, iqr_flag, round(valor_adjusted, 4) AS valor_adjusted, round(audit_score, 6) AS audit_score
    FROM s QUALIFY category_position <= 10""",
)(iqr_ranked)


@query(
    "iqr_contamination",
    f"""WITH {FEATURES_CTE},{CONTAMINATION_CTE} SELECT category_key, round(q1, 4) AS q1, round(q3, 4) AS q3, n_train, n_outliers,
    round(outlier_share, 8) AS outlier_share, round(contamination, 8) AS contamination FROM cont""",
)
def iqr_contamination(spark, sf_dir):
    return order_contamination(spark, sf_dir).select(
        "category_key", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "n_train", "n_outliers",
        F.round("outlier_share", 8).alias("outlier_share"), F.round("contamination", 8).alias("contamination"),
    )


@query(
    "group_quantiles",
    " UNION ALL ".join(
        f"SELECT l_returnflag, l_linestatus, {p}::DOUBLE AS p, round(quantile_cont(l_extendedprice, {p}), 4) AS quantile, "
        "count(*) AS n FROM lineitem GROUP BY ALL" for p in (0.01, 0.25, 0.5, 0.99)
    ),
)
def group_quantiles(spark, sf_dir):
    found = exact_quantiles(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.01, 0.25, 0.5, 0.99]
    )
    return found.withColumn("quantile", F.round("quantile", 4))


_METRICS = f"""WITH {PANEL_CTE},
met AS (SELECT category_key AS category, count(*) AS n_records, sum(ensemble_flag)::BIGINT AS n_flagged_ensemble,
    avg(anomaly_spread) AS r1, avg(anomaly_drift) AS r2,
    avg(CASE WHEN ensemble_flag = 1 THEN valor_adjusted END) AS mean, median(CASE WHEN ensemble_flag = 1 THEN valor_adjusted END) AS med,
    min(CASE WHEN ensemble_flag = 1 THEN valor_adjusted END) AS lo, max(CASE WHEN ensemble_flag = 1 THEN valor_adjusted END) AS hi
    FROM pred GROUP BY ALL),
metrics AS (SELECT category, n_records, n_flagged_ensemble, round(100 * n_flagged_ensemble / n_records, 4) AS flagged_pct,
    round(100 * contamination, 4) AS iqr_baseline_pct,
    round(contamination / greatest(n_flagged_ensemble / n_records, 1e-9), 2) AS reduction_factor,
    n_flagged_ensemble > 0 AS reduction_defined, round(r1, 6) AS rate_spread, round(r2, 6) AS rate_drift,
    round(mean, 2) AS amount_mean, round(med, 2) AS amount_median, round(lo, 2) AS amount_min, round(hi, 2) AS amount_max
    FROM met JOIN cont ON cont.category_key = category)"""


def panel_metrics(spark, sf_dir):
    return metrics.category_metrics(order_panel(spark, sf_dir), order_contamination(spark, sf_dir), PANEL)


@query("category_metrics", f"{_METRICS} SELECT * FROM metrics")
def category_metrics(spark, sf_dir):
    rate, amount = F.col("individual_model_rates"), F.col("anomaly_valor_stats")
    return panel_metrics(spark, sf_dir).select(
        "category", "n_records", "n_flagged_ensemble", "flagged_pct", "iqr_baseline_pct", "reduction_factor",
        "reduction_defined", F.round(rate["spread"], 6).alias("rate_spread"), F.round(rate["drift"], 6).alias("rate_drift"),
        amount["mean"].alias("amount_mean"), amount["median"].alias("amount_median"),
        amount["min"].alias("amount_min"), amount["max"].alias("amount_max"),
    )


@query(
    "reduction_vs_iqr",
    f"{_METRICS} SELECT category, round((iqr_baseline_pct - flagged_pct) / greatest(iqr_baseline_pct, 0.001) * 100, 1) AS reducao_vs_iqr FROM metrics",
)
def reduction_vs_iqr(spark, sf_dir):
    return metrics.reduction_vs_iqr(panel_metrics(spark, sf_dir)).select("category", "reducao_vs_iqr")


@query(
    "run_totals",
    f"""{_METRICS} SELECT count(*) AS n_categories, sum(n_records)::BIGINT AS total_records,
    sum(n_flagged_ensemble)::BIGINT AS total_flagged, round(100 * sum(n_flagged_ensemble) / sum(n_records), 3) AS flag_rate_pct FROM metrics""",
)
def run_totals(spark, sf_dir):
    return metrics.run_totals(panel_metrics(spark, sf_dir))


@query(
    "report_table",
    f"""{_METRICS} SELECT category, format('{{:,}}', n_records) AS n, n_flagged_ensemble::VARCHAR AS anomalies,
    format('{{:.4f}}%', flagged_pct) AS ensemble_pct, format('{{:.4f}}%', iqr_baseline_pct) AS iqr_pct,
    coalesce(format('R$ {{:.2f}}', amount_mean), 'R$ —') AS mean_amount FROM metrics""",
)
def report_table(spark, sf_dir):
    return metrics.report_table(panel_metrics(spark, sf_dir)).drop("max_amount")


_TEMPORAL = """SELECT category_key AS category, year, count(*) AS n_records, sum(ensemble_flag)::BIGINT AS n_flagged,
    round(100 * sum(ensemble_flag) / count(*), 6) AS flagged_pct FROM pred {} GROUP BY ALL"""


@query("temporal_metrics", f"WITH {PANEL_CTE} " + _TEMPORAL.format(""))
def temporal_metrics(spark, sf_dir):
    found = metrics.temporal_metrics(order_panel(spark, sf_dir))
    return found.withColumn("flagged_pct", F.round("flagged_pct", 6))


@query("temporal_trend", f"WITH {PANEL_CTE} " + _TEMPORAL.format("WHERE year BETWEEN 2000 AND 2000"))
def temporal_trend(spark, sf_dir):
    found = metrics.temporal_metrics(order_panel(spark, sf_dir), 2000, 2000)
    return found.withColumn("flagged_pct", F.round("flagged_pct", 6))


@query(
    "reversal_summary",
    f"""WITH {LINEITEM_CTE}, r AS (SELECT * FROM adj WHERE is_reversal AND split IN ('train', 'test', 'infer'))
    SELECT count(*) AS total_reversals, round(sum(abs(valor_adjusted)), 1) AS total_reversal_value_brl,
    round(avg(abs(valor_adjusted)), 1) AS mean_reversal_value_brl, round(max(abs(valor_adjusted)), 1) AS max_reversal_value_brl,
    (SELECT string_agg(verba || '=' || c, ',' ORDER BY verba) FROM (SELECT verba, count(*) AS c FROM r GROUP BY verba)) AS by_verba,
    (SELECT string_agg(conta || '=' || c, ',' ORDER BY c DESC, conta) FROM
        (SELECT conta, count(*) AS c FROM r GROUP BY conta ORDER BY c DESC, conta LIMIT 10)) AS top_parliamentarians FROM r""",
)
def reversal_summary(spark, sf_dir):
    found = profile.reversal_summary(features.reversal_rows(adjusted_lineitems(spark, sf_dir)))
    pair = lambda k, v: F.concat(k, F.lit("="), v.cast("string"))
    return found.select(
        "total_reversals",
        *[F.round(c, 1).alias(c) for c in ("total_reversal_value_brl", "mean_reversal_value_brl", "max_reversal_value_brl")],
        F.array_join(F.transform(F.map_entries("by_verba"), lambda e: pair(e["key"], e["value"])), ",").alias("by_verba"),
        F.array_join(
            F.transform("top_parliamentarians", lambda e: pair(e["conta"], e["count"])), ","
        ).alias("top_parliamentarians"),
    )


@query(
    "reversals_by_category",
    f"WITH {LINEITEM_CTE} SELECT verba, count(*) AS count FROM adj WHERE is_reversal AND split IN ('train', 'test', 'infer') GROUP BY verba",
)
def reversals_by_category(spark, sf_dir):
    return profile.reversals_by_category(features.reversal_rows(adjusted_lineitems(spark, sf_dir)))


@query(
    "category_profile",
    f"""WITH {LINEITEM_CTE}, c AS (SELECT verba AS category, count(*) AS n_records, count(DISTINCT year) AS n_years, min(year) AS year_min,
    max(year) AS year_max, round(avg(valor), 2) AS valor_mean, round(stddev_samp(valor), 2) AS valor_std, round(min(valor), 2) AS valor_min,
    round(max(valor), 2) AS valor_max, round(100 * avg(CASE WHEN favorecido IS NULL THEN 1 ELSE 0 END), 4) AS null_favorecido_pct,
    sum(CASE WHEN is_reversal THEN 1 ELSE 0 END)::BIGINT AS n_reversals,
    round(100 * avg(CASE WHEN is_reversal THEN 1 ELSE 0 END), 4) AS reversal_rate_pct, round(median(valor), 1) AS valor_median
    FROM adj GROUP BY verba),
    t AS (SELECT verba AS category, conta, count(*) AS n, row_number() OVER (PARTITION BY verba ORDER BY count(*) DESC, conta) AS r
    FROM adj GROUP BY verba, conta)
    SELECT c.*, (SELECT string_agg(conta || '=' || n, ',' ORDER BY r) FROM t WHERE t.category = c.category AND r <= 5) AS top_conta FROM c""",
)
def category_profile(spark, sf_dir):
    found = profile.category_profile(adjusted_lineitems(spark, sf_dir))
    items = F.transform("top_conta", lambda e: F.concat(e["conta"], F.lit("="), e["count"].cast("string")))
    return found.withColumn("valor_median", F.round("valor_median", 1)).withColumn("top_conta", F.array_join(items, ","))


@query(
    "global_profile",
    f"""WITH {LINEITEM_CTE} SELECT count(*) AS total_records, count(DISTINCT verba) AS n_categories, min(year) AS year_min, max(year) AS year_max,
    count(DISTINCT year) AS n_years, round(100 * avg(CASE WHEN is_reversal THEN 1 ELSE 0 END), 4) AS overall_reversal_pct,
    round(100 * avg(CASE WHEN favorecido IS NULL THEN 1 ELSE 0 END), 4) AS overall_null_favorecido_pct FROM adj""",
)
def global_profile(spark, sf_dir):
    return profile.global_profile(adjusted_lineitems(spark, sf_dir))


@query(
    "year_drift",
    f"""WITH {ORDERS_CTE}, y AS (SELECT verba AS category, year, avg(valor) AS mean, stddev_samp(valor) AS std, count(*) AS count FROM adj GROUP BY ALL),
    z AS (SELECT *, (mean - avg(mean) OVER w) / nullif(stddev_samp(mean) OVER w, 0) AS z_score FROM y WINDOW w AS (PARTITION BY category))
    SELECT category, year, round(mean, 4) AS mean, round(std, 4) AS std, count, round(z_score, 6) AS z_score FROM z WHERE abs(z_score) > 1.2""",
)
def year_drift(spark, sf_dir):
    found = profile.year_drift(adjusted_orders(spark, sf_dir), limit=1.2)
    return found.select(
        "category", "year", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "count",
        F.round("z_score", 6).alias("z_score"),
    )


@query("value_counts", "SELECT CAST(l_partkey AS VARCHAR) AS l_partkey, count(*) AS count FROM lineitem GROUP BY ALL ORDER BY count DESC, l_partkey LIMIT 25")
def value_counts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("l_partkey", F.col("l_partkey").cast("string"))
    return profile.value_counts(items, "l_partkey", 25)


@query(
    "overview",
    f"""WITH {LINEITEM_CTE} SELECT count(*) AS n_records, min(year) AS year_min, max(year) AS year_max, count(DISTINCT conta) AS n_contas,
    count(DISTINCT verba) AS n_verbas FROM adj""",
)
def overview(spark, sf_dir):
    return profile.overview(adjusted_lineitems(spark, sf_dir))


@query("records_per_year", f"WITH {LINEITEM_CTE} SELECT year, split, count(*) AS n_records FROM adj GROUP BY ALL")
def records_per_year(spark, sf_dir):
    return profile.records_per_year(adjusted_lineitems(spark, sf_dir))


@query("records_per_category", f"WITH {LINEITEM_CTE} SELECT verba, count(*) AS registros FROM adj GROUP BY ALL")
def records_per_category(spark, sf_dir):
    return profile.records_per_category(adjusted_lineitems(spark, sf_dir))


@query("distinct_values", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS conta FROM lineitem")
def distinct_values(spark, sf_dir):
    return profile.distinct_values(adjusted_lineitems(spark, sf_dir), "conta")


_PROFILE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_suppkey", "l_linenumber")
_PROFILE_TYPES = {"l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_suppkey": "bigint", "l_linenumber": "int"}


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, '{_PROFILE_TYPES[c]}' AS type, count(*) AS n, count(*) - count({c}) AS n_null, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, count(DISTINCT {c}) AS n_distinct,
        round(quantile_cont({c}::DOUBLE, 0.05), 4) AS q05, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(median({c}::DOUBLE), 4) AS median,
        round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, round(quantile_cont({c}::DOUBLE, 0.95), 4) AS q95 FROM lineitem"""
        for c in _PROFILE_COLUMNS
    )
    + """ UNION ALL SELECT 'l_returnflag', 'string', count(*), count(*) - count(l_returnflag), NULL, NULL, NULL, NULL,
    count(DISTINCT l_returnflag), NULL, NULL, NULL, NULL, NULL FROM lineitem""",
)
def column_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*_PROFILE_COLUMNS, "l_returnflag")
    found = profile.column_profile(rows)
    return found.select(
        "column", "type", "n", "n_null", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max",
        "n_distinct", *[F.round(c, 4).alias(c) for c in ("q05", "q25", "median", "q75", "q95")],
    )


@query(
    "histogram",
    f"""WITH {PANEL_CTE}, g AS (SELECT category_key, valor_adjusted, CASE WHEN split = 'train' THEN 'train' ELSE 'eval' END AS conjunto FROM feat),
    r AS (SELECT category_key, min(valor_adjusted) AS lo, (max(valor_adjusted) - min(valor_adjusted)) / 80 AS w FROM g GROUP BY ALL),
    t AS (SELECT category_key, conjunto, count(*) AS n FROM g GROUP BY ALL),
    c AS (SELECT category_key, conjunto, CAST(least(floor((valor_adjusted - lo) / w) + 1, 80) AS INTEGER) AS bin, count(*) AS c
    FROM g JOIN r USING (category_key) GROUP BY ALL)
    SELECT t.category_key AS category_key, t.conjunto AS conjunto, CAST(b AS INTEGER) AS bin, coalesce(c, 0) AS count, round(coalesce(c, 0) / (n * w), 12) AS density
    FROM t JOIN r USING (category_key) CROSS JOIN range(1, 81) AS bins(b) LEFT JOIN c ON c.category_key = t.category_key AND c.conjunto = t.conjunto AND c.bin = b""",
)
def histogram(spark, sf_dir):
    grouped = order_features(spark, sf_dir).withColumn(
        "conjunto", F.when(F.col("split") == "train", "train").otherwise("eval")
    )
    found = stats.histogram(grouped, "valor_adjusted", "conjunto")
    return found.select("category_key", "conjunto", "bin", "count", F.round("density", 12).alias("density"))


@query(
    "box_stats",
    f"""WITH {ORDERS_CTE}, q AS (SELECT verba, year, quantile_cont(valor_adjusted, 0.25) AS q1, median(valor_adjusted) AS med,
    quantile_cont(valor_adjusted, 0.75) AS q3 FROM adj GROUP BY ALL),
    j AS (SELECT *, valor_adjusted BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM adj JOIN q USING (verba, year))
    SELECT verba, year, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
    round(min(CASE WHEN inside THEN valor_adjusted END), 4) AS whisker_low, round(max(CASE WHEN inside THEN valor_adjusted END), 4) AS whisker_high,
    count(*) AS n, sum(CASE WHEN inside THEN 0 ELSE 1 END)::BIGINT AS n_outliers FROM j GROUP BY verba, year, q1, med, q3""",
)
def box_stats(spark, sf_dir):
    found = stats.box_stats(adjusted_orders(spark, sf_dir), "valor_adjusted", ["verba", "year"])
    cols = ("q1", "median", "q3", "whisker_low", "whisker_high")
    return found.select("verba", "year", *[F.round(c, 4).alias(c) for c in cols], "n", "n_outliers")


@query(
    "density_curve",
    f"""WITH {ORDERS_CTE}, s AS (SELECT verba, split, count(*) AS n, min(valor) AS lo, max(valor) AS hi,
    stddev_samp(valor) * pow(count(*), -0.2) AS h FROM adj GROUP BY ALL),
    grid AS (SELECT s.*, CAST(i AS INTEGER) AS grid_index, (lo - 3 * h) + i * ((hi + 3 * h) - (lo - 3 * h)) / 49 AS x FROM s, range(50) t(i))
    SELECT grid.verba AS verba, grid.split AS split, grid_index, round(x, 4) AS x,
    round(sum(exp(-0.5 * pow((x - valor) / h, 2))) / (n * h * sqrt(2 * pi())) * 1000000, 6) AS density
    FROM grid JOIN adj ON adj.verba = grid.verba AND adj.split = grid.split GROUP BY grid.verba, grid.split, grid_index, x, n, h""",
)
def density_curve(spark, sf_dir):
    found = stats.kde_grid(adjusted_orders(spark, sf_dir), "valor", "split", points=50, keys=["verba"])
    return found.select(
        "verba", "split", "grid_index", F.round("x", 4).alias("x"), F.round(F.col("density") * 1000000, 6).alias("density")
    )


@query(
    "medians_by_flag",
    f"WITH {PANEL_CTE} SELECT ensemble_flag, round(median(valor_adjusted), 4) AS median FROM pred GROUP BY ALL",
)
def medians_by_flag(spark, sf_dir):
    found = exact_quantiles(order_panel(spark, sf_dir), ["ensemble_flag"], "valor_adjusted", [0.5])
    return found.select("ensemble_flag", F.round("quantile", 4).alias("median"))


@query("fences_of_lineitem", f"""WITH {LINEITEM_CTE}, q AS (SELECT verba AS category_key, quantile_cont(valor_adjusted, 0.25) AS q1,
    quantile_cont(valor_adjusted, 0.75) AS q3 FROM adj WHERE split = 'train' GROUP BY ALL)
    SELECT category_key, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper FROM q""")
def fences_of_lineitem(spark, sf_dir):
    train = adjusted_lineitems(spark, sf_dir).where(F.col("split") == "train").withColumn("category_key", F.col("verba"))
    found = iqr_fences(train, PARAMS)
    return found.select("category_key", *[F.round(c, 4).alias(c) for c in ("q1", "q3", "lower", "upper")])


_SUMMARISED = {"l_quantity": "double", "l_extendedprice": "double", "l_suppkey": "bigint"}


def _stored_by_year(spark, rows, part):
    """Summaries of all parts but the last; then the last one is added without reading the others again."""
    path = scratch_path(spark, "summaries")
    last = rows.agg(F.max(part)).first()[0]
    store_summaries(summarise(rows.where(F.col(part) < last), part), path)
    store_summaries(summarise(rows.where(F.col(part) == last), part), path)
    return stored_summaries(spark, path)


@query(
    "merged_year_summaries",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, '{t}' AS type, count(*) AS n, count(*) - count({c}) AS n_null, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, TRUE AS distinct_close, TRUE AS ranks_close FROM lineitem"""
        for c, t in _SUMMARISED.items()
    ),
)
def merged_year_summaries(spark, sf_dir):
    """Profiles merged from stored years; the estimates are held against exact counts over the whole table."""
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), *_SUMMARISED)
    found = materialise(merge_summaries(_stored_by_year(spark, lines, "year")), "merged")
    long = lines.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in _SUMMARISED])).alias("_p")).select("_p.*")
    exact = long.groupBy("column", "v").agg(F.count("*").alias("c")).join(found, "column").groupBy("column").agg(
        F.count("*").alias("values"),
        *[F.sum(F.when(F.col("v") < F.col(q), F.col("c")).otherwise(0)).alias(f"below_{q}") for q in QUANTILES],
        *[F.sum(F.when(F.col("v") <= F.col(q), F.col("c")).otherwise(0)).alias(f"upto_{q}") for q in QUANTILES],
    )
    ranks = [
        (F.col(f"below_{q}") <= (p + 0.01) * F.col("n")) & (F.col(f"upto_{q}") >= (p - 0.01) * F.col("n")) for q, p in QUANTILES.items()
    ]
    return found.join(exact, "column").select(
        "column", "type", "n", "n_null", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max",
        (F.abs(F.col("n_distinct") - F.col("values")) <= F.lit(0.04) * F.col("values")).alias("distinct_close"),
        reduce(and_, ranks).alias("ranks_close"),
    )


@query(
    "new_spenders_by_year",
    """WITH y AS (SELECT DISTINCT year(o_orderdate)::VARCHAR AS part, o_custkey FROM orders),
    f AS (SELECT o_custkey, min(part) AS part FROM y GROUP BY ALL), d AS (SELECT part, count(*) AS n_distinct FROM y GROUP BY ALL),
    s AS (SELECT part, count(*) AS n_new FROM f GROUP BY ALL),
    g AS (SELECT (y.part::INT + 1)::VARCHAR AS part, count(*) AS n_gone FROM y LEFT JOIN y AS z ON z.o_custkey = y.o_custkey
    AND z.part::INT = y.part::INT + 1 WHERE z.part IS NULL GROUP BY ALL)
    SELECT part, n_distinct, coalesce(n_new, 0) AS n_new, coalesce(n_gone, 0) AS n_gone,
    (sum(coalesce(n_new, 0)) OVER (ORDER BY part))::BIGINT AS n_seen FROM d LEFT JOIN s USING (part) LEFT JOIN g USING (part)""",
)
def new_spenders_by_year(spark, sf_dir):
    """Spenders that are new or gone in a year, from stored sketches; exact up to 2^20 spenders."""
    spenders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_custkey")
    path = scratch_path(spark, "spenders")
    store_summaries(summarise(spenders, theta=20), path)
    return new_values(stored_summaries(spark, path), theta=20).drop("column")
