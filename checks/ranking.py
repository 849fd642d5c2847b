"""Rankings, exploration and text for readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    ORDERS_CTE,
    PANEL_CTE,
    adjusted_orders,
    brl,
    derived,
    order_features,
    order_flagged,
    order_panel,
    order_points,
    query,
    table,
)
from spendguard.functions import portable_unit
from spendguard.operators import explain, explore, rank
from spendguard.operators.sampling import sample_per_category
from spendguard.scratch import scratch_path
from spendguard.sources import read_results, write_results


@query(
    "rank_anomalies",
    f"""WITH {PANEL_CTE} SELECT category_key, record_id, round(audit_score, 6) AS audit_score,
    row_number() OVER (PARTITION BY category_key ORDER BY audit_score DESC, record_id) AS category_rank,
    row_number() OVER (PARTITION BY category_key ORDER BY ensemble_score DESC, record_id) AS category_rank_by_score,
    row_number() OVER (ORDER BY audit_score DESC, record_id) AS global_rank FROM flagged""",
)
def rank_anomalies(spark, sf_dir):
    ranked = rank.rank_anomalies(order_flagged(spark, sf_dir))
    return ranked.select(
        "category_key", "record_id", F.round("audit_score", 6).alias("audit_score"),
        "category_rank", "category_rank_by_score", "global_rank",
    )


@query(
    "whole_table_rank",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS status_rank FROM orders""",
)
def whole_table_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    return rank.distributed_rank(rows, "status_rank", order, ["o_orderstatus"]).select("o_orderkey", "status_rank")


@query(
    "top_per_category",
    f"""WITH {PANEL_CTE} SELECT category_key, record_id, round(audit_score, 6) AS audit_score,
    CAST(row_number() OVER (PARTITION BY category_key ORDER BY audit_score DESC, record_id) AS INTEGER) AS category_position
    FROM flagged QUALIFY category_position <= 5""",
)
def top_per_category(spark, sf_dir):
    return rank.top_per_category(order_flagged(spark, sf_dir), 5).select(
        "category_key", "record_id", F.round("audit_score", 6).alias("audit_score"), "category_position"
    )


@query(
    "top_global",
    f"""WITH {PANEL_CTE} SELECT CAST(row_number() OVER (ORDER BY audit_score DESC, record_id) AS INTEGER) AS rank, category_key AS category,
    record_id, conta, favorecido, round(valor_adjusted, 2) AS valor_adjusted, {brl('valor_adjusted')} AS valor_brl, year, month,
    round(ensemble_score, 6) AS ensemble_score, round(audit_score, 6) AS audit_score, round(mean_value, 2) AS mean_value,
    {brl('mean_value')} AS mean_value_brl FROM flagged QUALIFY rank <= 50""",
)
def top_global(spark, sf_dir):
    best = rank.top_global(order_flagged(spark, sf_dir), 50)
    shown = rank.display_record(best, "global_position")
    return shown.select(
        "rank", "category", "record_id", "conta", "favorecido", "valor_adjusted", "valor_brl", "year", "month",
        "ensemble_score", "audit_score", "mean_value", "mean_value_brl",
    )


@query(
    "ranking_document",
    f"""WITH {PANEL_CTE}, t AS (SELECT *, row_number() OVER (ORDER BY audit_score DESC, record_id) AS g,
    row_number() OVER (PARTITION BY category_key ORDER BY audit_score DESC, record_id) AS c FROM flagged)
    SELECT count(*) AS total_flagged, string_agg(record_id::VARCHAR, ',' ORDER BY g) FILTER (g <= 50) AS global_top,
    (SELECT string_agg(category_key || ':' || ids, ';' ORDER BY category_key) FROM (SELECT category_key,
        string_agg(record_id::VARCHAR, ',' ORDER BY c) AS ids FROM t WHERE c <= 5 GROUP BY ALL)) AS per_category_top FROM t""",
)
def ranking_document(spark, sf_dir):
    found = rank.ranking_document(order_flagged(spark, sf_dir))
    ids = lambda records: F.array_join(F.transform(records, lambda r: r["record_id"].cast("string")), ",")
    per = F.array_sort(
        F.transform(F.map_entries("per_category_top"), lambda e: F.concat(e["key"], F.lit(":"), ids(e["value"])))
    )
    return found.select(
        "total_flagged", ids(F.col("global_top")).alias("global_top"), F.array_join(per, ";").alias("per_category_top")
    )


@query(
    "relative_audit_score",
    f"""WITH {PANEL_CTE} SELECT record_id, round(audit_score, 6) AS audit_score,
    round(least(audit_score / max(audit_score) OVER (), 1.0), 6) AS audit_score_relative FROM flagged""",
)
def relative_audit_score(spark, sf_dir):
    scored = rank.with_audit_score(order_flagged(spark, sf_dir), relative=True)
    return scored.select(
        "record_id", F.round("audit_score", 6).alias("audit_score"),
        F.round("audit_score_relative", 6).alias("audit_score_relative"),
    )


@query(
    "entity_leaderboard",
    f"""WITH {PANEL_CTE} SELECT conta, count(*) AS total_flags, round(avg(ensemble_score), 6) AS avg_score,
    round(sum(valor_adjusted), 2) AS total_valor, string_agg(DISTINCT category_key, ', ' ORDER BY category_key) AS categorias
    FROM flagged GROUP BY conta ORDER BY total_flags DESC, conta LIMIT 30""",
)
def entity_leaderboard(spark, sf_dir):
    board = rank.entity_leaderboard(order_flagged(spark, sf_dir), 30)
    return board.withColumn("avg_score", F.round("avg_score", 6)).withColumn("total_valor", F.round("total_valor", 2))


@query(
    "top_spenders",
    f"""WITH {ORDERS_CTE} SELECT conta, round(sum(valor_adjusted), 2) AS total_valor FROM adj GROUP BY conta
    ORDER BY sum(valor_adjusted) DESC, conta LIMIT 20""",
)
def top_spenders(spark, sf_dir):
    return rank.top_spenders(adjusted_orders(spark, sf_dir)).withColumn("total_valor", F.round("total_valor", 2))


@query(
    "explanation_queue",
    f"""WITH {PANEL_CTE} SELECT record_id, round(audit_score, 6) AS audit_score FROM flagged WHERE record_id % 3 <> 0
    ORDER BY audit_score DESC, record_id LIMIT 100""",
)
def explanation_queue(spark, sf_dir):
    explained = order_flagged(spark, sf_dir).withColumn(
        "explanation", F.when(F.col("record_id") % 3 == 0, F.lit("already explained"))
    )
    return rank.explanation_queue(explained, 100).select("record_id", F.round("audit_score", 6).alias("audit_score"))


def _attributions(spark, sf_dir):
    """Scaled features of the flagged records in the shape of an attribution table."""
    features = ("year", "valor_adjusted", "month", "quarter", "day_of_week", "mean_value")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature_name"), F.col(f"z_{c}").alias("v")) for c in features]))
    flagged = order_flagged(spark, sf_dir).select("record_id")
    return derived(
        spark, sf_dir, "panel_attributions",
        lambda: order_points(spark, sf_dir).join(flagged, "record_id", "left_semi").select("category_key", "record_id", pairs.alias("_p")).select(
            "category_key", "record_id", "_p.feature_name", F.col("_p.v").alias("shap_value"),
            (F.col("_p.v") * 2).alias("feature_value"), F.lit(10.0).alias("base_value"),
        ),
    )


_ATTR = f"""{PANEL_CTE},
sca AS (SELECT category_key, {", ".join(f"avg({c}) AS m_{c}, CASE WHEN min({c}) = max({c}) THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in ("year", "valor_adjusted", "month", "quarter", "day_of_week", "mean_value"))}
    FROM feat WHERE split = 'train' GROUP BY ALL),
attr AS ({" UNION ALL ".join(f"SELECT category_key, record_id, '{c}' AS feature_name, ({c} - m_{c}) / s_{c} AS shap_value FROM flagged JOIN sca USING (category_key)" for c in ("year", "valor_adjusted", "month", "quarter", "day_of_week", "mean_value"))}),
topf AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY abs(shap_value) DESC, feature_name) AS INTEGER) AS rank FROM attr)"""


@query(
    "top_features",
    f"""WITH {_ATTR} SELECT category_key, record_id, rank, feature_name, round(shap_value, 6) AS shap_value,
    round(2 * shap_value, 6) AS feature_value FROM topf WHERE rank <= 5""",
)
def top_features(spark, sf_dir):
    found = explain.top_features(_attributions(spark, sf_dir), 5)
    return found.withColumn("shap_value", F.round("shap_value", 6)).withColumn("feature_value", F.round("feature_value", 6))


@query(
    "feature_importance",
    f"""WITH {_ATTR}, m AS (SELECT category_key, feature_name, avg(abs(shap_value)) AS v, count(*) AS n_records FROM attr GROUP BY ALL)
    SELECT category_key, feature_name, round(v, 6) AS mean_abs_shap, n_records,
    CAST(row_number() OVER (PARTITION BY category_key ORDER BY v DESC, feature_name) AS INTEGER) AS rank FROM m QUALIFY rank <= 4""",
)
def feature_importance(spark, sf_dir):
    found = explain.feature_importance(_attributions(spark, sf_dir), 4)
    return found.withColumn("mean_abs_shap", F.round("mean_abs_shap", 6))


@query(
    "summary_points",
    f"""WITH {_ATTR}, m AS (SELECT category_key, feature_name, avg(abs(shap_value)) AS v FROM attr GROUP BY ALL),
    t AS (SELECT *, CAST(row_number() OVER (PARTITION BY category_key ORDER BY v DESC, feature_name) AS INTEGER) AS rank FROM m QUALIFY rank <= 4)
    SELECT category_key, record_id, rank, feature_name, round(shap_value, 6) AS shap_value FROM attr JOIN t USING (category_key, feature_name)""",
)
def summary_points(spark, sf_dir):
    found = explain.summary_points(_attributions(spark, sf_dir), 4)
    return found.withColumn("shap_value", F.round("shap_value", 6)).drop("feature_value")


@query(
    "waterfall_table",
    f"""WITH {_ATTR}, rr AS (SELECT category_key, record_id, CAST(row_number() OVER (PARTITION BY category_key ORDER BY ensemble_score DESC, record_id) AS INTEGER) AS record_rank
        FROM flagged QUALIFY record_rank <= 20),
    st AS (SELECT category_key, record_id, record_rank, least(rank, 4) AS step, count(*) AS n, sum(shap_value) AS shap_value, min(feature_name) AS name
        FROM topf JOIN rr USING (category_key, record_id) GROUP BY ALL)
    SELECT category_key, record_id, record_rank, step, CASE WHEN n = 1 THEN name ELSE n || ' other features' END AS feature_name,
    round(shap_value, 6) AS shap_value,
    round(10 + sum(shap_value) OVER (PARTITION BY record_id ORDER BY step DESC), 6) AS to_value FROM st""",
)
def waterfall_table(spark, sf_dir):
    found = explain.waterfall_table(_attributions(spark, sf_dir), order_flagged(spark, sf_dir), 20, 4)
    return found.select(
        "category_key", "record_id", "record_rank", "step", "feature_name", F.round("shap_value", 6).alias("shap_value"),
        F.round("to_value", 6).alias("to_value"),
    )


_FLAGGED = f"""{_ATTR}, flagged_out AS (SELECT flagged.*, t.feature_name AS top_feature, t.shap_value AS top_shap_value
    FROM flagged LEFT JOIN (SELECT * FROM topf WHERE rank = 1) t USING (category_key, record_id))"""


def _flagged_out(spark, sf_dir):
    top = explain.top_features(_attributions(spark, sf_dir), 5)
    return rank.flagged_records(order_panel(spark, sf_dir), top)


@query(
    "flagged_records",
    f"""WITH {_FLAGGED} SELECT record_id, conta, verba, round(valor_adjusted, 4) AS valor_adjusted, year, ensemble_flag, round(ensemble_score, 6) AS ensemble_score,
    top_feature, round(top_shap_value, 6) AS top_shap_value, round(score_spread, 6) AS score_spread, anomaly_spread,
    round(score_drift, 6) AS score_drift, anomaly_drift FROM flagged_out""",
)
def flagged_records(spark, sf_dir):
    rounded = {"valor_adjusted": 4, "ensemble_score": 6, "top_shap_value": 6, "score_spread": 6, "score_drift": 6}
    names = (
        "record_id", "conta", "verba", "valor_adjusted", "year", "ensemble_flag", "ensemble_score", "top_feature",
        "top_shap_value", "score_spread", "anomaly_spread", "score_drift", "anomaly_drift",
    )
    out = _flagged_out(spark, sf_dir)
    return out.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in names])


@query(
    "results_roundtrip",
    f"WITH {_FLAGGED} SELECT category_key AS category, top_feature, count(*) AS n, round(sum(ensemble_score), 6) AS total FROM flagged_out GROUP BY ALL",
)
def results_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "results")
    write_results(_flagged_out(spark, sf_dir), path)
    return read_results(spark, path).groupBy("category", "top_feature").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("ensemble_score"), 6).alias("total")
    )


@query(
    "decoded_features",
    f"""WITH {_FLAGGED} SELECT record_id, CASE record_id % 4 WHEN 0 THEN 'Parlamentar (hash): **' || conta || '**'
    WHEN 1 THEN 'Favorecido (hash): **' || favorecido || '**' WHEN 2 THEN 'is_other' ELSE CASE top_feature
    WHEN 'valor_adjusted' THEN 'Valor corrigido pela inflação (R$ Jan/2026)' WHEN 'mean_value' THEN 'Gasto médio histórico do parlamentar nesta verba'
    WHEN 'year' THEN 'Ano da despesa' WHEN 'month' THEN 'Mês da despesa (1–12)' WHEN 'quarter' THEN 'Trimestre (1–4)'
    WHEN 'day_of_week' THEN 'Dia da semana (0=seg, 6=dom)' END END AS decoded FROM flagged_out""",
)
def decoded_features(spark, sf_dir):
    k = F.col("record_id") % 4
    name = F.when(k == 0, "cta_7").when(k == 1, "fav_12").when(k == 2, "is_other").otherwise(F.col("top_feature"))
    return _flagged_out(spark, sf_dir).select("record_id", explore.decode_feature(name).alias("decoded"))


@query(
    "prompt_table",
    f"""WITH {_FLAGGED} SELECT category_key, record_id, md5('{explore.PROMPT_OPENING}' || chr(10) || chr(10) || 'Dados da despesa:' || chr(10)
    || '- Parlamentar: ' || conta || chr(10) || '- Categoria de verba: ' || category_key || chr(10) || '- Valor gasto: ' || {brl('valor_adjusted')} || chr(10)
    || '- Mês/Ano: ' || format('{{:02d}}/{{}}', month, year) || chr(10)
    || '- Média histórica deste parlamentar nesta verba: ' || {brl('mean_value')} || chr(10) || '- Principal fator de anomalia: '
    || CASE top_feature WHEN 'valor_adjusted' THEN 'valor da despesa muito acima do histórico da categoria'
       WHEN 'mean_value' THEN 'desvio em relação à média histórica deste parlamentar nesta verba' WHEN 'year' THEN 'ano atípico da despesa'
       WHEN 'month' THEN 'mês atípico da despesa' WHEN 'quarter' THEN 'trimestre atípico da despesa'
       WHEN 'day_of_week' THEN 'dia da semana incomum para esta despesa' END
    || ' (intensidade: ' || format('{{:.2f}}', abs(top_shap_value)) || ')' || chr(10) || chr(10) || '{explore.PROMPT_CLOSING}') AS prompt_md5 FROM flagged_out""",
)
def prompt_table(spark, sf_dir):
    return explore.prompt_table(_flagged_out(spark, sf_dir)).select("category_key", "record_id", F.md5("prompt").alias("prompt_md5"))


@query(
    "display_columns",
    f"""WITH {PANEL_CTE} SELECT record_id, {brl('valor_adjusted')} AS valor_fmt, format('{{:02d}}/{{}}', month, year) AS mes_ano,
    ['Segunda','Terça','Quarta','Quinta','Sexta','Sábado','Domingo'][day_of_week + 1] AS dia_semana,
    CASE WHEN ensemble_flag = 1 THEN '⚠️ Anômalo' ELSE '—' END AS anomalia, round(ensemble_score, 4) AS score FROM pred""",
)
def display_columns(spark, sf_dir):
    shown = explore.display_columns(order_panel(spark, sf_dir))
    return shown.select("record_id", "valor_fmt", "mes_ano", "dia_semana", "anomalia", "score")


_ANNOTATED = f"""{PANEL_CTE}, ann AS (SELECT adj.*, coalesce(pred.ensemble_flag, 0) AS ensemble_flag, coalesce(pred.ensemble_score, 0) AS ensemble_score
    FROM adj LEFT JOIN pred USING (record_id))"""


@query(
    "annotate_records",
    f"WITH {_ANNOTATED} SELECT record_id, verba, split, ensemble_flag, round(ensemble_score, 6) AS ensemble_score FROM ann",
)
def annotate_records(spark, sf_dir):
    found = explore.annotate_records(adjusted_orders(spark, sf_dir), order_panel(spark, sf_dir))
    return found.select("record_id", "verba", "split", "ensemble_flag", F.round("ensemble_score", 6).alias("ensemble_score"))


@query(
    "normal_records",
    f"WITH {PANEL_CTE} SELECT record_id, verba, year FROM adj WHERE year = 2000 AND record_id NOT IN (SELECT record_id FROM flagged)",
)
def normal_records(spark, sf_dir):
    found = explore.normal_records(adjusted_orders(spark, sf_dir), order_flagged(spark, sf_dir), [2000])
    return found.select("record_id", "verba", "year")


_FILTER = "year IN (2000, 2001) AND verba IN ('1-URGENT', '5-LOW') AND split IN ('test', 'infer')"


@query(
    "explore",
    f"WITH {_ANNOTATED} SELECT record_id, verba, conta, year, ensemble_flag FROM ann WHERE {_FILTER} AND ensemble_flag = 1",
)
def explore_rows(spark, sf_dir):
    rows = explore.annotate_records(adjusted_orders(spark, sf_dir), order_panel(spark, sf_dir))
    found = explore.explore(rows, years=[2000, 2001], categories=["1-URGENT", "5-LOW"], splits=["test", "infer"], flagged_only=True)
    return found.select("record_id", "verba", "conta", "year", "ensemble_flag")


@query(
    "explore_limited",
    f"WITH {_ANNOTATED} SELECT record_id, round(ensemble_score, 6) AS ensemble_score FROM ann WHERE {_FILTER} ORDER BY ann.ensemble_score DESC, record_id LIMIT 100",
)
def explore_limited(spark, sf_dir):
    rows = explore.annotate_records(adjusted_orders(spark, sf_dir), order_panel(spark, sf_dir))
    found = explore.explore(
        rows, years=[2000, 2001], categories=["1-URGENT", "5-LOW"], splits=["test", "infer"], limit=100,
        order=[F.col("ensemble_score").desc(), F.col("record_id")],
    )
    return found.select("record_id", F.round("ensemble_score", 6).alias("ensemble_score"))


@query(
    "filter_kpis",
    f"""WITH {_ANNOTATED} SELECT count(*) AS n_records, round(sum(valor_adjusted), 2) AS total_valor, sum(ensemble_flag)::BIGINT AS n_flagged,
    round(100 * avg(ensemble_flag), 6) AS flag_rate_pct FROM ann WHERE {_FILTER}""",
)
def filter_kpis(spark, sf_dir):
    rows = explore.annotate_records(adjusted_orders(spark, sf_dir), order_panel(spark, sf_dir))
    chosen = explore.explore(rows, years=[2000, 2001], categories=["1-URGENT", "5-LOW"], splits=["test", "infer"])
    found = explore.filter_kpis(chosen)
    return found.withColumn("total_valor", F.round("total_valor", 2)).withColumn("flag_rate_pct", F.round("flag_rate_pct", 6))


@query(
    "sample_per_category",
    f"""WITH {PANEL_CTE}, u AS (SELECT category_key, record_id, split,
    ('0x' || substr(md5(record_id::VARCHAR || '|42'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM feat)
    SELECT category_key, split, record_id FROM u QUALIFY count(*) OVER (PARTITION BY category_key, split) <= 800
    OR row_number() OVER (PARTITION BY category_key, split ORDER BY u, record_id) <= 300""",
)
def sample_by_category(spark, sf_dir):
    found = sample_per_category(
        order_features(spark, sf_dir), 300, 800, keys=["category_key", "split"], unit=portable_unit(42, F.col("record_id"))
    )
    return found.select("category_key", "split", "record_id")
