"""Registry, role mapping of the given tables and shared SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendguard.detectors.space import Space, apply_scaler, fit_buckets, fit_scaler
from spendguard.detectors.thresholds import (
    ensemble,
    fit_threshold,
    flag_scores,
    iqr_contamination,
    minmax_scores,
    widen,
)
from spendguard.operators.features import adjust_amount, assign_split, engineer_features
from spendguard.params import Params
from spendguard.scratch import materialise
from spendguard.session import ship_package
from spendguard.sources import as_expenses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, its twin."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# Years of the given tables: 1995 to 2001.
PARAMS = Params(
    train_years=(1995, 1996, 1998, 1999),
    test_years=(2000,),
    inference_years=(2001,),
    excluded_years=(1997,),
    default_year=2000,
    hash_mode="compat",
    min_rows_train=50,
    temporal_trend_start_year=2000,
    temporal_trend_end_year=2001,
)
SPACE = Space.of(PARAMS)
INDEX = [(1995, 2.2), (1996, 2.0), (1997, 1.8), (1998, 1.6), (1999, 1.4), (2000, 1.2)]
PANEL = ("spread", "drift")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDEX, "year int, ipca_correction_factor double")


# Amounts of `orders` are even; powers of them have outliers, by category none at all, some or very many.
POWERS = {"1": 1, "2": 4, "3": 5, "4": 6}
REST = 10


def _power(w: str, n: int) -> str:
    """Products in one order on both sides, so that the amounts agree to the last bit."""
    return " * ".join([f"({w} * {w})"] * (n // 2) + [w] * (n % 2))


def _heavy_amount(w: str) -> str:
    cases = " ".join(f"WHEN '{c}' THEN {_power(w, n)}" for c, n in POWERS.items())
    return f"1000 + 100 * {w} + 100000 * (CASE substring(o_orderpriority, 1, 1) {cases} ELSE {_power(w, REST)} END)"


HEAVY_AMOUNT = _heavy_amount("(o_totalprice / CAST(500000 AS DOUBLE))")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as expenses: priority is the category, the customer spends, the status is paid; heavy-tailed amounts."""
    return as_expenses(
        table(spark, sf_dir, "orders"),
        record_id=F.col("o_orderkey"),
        verba=F.col("o_orderpriority"),
        conta=F.col("o_custkey"),
        valor=F.expr(HEAVY_AMOUNT),
        vencimento=F.col("o_orderdate"),
        favorecido=F.col("o_orderstatus"),
    )


def adjusted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_split(adjust_amount(orders(spark, sf_dir), price_index(spark)), PARAMS)


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as expenses: flag and status are the category, returned lines are reversals.

    The table has no unique key; the record id is not used by the queries on it.
    """
    return as_expenses(
        table(spark, sf_dir, "lineitem"),
        record_id=F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        verba=F.concat(F.col("l_returnflag"), F.lit("/"), F.col("l_linestatus")),
        conta=F.col("l_suppkey"),
        valor=F.col("l_extendedprice"),
        vencimento=F.col("l_shipdate"),
        favorecido=F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey").cast("string")),
        is_reversal=F.col("l_returnflag") == "R",
    )


def adjusted_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_split(adjust_amount(lineitems(spark, sf_dir), price_index(spark)), PARAMS)


_DERIVED: dict[tuple, DataFrame] = {}


def derived(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the given ones, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DERIVED:
        _DERIVED[key] = materialise(build(), name)
    return _DERIVED[key]


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(
        spark, sf_dir, "order_features", lambda: engineer_features(adjusted_orders(spark, sf_dir), PARAMS)
    )


def train_of(features: DataFrame) -> DataFrame:
    return features.where(F.col("split") == "train")


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        features = order_features(spark, sf_dir)
        train = train_of(features)
        scaled = apply_scaler(features, fit_scaler(train, SPACE), fit_buckets(train, SPACE), SPACE)
        return scaled.join(features.select("record_id", "split"), "record_id")

    return derived(spark, sf_dir, "order_points", build)


def order_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(
        spark, sf_dir, "order_contamination",
        lambda: iqr_contamination(train_of(order_features(spark, sf_dir)), PARAMS),
    )


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two score columns on `orders`: distance from the category mean and from the
    spender's mean.  They stand for detector scores wherever only the reports are under test."""

    def build() -> DataFrame:
        features = order_features(spark, sf_dir)
        scaler = fit_scaler(train_of(features), SPACE)
        both = features.join(scaler, "category_key").select(
            "category_key", "record_id", "split",
            F.explode(
                F.array(
                    F.struct(
                        F.lit("spread").alias("model"),
                        F.abs((F.col("valor_adjusted") - F.col("mean_valor_adjusted")) / F.col("scale_valor_adjusted")).alias("score"),
                    ),
                    F.struct(
                        F.lit("drift").alias("model"),
                        F.abs(F.col("valor_adjusted") - F.col("mean_value")).alias("score"),
                    ),
                )
            ).alias("_s"),
        ).select("category_key", "record_id", "split", "_s.*")
        both = materialise(both, "panel_scores")
        limits = materialise(fit_threshold(train_of(both), order_contamination(spark, sf_dir)), "panel_limits")
        wide = widen(both.where(F.col("split") != "train"), PANEL)
        voted = ensemble(minmax_scores(flag_scores(wide, limits, PANEL), PANEL), PANEL)
        return features.join(voted, ["category_key", "record_id"])

    return derived(spark, sf_dir, "order_panel", build)


def order_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_panel(spark, sf_dir).where(F.col("ensemble_flag") == 1)


# ── SQL twins ────────────────────────────────────────────────────────────────

_YEARS = {"train": "1995,1996,1998,1999", "test": "2000", "infer": "2001", "excluded": "1997"}
SPLIT_CASE = "CASE " + " ".join(f"WHEN year IN ({y}) THEN '{s}'" for s, y in _YEARS.items()) + " ELSE 'other' END"
INDEX_VALUES = ", ".join(f"({y}, {f}::DOUBLE)" for y, f in INDEX)


def key_sql(c: str) -> str:
    return f"upper(replace(replace(strip_accents({c}), ' ', '_'), '/', '_'))"


ORDERS_CTE = f"""
idx(y, f) AS (VALUES {INDEX_VALUES}),
exp AS (SELECT o_orderkey AS record_id, o_orderpriority AS verba, CAST(o_custkey AS VARCHAR) AS conta,
    o_orderstatus AS favorecido, {HEAVY_AMOUNT} AS valor, o_orderdate AS vencimento,
    CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
adj AS (SELECT exp.*, coalesce(f, 1.0::DOUBLE) AS ipca_factor, valor * coalesce(f, 1.0::DOUBLE) AS valor_adjusted,
    {SPLIT_CASE} AS split FROM exp LEFT JOIN idx ON y = year)"""

LINEITEM_CTE = f"""
idx(y, f) AS (VALUES {INDEX_VALUES}),
exp AS (SELECT l_returnflag || '/' || l_linestatus AS verba, CAST(l_suppkey AS VARCHAR) AS conta,
    CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS favorecido,
    l_extendedprice AS valor, l_shipdate AS vencimento, CAST(year(l_shipdate) AS INTEGER) AS year,
    l_returnflag = 'R' AS is_reversal FROM lineitem),
adj AS (SELECT exp.*, valor * coalesce(f, 1.0::DOUBLE) AS valor_adjusted, {SPLIT_CASE} AS split
    FROM exp LEFT JOIN idx ON y = year)"""

FEATURES_CTE = f"""{ORDERS_CTE},
gm AS (SELECT verba, conta, avg(valor_adjusted) AS m FROM adj WHERE split = 'train' GROUP BY ALL),
gmean AS (SELECT avg(m) AS g FROM gm),
feat AS (SELECT record_id, {key_sql('adj.verba')} AS category_key, split, adj.verba AS verba, adj.conta AS conta,
    coalesce(favorecido, adj.conta) AS favorecido, year, valor_adjusted,
    CAST(month(vencimento) AS INTEGER) AS month, CAST(quarter(vencimento) AS INTEGER) AS quarter,
    CAST(isodow(vencimento) - 1 AS INTEGER) AS day_of_week, coalesce(m, g) AS mean_value
    FROM adj LEFT JOIN gm ON gm.verba = adj.verba AND gm.conta = adj.conta, gmean
    WHERE split IN ('train', 'test', 'infer'))"""


def murmur_cte(source: str) -> str:
    """MurmurHash3 (x86, 32 bit, seed 0) of the distinct strings `s` of `source`, at most 11 ASCII bytes."""
    m = 4294967296
    mul = lambda x, c: f"CAST((({x})::HUGEINT * {c}) % {m} AS BIGINT)"
    rotl = lambda x, r: f"((({x}) << {r}) % {m} + (({x}) >> {32 - r}))"
    byte = lambda i: f"CASE WHEN strlen(s) > {i} THEN ord(substr(s, {i} + 1, 1))::BIGINT ELSE 0 END"
    word = lambda b: " + ".join(f"({byte(4 * b + j)}) * {256 ** j}" for j in range(4))
    steps = [f"mm_in AS (SELECT DISTINCT s FROM ({source}))", "mm_0 AS (SELECT s, 0::BIGINT AS h FROM mm_in)"]
    for b in range(3):
        steps.append(f"mm_{b}a AS (SELECT s, h, {mul(word(b), 3432918353)} AS k FROM mm_{b})")
        steps.append(f"mm_{b}b AS (SELECT s, h, {mul(rotl('k', 15), 461845907)} AS k FROM mm_{b}a)")
        steps.append(
            f"mm_{b + 1} AS (SELECT s, CASE WHEN strlen(s) >= {4 * b + 4} "
            f"THEN (({rotl('xor(h, k)', 13)}) * 5 + 3864292196) % {m} "
            f"WHEN strlen(s) > {4 * b} THEN xor(h, k) ELSE h END AS h FROM mm_{b}b)"
        )
    steps.append("mm_f0 AS (SELECT s, xor(h, strlen(s)::BIGINT) AS h FROM mm_3)")
    steps.append(f"mm_f1 AS (SELECT s, {mul('xor(h, h >> 16)', 2246822507)} AS h FROM mm_f0)")
    steps.append(f"mm_f2 AS (SELECT s, {mul('xor(h, h >> 13)', 3266489909)} AS h FROM mm_f1)")
    steps.append("mm_f3 AS (SELECT s, xor(h, h >> 16) AS h FROM mm_f2)")
    steps.append(f"murmur AS (SELECT s, CASE WHEN h >= 2147483648 THEN {m} - h ELSE h END AS h FROM mm_f3)")
    return ",\n".join(steps)


BUCKETS_CTE = f"""{FEATURES_CTE},
{murmur_cte("SELECT conta AS s FROM feat UNION ALL SELECT favorecido FROM feat")},
fb AS (SELECT feat.*, CAST(a.h % 64 AS INTEGER) AS fav_bucket, CAST(b.h % 32 AS INTEGER) AS cta_bucket
    FROM feat JOIN murmur a ON a.s = feat.favorecido JOIN murmur b ON b.s = feat.conta)"""

NUMERIC = ("year", "valor_adjusted", "month", "quarter", "day_of_week", "mean_value")
_scaler = ", ".join(
    f"avg({c}) AS mean_{c}, CASE WHEN min({c}) = max({c}) THEN 1.0 ELSE stddev_pop({c}) END AS scale_{c}" for c in NUMERIC
)
_z = ", ".join(f"(fb.{c} - mean_{c}) / scale_{c} AS z_{c}" for c in NUMERIC)
_w = lambda b: (
    f"w_{b} AS (SELECT category_key, {b}, CASE WHEN c < n THEN 1 / ((c / n) * (1 - c / n)) ELSE 1.0 END AS w_{b} FROM "
    f"(SELECT category_key, {b}, count(*)::DOUBLE AS c FROM fb WHERE split = 'train' GROUP BY ALL) "
    f"JOIN (SELECT category_key, count(*)::DOUBLE AS n FROM fb WHERE split = 'train' GROUP BY ALL) USING (category_key))"
)
POINTS_CTE = f"""{BUCKETS_CTE},
scaler AS (SELECT category_key, count(*) AS n, {_scaler} FROM fb WHERE split = 'train' GROUP BY category_key),
{_w('fav_bucket')},
{_w('cta_bucket')},
pts AS (SELECT record_id, fb.category_key AS category_key, split, {_z}, fb.fav_bucket AS fav_bucket, fb.cta_bucket AS cta_bucket,
    coalesce(w_fav_bucket, 1.0) AS w_fav, coalesce(w_cta_bucket, 1.0) AS w_cta
    FROM fb JOIN scaler USING (category_key)
    LEFT JOIN w_fav_bucket USING (category_key, fav_bucket) LEFT JOIN w_cta_bucket USING (category_key, cta_bucket))"""

_d2 = " + ".join(f"(q.z_{c} - r.z_{c}) * (q.z_{c} - r.z_{c})" for c in NUMERIC)
DISTANCE = (
    f"sqrt({_d2} + CASE WHEN q.fav_bucket = r.fav_bucket THEN 0 ELSE q.w_fav + r.w_fav END "
    f"+ CASE WHEN q.cta_bucket = r.cta_bucket THEN 0 ELSE q.w_cta + r.w_cta END)"
)

CONTAMINATION_CTE = """
quart AS (SELECT category_key, quantile_cont(valor_adjusted, 0.25) AS q1, quantile_cont(valor_adjusted, 0.75) AS q3
    FROM feat WHERE split = 'train' GROUP BY category_key),
fence AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM quart),
cont AS (SELECT category_key, q1, q3, lower, upper, count(*) AS n_train,
    sum(CASE WHEN valor_adjusted < lower OR valor_adjusted > upper THEN 1 ELSE 0 END)::BIGINT AS n_outliers,
    avg(CASE WHEN valor_adjusted < lower OR valor_adjusted > upper THEN 1.0 ELSE 0.0 END) AS outlier_share,
    greatest(0.01, least(0.15, avg(CASE WHEN valor_adjusted < lower OR valor_adjusted > upper THEN 1.0 ELSE 0.0 END))) AS contamination
    FROM feat JOIN fence USING (category_key) WHERE split = 'train' GROUP BY ALL)"""



def thresholds_cte(name: str, source: str, keys: str, value: str, out: str) -> str:
    """Quantile of `value` at 1 less the category's contamination, interpolated, per `keys` (with category_key)."""
    return f"""{name} AS (SELECT {keys}, lo + (hi - lo) * part AS {out} FROM (
    SELECT {keys}, max(CASE WHEN rn = floor(pos) THEN v END) AS lo, max(CASE WHEN rn = ceil(pos) THEN v END) AS hi, any_value(pos - floor(pos)) AS part
    FROM (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS rn,
        (1 - contamination) * (count(*) OVER (PARTITION BY {keys}) - 1) AS pos FROM {source} JOIN cont USING (category_key)) GROUP BY {keys}))"""


PANEL_CTE = f"""{FEATURES_CTE},{CONTAMINATION_CTE},
sc AS (SELECT category_key, avg(valor_adjusted) AS mu, stddev_pop(valor_adjusted) AS sd FROM feat WHERE split = 'train' GROUP BY ALL),
raw AS (SELECT feat.*, abs((valor_adjusted - mu) / sd) AS raw_spread, abs(valor_adjusted - mean_value) AS raw_drift
    FROM feat JOIN sc USING (category_key)),
raw_train AS (SELECT * FROM raw WHERE split = 'train'),
{thresholds_cte('lim_s', 'raw_train', 'category_key', 'raw_spread', 't_spread')},
{thresholds_cte('lim_d', 'raw_train', 'category_key', 'raw_drift', 't_drift')},
lim AS (SELECT * FROM lim_s JOIN lim_d USING (category_key)),
scored AS (SELECT raw.*, CAST(raw_spread > t_spread AS INTEGER) AS anomaly_spread, CAST(raw_drift > t_drift AS INTEGER) AS anomaly_drift,
    (raw_spread - min(raw_spread) OVER c) / (max(raw_spread) OVER c - min(raw_spread) OVER c) AS score_spread,
    (raw_drift - min(raw_drift) OVER c) / (max(raw_drift) OVER c - min(raw_drift) OVER c) AS score_drift
    FROM raw JOIN lim USING (category_key) WHERE split <> 'train' WINDOW c AS (PARTITION BY category_key)),
pred AS (SELECT *, CAST(anomaly_spread + anomaly_drift = 2 AS INTEGER) AS ensemble_flag,
    (score_spread + score_drift) / 2 AS ensemble_score FROM scored),
flagged AS (SELECT *, ensemble_score * ln(1 + greatest(valor_adjusted, 0)) AS audit_score FROM pred WHERE ensemble_flag = 1)"""


def brl(c: str) -> str:
    return f"'R$ ' || translate(format('{{:,.2f}}', {c}), ',.', '.,')"
