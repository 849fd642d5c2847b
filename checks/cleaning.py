"""Sources, parsing, splits and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    BUCKETS_CTE,
    FEATURES_CTE,
    LINEITEM_CTE,
    ORDERS_CTE,
    PARAMS,
    adjusted_lineitems,
    adjusted_orders,
    brl,
    key_sql,
    lineitems,
    order_features,
    orders,
    query,
    table,
)
from spendguard.functions import category_key, format_brl, hash_bucket, null_token, one_hot, parse_decimal_br
from spendguard.operators import clean, features
from spendguard.scratch import scratch_path
from spendguard.sources import load_or_build, read_expenses, read_layer, write_layer

_ROUND = "translate(format('{:,.2f}', l_extendedprice), ',.', '.,')"


@query(
    "amount_text_roundtrip",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {brl('l_extendedprice')} AS valor_raw, "
    "round(l_extendedprice, 2) AS valor FROM lineitem",
)
def amount_text_roundtrip(spark, sf_dir):
    text = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", format_brl(F.col("l_extendedprice")).alias("valor_raw")
    )
    return text.withColumn("valor", F.round(parse_decimal_br(F.substring("valor_raw", 4, 40)), 2))


_MESSY = f"""SELECT l_orderkey, l_partkey, l_linenumber, CASE l_partkey % 9
    WHEN 0 THEN {_ROUND} WHEN 1 THEN {_ROUND} || 'd' WHEN 2 THEN '  ' WHEN 3 THEN '-' || {_ROUND} WHEN 4 THEN 'nan'
    WHEN 5 THEN ' ' || {_ROUND} || ' ' WHEN 6 THEN 'abc' WHEN 7 THEN '1,2,3' ELSE NULL END AS valor_raw FROM lineitem"""


@query(
    "unparseable_amounts",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, valor_raw,
    round(CAST(replace(replace(trim(valor_raw), '.', ''), ',', '.') AS DOUBLE), 2) AS valor
    FROM ({_MESSY}) WHERE l_partkey % 9 IN (0, 3, 5)""",
)
def unparseable_amounts(spark, sf_dir):
    price = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    kinds = [
        price, F.concat(price, F.lit("d")), F.lit("  "), F.concat(F.lit("-"), price), F.lit("nan"),
        F.concat(F.lit(" "), price, F.lit(" ")), F.lit("abc"), F.lit("1,2,3"),
    ]
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.get(F.array(*kinds), (F.col("l_partkey") % 9).cast("int")).alias("Valor"),
    )
    return clean.parse_amount(raw).withColumn("valor", F.round("Valor", 2))


_WORDS = ("eaux", "oure", "ndern")


@query(
    "reversal_tag",
    f"""SELECT doc_id, regexp_matches(strip_accents(lower(text)), '{'|'.join(_WORDS)}') OR n_chars - 400 < 0 AS is_reversal
    FROM documents""",
)
def reversal_tag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("amount", F.col("n_chars") - 400)
    return clean.tag_reversal(docs, text="text", amount="amount", keywords=_WORDS).select("doc_id", "is_reversal")


@query(
    "null_tokens",
    """SELECT c_custkey, nullif(nullif(trim(v), 'nan'), '') AS value FROM (SELECT c_custkey, CASE c_custkey % 4
    WHEN 0 THEN 'nan' WHEN 1 THEN '  ' || c_mktsegment || ' ' WHEN 2 THEN '' ELSE c_mktsegment END AS v FROM customer)""",
)
def null_tokens(spark, sf_dir):
    k = F.col("c_custkey") % 4
    value = F.when(k == 0, "nan").when(k == 1, F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).when(k == 2, "").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", null_token(value).alias("value"))


@query("category_keys", f"SELECT p_partkey, {key_sql('p_type')} AS category_key FROM part")
def category_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", category_key(F.col("p_type")).alias("category_key"))


@query(
    "folded_texts",
    "SELECT doc_id, md5(replace(strip_accents(text), 'ß', 'ss')) AS folded_md5 FROM documents",
)
def folded_texts(spark, sf_dir):
    from spendguard.functions import fold_ascii

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold_ascii(F.col("text"))).alias("folded_md5"))


_CSV = f"""SELECT verba, conta, favorecido, trecho, vencimento, valor, year, is_reversal FROM (
    SELECT o_orderpriority AS verba, CAST(o_custkey AS VARCHAR) AS conta,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS favorecido, CAST(o_orderkey AS VARCHAR) AS trecho,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS vencimento,
    round(o_totalprice, 2) * CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE 1 END AS valor,
    CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 AS is_reversal
    FROM orders WHERE o_orderkey % 19 <> 0)"""


@query("csv_ingestion", _CSV)
def csv_ingestion(spark, sf_dir):
    """Write `orders` as yearly Latin-1 files with bad rows among them, then ingest those files."""
    key, text = F.col("o_orderkey"), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    sign = F.when(key % 13 == 0, "-").otherwise("")
    amount = F.concat(sign, F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    fields = [
        F.col("o_orderpriority"),
        F.when(key % 17 == 0, "DEVOLUÇÃO de diária").otherwise("Diária"),
        text(F.col("o_custkey")),
        F.when(key % 3 != 0, F.col("o_orderstatus")).otherwise("nan"),
        text(key),
        F.when(key % 11 == 0, "x").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        amount,
    ]
    # Every 19th line has a field too many and must be skipped.
    line = F.concat_ws(";", *fields, F.when(key % 19 == 0, "extra"))
    header = "Verba;Descrição;Conta;Favorecido;Trecho;Vencimento;Valor"
    root = scratch_path(spark, "yearly_csv")
    (
        table(spark, sf_dir, "orders")
        .select(line.alias(header), F.concat(F.lit("expenses_"), F.year("o_orderdate"), F.lit(".csv")).alias("file"))
        .write.partitionBy("file")
        .option("header", True)
        .option("sep", "\u0001")
        .option("quote", "")
        .option("encoding", "ISO-8859-1")
        .csv(root)
    )
    cleaned = clean.clean_expenses(read_expenses(spark, f"{root}/file=*"))
    return cleaned.select("verba", "conta", "favorecido", "trecho", "vencimento", "valor", "year", "is_reversal")


@query(
    "quoted_csv_ingestion",
    """SELECT o_orderpriority AS verba, 'Diária "' || o_orderstatus || '"' || chr(10) || 'linha; ' || o_custkey AS descricao,
    o_orderkey::VARCHAR AS trecho, year(o_orderdate)::INTEGER AS year FROM orders""",
)
def quoted_csv_ingestion(spark, sf_dir):
    """Write `orders` as yearly files whose quoted fields hold line breaks, quotes and separators, then read those files."""
    text = F.concat(F.lit('Diária "'), "o_orderstatus", F.lit('"\nlinha; '), F.col("o_custkey").cast("string"))
    fields = [
        F.col("o_orderpriority").alias("Verba"), text.alias("Descrição"), F.lit("").alias("Conta"), F.lit(None).cast("string").alias("Favorecido"),
        F.col("o_orderkey").cast("string").alias("Trecho"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Vencimento"), F.lit("1,00").alias("Valor"),
    ]
    root = scratch_path(spark, "quoted_csv")
    (
        table(spark, sf_dir, "orders")
        .select(*fields, F.concat(F.lit("expenses_"), F.year("o_orderdate"), F.lit(".csv")).alias("file"))
        .write.partitionBy("file").option("header", True).option("sep", ";").option("escape", '"').option("encoding", "ISO-8859-1").csv(root)
    )
    read = read_expenses(spark, f"{root}/file=*", line_breaks=True)
    return read.select(F.col("Verba").alias("verba"), F.col("Descrição").alias("descricao"), F.col("Trecho").alias("trecho"), "year")


@query(
    "layer_roundtrip",
    f"WITH {FEATURES_CTE} SELECT category_key, split, count(*) AS n, round(sum(valor_adjusted), 2) AS total FROM feat GROUP BY ALL",
)
def layer_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "layer")
    write_layer(order_features(spark, sf_dir), path)
    layer = load_or_build(spark, path, lambda: order_features(spark, sf_dir))
    assert read_layer(spark, path).columns == layer.columns
    return layer.groupBy("category_key", "split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("valor_adjusted"), 2).alias("total")
    )


@query(
    "adjusted_amounts",
    f"WITH {ORDERS_CTE} SELECT record_id, year, ipca_factor, round(valor_adjusted, 4) AS valor_adjusted FROM adj",
)
def adjusted_amounts(spark, sf_dir):
    return adjusted_orders(spark, sf_dir).select(
        "record_id", "year", "ipca_factor", F.round("valor_adjusted", 4).alias("valor_adjusted")
    )


@query(
    "split_sizes",
    f"WITH {LINEITEM_CTE} SELECT split, CASE split WHEN 'train' THEN 'Treinamento' WHEN 'test' THEN 'Avaliação' "
    "WHEN 'infer' THEN 'Inferência' WHEN 'excluded' THEN 'Excluído (COVID)' ELSE 'Outro' END AS split_label, "
    "is_reversal, count(*) AS n FROM adj GROUP BY ALL",
)
def split_sizes(spark, sf_dir):
    labelled = features.split_label(adjusted_lineitems(spark, sf_dir))
    return labelled.groupBy("split", "split_label", "is_reversal").agg(F.count(F.lit(1)).alias("n"))


@query("excluded_years", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) NOT IN (1995,1996,1998,1999,2000,2001)")
def excluded_years(spark, sf_dir):
    return features.excluded_years(orders(spark, sf_dir), PARAMS)


@query(
    "group_means",
    f"WITH {FEATURES_CTE} SELECT record_id, split, round(mean_value, 7) AS mean_value FROM feat",
)
def group_means(spark, sf_dir):
    return order_features(spark, sf_dir).select("record_id", "split", F.round("mean_value", 7).alias("mean_value"))


@query(
    "group_means_over_rows",
    f"""WITH {LINEITEM_CTE} SELECT verba, conta, round(valor_adjusted, 4) AS valor_adjusted,
    round(avg(valor_adjusted) OVER (PARTITION BY verba, conta), 7) AS mean_value FROM adj""",
)
def group_means_over_rows(spark, sf_dir):
    rows = features.group_mean_over_rows(adjusted_lineitems(spark, sf_dir), PARAMS)
    return rows.select(
        "verba", "conta", F.round("valor_adjusted", 4).alias("valor_adjusted"), F.round("mean_value", 7).alias("mean_value")
    )


@query(
    "model_features",
    f"""WITH {BUCKETS_CTE} SELECT record_id, category_key, split, conta, favorecido, year,
    round(valor_adjusted, 4) AS valor_adjusted, month, quarter, day_of_week, round(mean_value, 7) AS mean_value,
    fav_bucket, cta_bucket FROM fb""",
)
def model_features(spark, sf_dir):
    return order_features(spark, sf_dir).select(
        "record_id", "category_key", "split", "conta", "favorecido", "year",
        F.round("valor_adjusted", 4).alias("valor_adjusted"), "month", "quarter", "day_of_week",
        F.round("mean_value", 7).alias("mean_value"), "fav_bucket", "cta_bucket",
    )


@query(
    "missing_dates_and_payees",
    f"""WITH {LINEITEM_CTE} SELECT verba, conta, coalesce(favorecido, conta) AS favorecido,
    CASE WHEN valor > 50000 THEN 0 ELSE month(vencimento) END::INTEGER AS month,
    CASE WHEN valor > 50000 THEN 0 ELSE quarter(vencimento) END::INTEGER AS quarter,
    CASE WHEN valor > 50000 THEN 0 ELSE isodow(vencimento) - 1 END::INTEGER AS day_of_week,
    count(*) AS n FROM adj GROUP BY ALL""",
)
def missing_dates_and_payees(spark, sf_dir):
    rows = lineitems(spark, sf_dir).withColumn("vencimento", F.when(F.col("valor") <= 50000, F.col("vencimento")))
    dated = features.date_features(features.fill_counterparty(rows))
    return dated.groupBy("verba", "conta", "favorecido", "month", "quarter", "day_of_week").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "one_hot_totals",
    f"""WITH {BUCKETS_CTE}, hot AS (SELECT cta_bucket AS bucket, count(*) AS n FROM fb GROUP BY 1)
    SELECT CAST(b AS INTEGER) AS bucket, coalesce(n, 0) AS n FROM range(32) t(b) LEFT JOIN hot ON hot.bucket = t.b""",
)
def one_hot_totals(spark, sf_dir):
    hot = order_features(spark, sf_dir).select(F.posexplode(one_hot(F.col("cta_bucket"), 32)).alias("bucket", "v"))
    return hot.groupBy("bucket").agg(F.sum("v").cast("bigint").alias("n"))


@query("native_buckets")
def native_buckets(spark, sf_dir):
    rows = lineitems(spark, sf_dir)
    return rows.groupBy(hash_bucket(F.col("conta"), 32).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("conta").alias("n_contas")
    )


@query("expanded_features")
def expanded_features(spark, sf_dir):
    return features.expand_buckets(order_features(spark, sf_dir), PARAMS)




@query(
    "eligible_categories",
    f"""WITH {LINEITEM_CTE}, c AS (SELECT {key_sql('verba')} AS category_key,
    count(*) FILTER (split = 'train') AS n_train FROM adj WHERE split IN ('train', 'test', 'infer') AND NOT is_reversal
    GROUP BY ALL) SELECT category_key, n_train, n_train >= 8000 AS eligible FROM c WHERE n_train > 0""",
)
def eligible_categories(spark, sf_dir):
    rows = features.prepare_rows(features.modelled_rows(adjusted_lineitems(spark, sf_dir)), PARAMS.with_(hash_mode="native"))
    limit = PARAMS.with_(min_rows_train=8000)
    kept = features.eligible_categories(rows, limit).withColumn("eligible", F.lit(True))
    return kept.unionByName(features.skipped_categories(rows, limit).withColumn("eligible", F.lit(False)))
