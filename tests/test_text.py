import pytest
from pyspark.sql import functions as F

from spendguard.functions import (
    audit_score,
    category_key,
    fold_ascii,
    format_brl,
    hash_bucket,
    null_token,
    one_hot,
    parse_decimal_br,
    parse_timestamp,
)
from spendguard.operators import clean


def column(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "text, value",
    [
        ("1.234,56", 1234.56), ("-10,00", -10.0), (" 7 ", 7.0), ("1e3", 1000.0), ("+5,5", 5.5),
        ("abc", None), ("", None), ("  ", None), (None, None), ("nan", None), ("inf", None), ("12d", None),
        ("1,2,3", None), (".", None), ("1_000", None), ("0x10", None),
    ],
)
def test_parse_decimal(spark, text, value):
    assert column(spark, [text], parse_decimal_br) == [value]


def test_format_brl_roundtrip(spark):
    values = [33178.5, 0.0, -1234567.891, 0.005, None]
    shown = column(spark, values, format_brl, "double")
    assert shown[0] == "R$ 33.178,50" and shown[1] == "R$ 0,00" and shown[2] == "R$ -1.234.567,89" and shown[4] == "R$ —"


def test_fold_and_key(spark):
    assert column(spark, ["DEVOLUÇÃO", "Straße", "São João/Ção", "ÆØÅ", "café"], fold_ascii) == [
        "DEVOLUCAO", "Strasse", "Sao Joao/Cao", "AEOA", "cafe",
    ]
    assert column(spark, ["Verba indenizatória", "Correspondência / Telegrama"], category_key) == [
        "VERBA_INDENIZATORIA", "CORRESPONDENCIA___TELEGRAMA",
    ]


def test_null_tokens_and_dates(spark):
    assert column(spark, [" a ", "nan", "", None, "NA", "None"], null_token) == ["a", None, None, None, None, None]
    days = column(spark, ["2020-01-31", "31/01/2020", "x", None], lambda c: parse_timestamp(c, clean.DATE_FORMATS).cast("date").cast("string"))
    assert days == ["2020-01-31", "2020-01-31", None, None]


def test_reversal_words(spark):
    texts = ["DEVOLUÇÃO de diária", "Estorno", "cancelamento total", "diária", None]
    df = spark.createDataFrame([(t, 1.0) for t in texts] + [("diária", -1.0)], "`Descrição` string, `Valor` double")
    assert [r[0] for r in clean.tag_reversal(df).select("is_reversal").collect()] == [True, True, True, False, False, True]


def test_compat_buckets_match_published_names(spark):
    assert column(spark, ["Marquito"], lambda c: hash_bucket(c, 64, "compat")) == [43]
    assert column(spark, ["Marquito"], lambda c: hash_bucket(c, 32, "compat")) == [11]
    longer = ["", "a", "ab", "abc", "abcd", "Nome Comprido de Favorecido Ltda.", "ação", None]
    assert all(0 <= b < 64 for b in column(spark, longer, lambda c: hash_bucket(c, 64, "compat")))


def test_one_hot_and_audit_score(spark):
    assert column(spark, [2], lambda c: one_hot(c, 4), "int") == [[0.0, 0.0, 1.0, 0.0]]
    assert column(spark, [-5.0], lambda c: audit_score(F.lit(0.5), c), "double") == [0.0]


def test_counters_come_with_the_main_job(spark):
    df = spark.createDataFrame([(False, 1.0), (True, -2.0), (False, 4.0)], "is_reversal boolean, valor double")
    counted, seen = clean.ingestion_counters(df)
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 3 and seen.get["reversals"] == 1 and seen.get["valor_min"] == -2.0


def test_white_space_and_missing_tokens(spark):
    from spendguard.functions.text import null_token, parse_decimal_br

    df = spark.createDataFrame([("12,5\t", " nan\t"), ("\u00a01,0 ", "1.#IND"), ("x", " a b\n")], "v string, t string")
    got = df.select(parse_decimal_br(F.col("v")), null_token(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(12.5, None), (1.0, None), (None, "a b")]


def test_dropped_amounts_are_counted(spark):
    df = spark.createDataFrame([("1,0",), ("abc",), (None,), ("2,5",)], "Valor string")
    kept, counters = clean.counted_amounts(df, "dropped")
    assert sorted(r["Valor"] for r in kept.collect()) == [1.0, 2.5]
    assert counters.get == {"rows_read": 4, "rows_dropped": 2}
