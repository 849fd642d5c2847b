import csv
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spendguard.operators import clean, features
from spendguard.params import Params
from spendguard.scratch import session_conf
from spendguard.sources import load_or_build, read_expenses, read_index, write_layer
from spendguard.sources.quoted import inside_after

HEADER = "Verba;Descrição;Conta;Favorecido;Trecho;Vencimento;Valor"


def write_year(folder, year, lines):
    (folder / f"expenses_{year}.csv").write_bytes("\n".join([HEADER, *lines, ""]).encode("latin-1"))


@pytest.fixture
def raw(spark, tmp_path):
    write_year(tmp_path, 2019, [
        "DIÁRIAS;Diária;Ana;;SP;2019-02-04;1.234,56",
        'DIÁRIAS;"a;b";Ana;Bia;;2019-03-04;10,00',
        "DIÁRIAS;x;Ana;Bia;;2019-03-04;10,00;extra",
        "DIÁRIAS;curta;Ana",
        "DIÁRIAS;Diária;Ana;nan;;x;-10,00",
    ])
    write_year(tmp_path, 2020, [
        "GRÁFICA;Estorno;Caio;Bia;;2020-01-01;5,00",
        "GRÁFICA;Estorno;Caio;Bia;;2020-01-01;5,00",
        ";sem verba;Caio;Bia;;2020-01-01;7,00",
        "GRÁFICA;ruim;Caio;Bia;;2020-01-01;abc",
    ])
    return read_expenses(spark, str(tmp_path))


def test_rows_and_years(raw):
    assert raw.groupBy("year").count().orderBy("year").collect() == [(2019, 4), (2020, 4)]
    assert raw.where(F.col("Descrição") == "a;b").count() == 1
    assert raw.where("Conta = 'Ana' and Valor is null").count() == 1


def test_record_ids_are_unique_and_repeatable(raw):
    ids = sorted(r[0] for r in raw.select("record_id").collect())
    assert len(set(ids)) == 8
    assert ids == sorted(r[0] for r in raw.repartition(5).select("record_id").collect())


def test_many_copies_of_one_row(raw, monkeypatch):
    from spendguard.sources import expenses

    whole = sorted(r[0] for r in raw.select("record_id").collect())
    monkeypatch.setattr(expenses, "_COPIES", 2)
    columns = expenses.RAW_COLUMNS
    copies = raw.drop("record_id").withColumn("_file", F.lit("f")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(7))))
    ids = [r[0] for r in expenses._with_ids(copies.drop("_k"), columns).select("record_id").collect()]
    assert len(ids) == len(set(ids)) == 7 * len(whole)


def test_clean(raw):
    out = clean.clean_expenses(raw)
    assert out.count() == 6
    assert out.where("is_reversal").count() == 3
    first = out.where("valor_raw = '1.234,56'").first()
    assert first.valor == 1234.56 and first.favorecido is None and str(first.vencimento.date()) == "2019-02-04"
    assert out.where("vencimento is null").count() == 1
    assert out.where("verba is null").count() == 1


def test_missing_input(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_expenses(spark, str(tmp_path / "nothing"))


def test_index_and_default_factor(spark, tmp_path, raw):
    (tmp_path / "series.txt").write_text("year,ipca_correction_factor\n2019,2.0\n")
    adjusted = features.adjust_amount(clean.clean_expenses(raw), read_index(spark, str(tmp_path / "series.txt")))
    factors = adjusted.groupBy("year").agg(F.min("ipca_factor"), F.max("ipca_factor")).orderBy("year").collect()
    assert factors == [(2019, 2.0, 2.0), (2020, 1.0, 1.0)]


def test_features_of_missing_values(raw):
    params = Params(train_years=(2019,), test_years=(2020,), inference_years=(), excluded_years=())
    adjusted = clean.clean_expenses(raw).withColumn("valor_adjusted", F.col("valor"))
    out = features.engineer_features(adjusted, params)
    rows = {r.valor_adjusted: r for r in out.collect()}
    assert set(rows) == {1234.56, 10.0}  # reversals and rows without a category are not modelled
    assert rows[1234.56].favorecido == "Ana" and rows[1234.56].day_of_week == 0 and rows[1234.56].mean_value == pytest.approx(622.28)
    no_date = features.date_features(adjusted.where("vencimento is null")).first()
    assert (no_date.month, no_date.quarter, no_date.day_of_week) == (0, 0, 0)


def test_split_counters(raw):
    params = Params(train_years=(2019,), test_years=(2020,))
    rows = features.assign_split(clean.clean_expenses(raw).withColumn("valor_adjusted", F.col("valor")), params)
    counted, seen = features.split_counters(rows)
    counted.write.format("noop").mode("overwrite").save()
    assert (seen.get["train"], seen.get["test"], seen.get["reversals"]) == (2, 1, 3)


def test_layers(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).withColumn("category_key", (F.col("id") % 2).cast("string"))

    path = str(tmp_path / "layer")
    for _ in range(2):
        assert load_or_build(spark, path, build, ["category_key"]).count() == 10
    assert len(calls) == 1
    write_layer(spark.createDataFrame([(99, "1")], "id bigint, category_key string"), path)
    left = spark.read.parquet(path)
    assert left.where("category_key = 0").count() == 5 and left.where("category_key = 1").count() == 1


def test_ids_tell_apart_where_a_value_stands(spark, tmp_path):
    rows = ["Verba;Descrição;Conta;Favorecido;Trecho;Vencimento;Valor", "A;d;c;X;;2011-01-01;1,0", "A;d;c;;X;2011-01-01;1,0", "A;d;c;X;;2011-01-01;1,0"]
    (tmp_path / "x_2011.csv").write_text("\n".join(rows), encoding="latin-1")
    out = read_expenses(spark, str(tmp_path / "x_2011.csv"))
    assert out.count() == out.select("record_id").distinct().count() == 3


def test_scopes_delete_their_tables(spark):
    from spendguard.scratch import delete, keep, materialise, scope

    with scope(spark) as paths:
        materialise(spark.range(3), "inner")
        kept = keep(spark.range(4), "outer")
        assert len(paths) == 1 and spark.read.parquet(paths[0]).count() == 3
    assert kept.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(paths[0])
    delete(spark, kept.inputFiles()[0])


def rows_by_csv_module(path):
    with open(path, encoding="latin-1", newline="") as lines:
        rows = list(csv.reader(lines, delimiter=";"))[1:]
    return [tuple(v.replace("\r\n", "\n") or None for v in r) + (None,) * (7 - len(r)) for r in rows if r and len(r) <= 7]


@pytest.mark.parametrize("split_bytes", [300, 100_000])
def test_quoted_line_breaks(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    texts = ["plain", '"a\nb"', '"x;""y""\n\n;z"', '5" pipe', '""', '"é\n;"', "", '"long\n' + "line\n" * 80 + 'end"']
    for year in (2019, 2020, 2021):
        write_year(tmp_path, year, [
            ";".join(rng.choice(texts) for _ in range(rng.choice([7, 7, 7, 7, 3, 8]))) for _ in range(30)
        ] if year != 2021 else [])
    want = sum((rows_by_csv_module(tmp_path / f"expenses_{y}.csv") for y in (2019, 2020, 2021)), [])
    with session_conf(spark, spark__sql__files__maxPartitionBytes=split_bytes, spark__sql__files__openCostInBytes=1):
        got = read_expenses(spark, str(tmp_path), line_breaks=True)
        rows = [tuple(r) for r in got.drop("record_id", "year").collect()]
        years = {r[0] for r in got.select("year").distinct().collect()}
    order = lambda r: tuple(v or "" for v in r)
    assert sorted(rows, key=order) == sorted(want, key=order)
    assert years == {2019, 2020}


def test_state_at_line_ends():
    for line, outside, inside in [
        (b"a;b", False, True), (b'a;"b', True, False), (b'"a;b"', False, False), (b'b";c', False, False), (b'5" x', False, False),
        (b'a""b', False, True), (b'x";"y', True, True), (b"", False, True),
    ]:
        assert (inside_after(line, False, b";"), inside_after(line, True, b";")) == (outside, inside), line
