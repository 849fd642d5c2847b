"""The whole job on a small generated table."""

import pytest
from pyspark.sql import functions as F

from spendguard.operators import rank
from spendguard.params import Params
from spendguard.plans import list_models, load_models, predict, run, save_models, score_batch, score_records
from spendguard.scratch import materialise
from spendguard.sources import as_expenses, read_layer, read_results, write_layer, write_metrics, write_ranking, write_results, write_run
from spendguard.sources.sets import manifests, read_set, write_set

PARAMS = Params(
    train_years=(2018, 2019), test_years=(2020,), inference_years=(2021,), excluded_years=(), min_rows_train=100,
    detectors=("knn", "lof", "iforest"), iforest_trees=20, iforest_sample=64, knn_k_candidates=(3, 5), lof_k_candidates=(3, 5),
    shap_max_records=50,
)


@pytest.fixture(scope="module")
def expenses(spark):
    n = 1600
    u, v = F.rand(1), F.rand(2)
    base = spark.range(n).select(
        "id",
        F.when(F.col("id") % 2 == 0, "Diárias").when(F.col("id") % 40 == 1, "Rara").otherwise("Correio / Selos").alias("verba"),
        F.concat(F.lit("C"), (F.col("id") % 7).cast("string")).alias("conta"),
        F.concat(F.lit("F"), (F.col("id") % 5).cast("string")).alias("favorecido"),
        (2018 + F.floor(v * 4)).cast("int").alias("year"),
        F.when(F.col("id") % 100 == 0, 90_000 + 1000 * u).otherwise(100 + 50 * u).alias("valor"),
    )
    base = base.withColumn("due", F.make_date(F.col("year"), (F.col("id") % 12 + 1).cast("int"), F.lit(5)))
    return materialise(
        as_expenses(base, F.col("id"), F.col("verba"), F.col("conta"), F.col("valor"), F.col("due"), F.col("favorecido"), year=F.col("year")),
        "expenses",
    )


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([(2018, 1.5), (2019, 1.2)], "year int, ipca_correction_factor double")


@pytest.fixture(scope="module")
def done(expenses, index):
    return run(expenses, index, PARAMS)


def test_predictions(done):
    p = done.predictions
    assert p.where("ensemble_flag <> cast(anomaly_knn + anomaly_lof + anomaly_iforest = 3 as int)").isEmpty()
    assert p.where("abs(ensemble_score - (score_knn + score_lof + score_iforest) / 3) > 1e-12").isEmpty()
    assert p.where("least(score_knn, score_lof, score_iforest) < 0 or greatest(score_knn, score_lof, score_iforest) > 1").isEmpty()
    assert {r[0] for r in p.select("category_key").distinct().collect()} == {"DIARIAS", "CORREIO___SELOS"}
    assert {r[0] for r in p.select("split").distinct().collect()} == {"test", "infer"}
    ranked = p.where("category_key = 'DIARIAS'").orderBy(F.col("score_iforest").desc()).limit(3).collect()
    assert all(r.valor_adjusted > 80_000 for r in ranked)


def test_metrics_and_reports(done):
    metrics = {r.category: r for r in done.metrics.collect()}
    for m in metrics.values():
        assert m.flagged_pct == pytest.approx(round(100 * m.n_flagged_ensemble / m.n_records, 4))
        assert set(m.individual_model_rates) == {"knn", "lof", "iforest"}
    assert done.temporal.agg(F.sum("n_records")).first()[0] == done.predictions.where("year <= 2025").count()
    assert done.reversals.first().total_reversals == 0


def test_attributions_explain_flagged_records(done):
    flagged = done.predictions.where("ensemble_flag = 1").count()
    per_record = done.attributions.groupBy("category_key", "record_id").agg(F.count("*").alias("n"))
    assert per_record.count() == min(flagged, 50 * 2) and per_record.where("n <> 102").isEmpty()


def test_save_load_predict(spark, done, tmp_path):
    save_models(done.models, str(tmp_path))
    loaded = load_models(spark, str(tmp_path), PARAMS)
    assert [r[0] for r in list_models(loaded).collect()] == ["CORREIO___SELOS", "DIARIAS"]
    again = predict(done.features.where("split in ('test', 'infer')"), loaded)
    both = again.select("record_id", F.col("ensemble_score").alias("s"), F.col("ensemble_flag").alias("f")).join(done.predictions, "record_id")
    assert both.count() == done.predictions.count()
    assert both.where("abs(s - ensemble_score) > 1e-9 or f <> ensemble_flag").isEmpty()


def test_known_categories_are_not_fitted_again(expenses, index, done, monkeypatch):
    import sys

    module = sys.modules["spendguard.plans.run"]
    monkeypatch.setattr(module, "fit", lambda *a, **k: pytest.fail("fitted again"))
    eligible = expenses.where("verba <> 'Rara'")
    again = run(eligible, index, PARAMS, models=done.models, category="diarias")
    assert again.predictions.count() == done.predictions.where("category_key = 'DIARIAS'").count()


def test_unknown_category_lists_the_known_ones(expenses, index):
    with pytest.raises(ValueError, match="CORREIO___SELOS, DIARIAS, RARA"):
        run(expenses, index, PARAMS, category="nada")


def test_score_records_with_raw_names_and_unknown_category(spark, done, index):
    rows = [
        (1, "Diárias", "C1", None, "2020-03-05", "95.000,00"), (2, "Nova", "C1", "F1", "x", "10,00"),
        (3, "Diárias", "C1", "F1", None, "abc"), (4, "Diárias", "C2", "F2", "2019-04-05", "-120,00"),
    ]
    raw = spark.createDataFrame(rows, "record_id bigint, Verba string, Conta string, Favorecido string, Vencimento string, Valor string")
    out = {r.record_id: r for r in score_records(raw, index, done.models["group_means"], done.models).collect()}
    assert len(out) == 4
    assert out[2].ensemble_flag == -1 and out[2].ensemble_score == 0.0 and out[2].error == "No model for category NOVA"
    assert out[3].valor_adjusted == 0.0 and out[3].year == 2025 and out[2].year == 2025
    assert out[4].is_reversal and out[4].valor_adjusted == pytest.approx(-144.0)
    assert out[1].ensemble_score > 0.3 and 0 <= out[1].score_knn <= 1


def test_score_batch_file(spark, done, index, tmp_path):
    lines = ["Verba;Descrição;Conta;Favorecido;Trecho;Vencimento;Valor", "Diárias;x;C1;F1;;2020-02-05;120,00", "Diárias;x;C1;F1;;2020-02-05;120,00;a;b", ""]
    (tmp_path / "new.csv").write_bytes("\n".join(lines).encode("latin-1"))
    out = score_batch(spark, str(tmp_path / "new.csv"), index, done.models["group_means"], done.models).collect()
    assert len(out) == 1 and out[0].ensemble_flag in (0, 1)


def test_result_files(spark, done, tmp_path):
    write_results(done.flagged, str(tmp_path / "r"))
    back = read_results(spark, str(tmp_path / "r"))
    assert back.count() == done.flagged.count()
    write_metrics(done.metrics, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    if not back.isEmpty():
        write_ranking(rank.ranking_document(back, 10, 2), str(tmp_path / "k"))
        assert spark.read.json(str(tmp_path / "k")).first().total_flagged == back.count()


def test_strategies(done):
    from spendguard.detectors.thresholds import ensemble

    base = done.predictions.drop("ensemble_flag", "ensemble_score")
    count = {s: ensemble(base, PARAMS.detectors, s).agg(F.sum("ensemble_flag")).first()[0] for s in ("consensus", "majority", "any")}
    assert count["consensus"] <= count["majority"] <= count["any"] and count["any"] > 0


def test_year_window():
    p = Params().for_year_range(2015, 2023)
    assert p.train_years == (2015, 2016, 2017, 2018, 2019, 2021, 2022) and p.test_years == (2023,)
    assert Params.from_dict({"train_years": [1], "unknown": 2}).train_years == (1,)


def test_whole_fits_and_subspace_degree(expenses, index):
    params = PARAMS.with_(detectors=("lof", "ocsvm"), include_sod=True)
    out = run(expenses, index, params)
    rows = out.features.where("split = 'train'").groupBy("category_key").count().withColumnRenamed("count", "n")
    fitted = out.models["lof"].groupBy("category_key").count()
    assert fitted.join(rows, "category_key").where("count <> n").isEmpty() and not fitted.isEmpty()
    references = out.models["sod"].groupBy("category_key").count()
    assert references.join(rows, "category_key").where("count <> n").isEmpty() and not references.isEmpty()
    p = out.predictions
    assert p.where("score_lof is null or score_ocsvm is null or score_sod is null").isEmpty()
    assert p.groupBy("category_key").agg(F.max("score_sod").alias("m")).where("m <> 1").isEmpty()
    assert out.attributions is None and "top_feature" not in out.flagged.columns


def test_results_of_a_later_run_leave_no_old_flags(spark, done, tmp_path):
    path = str(tmp_path / "flags")
    covered = done.models.registry().select("category_key")
    write_results(done.flagged, path, covered=covered)
    before = {r[0] for r in read_results(spark, path).select("category").distinct().collect()}
    one = sorted(before)[0]
    write_results(done.flagged.where(F.col("category_key") == one), path, covered=covered)
    assert {r[0] for r in read_results(spark, path).select("category").distinct().collect()} == {one}
    write_results(done.flagged.limit(0), path, covered=covered)
    assert read_results(spark, path).isEmpty()


def test_flags_vanish_by_default(spark, done, tmp_path):
    path = str(tmp_path / "flags")
    write_results(done.flagged, path)
    kept = sorted({r[0] for r in read_results(spark, path).select("category").collect()})[:1]
    write_results(done.flagged.where(F.col("category_key").isin(kept)), path)
    assert {r[0] for r in read_results(spark, path).select("category").collect()} == set(kept)
    write_run(done, path)
    assert read_results(spark, path).count() == done.flagged.count()
    assert read_set(spark, path)["metrics"].count() == 2


def test_models_saved_to_the_path_they_came_from(spark, expenses, index, done, tmp_path):
    path = str(tmp_path / "models")
    one = run(expenses, index, PARAMS, category="diarias")
    save_models(one.models, path)
    loaded = load_models(spark, path, PARAMS)
    assert [r[0] for r in list_models(loaded).collect()] == ["DIARIAS"]
    counts = {n: t.count() for n, t in loaded.tables.items()}
    both = run(expenses, index, PARAMS, models=loaded)
    save_models(both.models, path)
    again = load_models(spark, path, PARAMS)
    assert [r[0] for r in list_models(again).collect()] == ["CORREIO___SELOS", "DIARIAS"]
    for name, n in counts.items():
        if name != "group_means":
            assert again[name].where("category_key = 'DIARIAS'").count() == n
            assert loaded[name].count() == n  # the former version can still be read
    again_scored = predict(both.features.where("split = 'test'"), again).agg(F.sum("ensemble_score")).first()[0]
    assert again_scored == pytest.approx(predict(both.features.where("split = 'test'"), both.models).agg(F.sum("ensemble_score")).first()[0])


def rows_of(spark, *pairs):
    return spark.createDataFrame(pairs, "category_key string, x int")


def test_a_crash_between_two_tables_leaves_the_old_set(spark, tmp_path):
    path = str(tmp_path / "set")
    only = lambda *names: spark.createDataFrame([(n,) for n in names], "category_key string")
    write_set({"a": rows_of(spark, ("01", 1), ("y", 2)), "b": rows_of(spark, ("y", 3))}, path, only("01", "y"))
    broken = rows_of(spark, ("y", 9)).withColumn("x", F.expr("if(x = 9, raise_error('lost'), x)"))
    with pytest.raises(Exception, match="lost"):
        write_set({"a": rows_of(spark, ("y", 8)), "b": broken}, path, only("y"))
    read = lambda: {n: sorted(map(tuple, t.select("category_key", "x").collect())) for n, t in read_set(spark, path).items()}
    assert read() == {"a": [("01", 1), ("y", 2)], "b": [("y", 3)]}
    write_set({"a": rows_of(spark, ("z", 5), ("y", 7)), "b": rows_of(spark)}, path, only("y"))  # z is not covered
    assert read() == {"a": [("01", 1), ("y", 7)], "b": []}
    for i in range(3):
        write_set({"a": rows_of(spark, ("z", i))}, path, only("z"))
    assert read() == {"a": [("01", 1), ("y", 7), ("z", 2)], "b": []}
    assert len(manifests(spark, path)) == 2 and len(list((tmp_path / "set/data/a").iterdir())) == 4
    assert read_set(spark, str(tmp_path / "none")) == {}


def test_a_layer_rewritten_from_itself(spark, tmp_path):
    path = str(tmp_path / "layer")
    write_layer(rows_of(spark, ("a", 1), ("b", 2)), path)
    write_layer(read_layer(spark, path).where("x = 1"), path, covered=rows_of(spark, ("a", 0), ("b", 0)))
    assert [(r["category_key"], r["x"]) for r in read_layer(spark, path).collect()] == [("a", 1)]
