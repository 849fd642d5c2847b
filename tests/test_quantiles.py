import numpy as np
import pytest
from pyspark.sql import functions as F

from spendguard.operators import quantiles
from spendguard.operators.quantiles import exact_quantiles
from spendguard.operators.rank import distributed_rank
from spendguard.operators.sampling import sample_per_category


def numbers(spark, n):
    """A hot group with heavy ties, a wide one, a tiny one and a constant one."""
    r = F.rand(3)
    return spark.range(n).select(
        F.col("id").alias("record_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, "tiny").when(F.col("id") % 50 == 2, "flat").otherwise("wide").alias("category_key"),
        F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.floor(r * 20).cast("double")))
        .when(F.col("id") % 50 == 2, 1.5).otherwise(F.exp(r * 10)).alias("v"),
    )


@pytest.mark.parametrize(("n", "band_rows"), [(300, 50_000), (60_000, 50_000), (60_000, 20)])
def test_quantiles_equal_numpy(spark, n, band_rows):
    from spendguard.scratch import materialise

    df = materialise(numbers(spark, n), "numbers")
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    pdf = df.toPandas()
    found = {(r.category_key, r.p): r.quantile for r in exact_quantiles(df, ["category_key"], "v", probs, band_rows=band_rows).collect()}
    for key, part in pdf.groupby("category_key"):
        for p in probs:
            assert found[(key, p)] == pytest.approx(np.quantile(part.v, p), rel=1e-12)


def test_probability_per_group_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", float("nan"))], "k string, v double")
    per = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "k string, p double")
    assert sorted((r.k, r.quantile) for r in exact_quantiles(df, ["k"], "v", per_group=per).collect()) == [("a", 2.0), ("b", 2.5)]


def test_tasks_rank_bounded_bands(spark, monkeypatch):
    """No (group, probability) has more distinct values in its window than the band allows."""
    from spendguard.scratch import materialise

    df = materialise(numbers(spark, 60_000), "numbers")
    most = []
    inner = quantiles._in_band

    def watched(rows, bands, keys):
        out = inner(rows, bands, keys)
        most.append(out.groupBy(*keys, "p").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "_in_band", watched)
    for limit in (100, 10):
        most.clear()
        exact_quantiles(df, ["category_key"], "v", [0.0, 0.1, 0.5, 0.77, 1.0], band_rows=limit).collect()
        assert max(most) <= 2 * limit + 3


def test_wrong_sketches_are_put_right(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id % 2 as k", "cast(id as double) as v")
    right = quantiles._grid
    calls = []

    def wrong(shares):
        calls.append(1)
        return F.expr(f"array_repeat(max(_v), {len(shares)})") if len(calls) == 1 else right(shares)

    monkeypatch.setattr(quantiles, "_grid", wrong)
    for limit in (50_000, 5):
        calls.clear()
        got = {(r.k, r.p): r.quantile for r in exact_quantiles(df, ["k"], "v", [0.25, 0.5], band_rows=limit).collect()}
        assert got == {(k, p): np.quantile(np.arange(k, 3000, 2.0), p) for k in (0, 1) for p in (0.25, 0.5)}


def test_without_keys_and_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),), (-float("inf"),), (1.0,), (2.0,), (float("inf"),)], "v double")
    got = {r.p: r.quantile for r in exact_quantiles(df, [], "v", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    assert got == {0.0: -float("inf"), 0.25: 1.0, 0.5: 2.0, 0.75: float("inf"), 1.0: float("inf")}
    assert exact_quantiles(df.where("false"), [], "v", [0.5]).collect() == []


def test_rank_over_partitions(spark):
    df = numbers(spark, 5000).repartition(7)
    order = [F.col("v").desc(), F.col("record_id").asc()]
    got = distributed_rank(df, "r", order, ["category_key"]).toPandas()
    want = got.sort_values(["v", "record_id"], ascending=[False, True]).groupby("category_key").cumcount() + 1
    assert (got["r"] == want.reindex(got.index)).all()
    overall = distributed_rank(df, "r", order).toPandas().sort_values("r")
    assert overall["r"].tolist() == list(range(1, 5001))
    assert overall["v"].is_monotonic_decreasing


def test_sample_does_not_depend_on_partitions(spark):
    df = numbers(spark, 30_000)
    one, two = (sample_per_category(df.select("record_id", "category_key").repartition(k), 500, 2000) for k in (3, 11))
    ids = sorted(r.record_id for r in one.collect())
    assert ids == sorted(r.record_id for r in two.collect())
    counts = {r.category_key: r["count"] for r in one.groupBy("category_key").count().collect()}
    assert counts["hot"] == 500 and counts["wide"] == 500
    assert counts["tiny"] == df.where("category_key = 'tiny'").count()
