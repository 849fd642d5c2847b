import numpy as np
import pytest
from compare import differences, open_tables
from pyspark.sql import functions as F

from checks import QUERIES, SQL
from spendguard.operators.summaries import merge_summaries, new_values, store_summaries, stored_summaries, summarise

SCHEMA = "year int, verba string, conta string, valor double"


def expenses(spark, n=20_000):
    """Year 2001 holds a third of the rows, amounts lie far from zero, some are null or NaN."""
    i = F.col("id")
    year = F.when(i % 3 == 0, 2001).otherwise(2000 + (i % 5).cast("int"))
    valor = F.when(i % 97 == 0, F.lit(None)).when(i % 89 == 0, F.lit(float("nan"))).otherwise(1e9 + F.pmod(F.xxhash64("id"), F.lit(10_007)))
    return spark.range(n).select(
        year.cast("int").alias("year"), F.concat(F.lit("v"), i % 4).alias("verba"),
        F.concat(F.lit("c"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3000))).alias("conta"), valor.cast("double").alias("valor"),
    )


def test_merged_parts_equal_one_pass(spark):
    df = expenses(spark)
    pdf = df.toPandas()
    summaries = summarise(df, keys=["verba"])
    assert summaries.count() == 5 * 4 * 2
    for keys in ([], ["verba"], ["part"], ["part", "verba"]):
        for row in merge_summaries(summaries, keys).collect():
            mine = pdf
            for k in keys:
                mine = mine[mine["year" if k == "part" else k].astype(str) == row[k]]
            assert row.n == len(mine)
            if row.column == "conta":
                assert row.n_null == 0 and row.mean is None and row.median is None
                assert row.n_distinct == pytest.approx(mine.conta.nunique(), rel=0.04)
                continue
            v = np.sort(mine.valor.dropna().to_numpy())
            assert row.n_null == len(mine) - len(v)
            assert row.mean == pytest.approx(v.mean(), rel=1e-14) and row.std == pytest.approx(v.std(ddof=1), rel=1e-8)
            assert (row.min, row.max) == (v[0], v[-1])
            for name, p in (("q05", 0.05), ("median", 0.5), ("q95", 0.95)):
                lo, hi = np.searchsorted(v, row[name], "left") / len(v), np.searchsorted(v, row[name], "right") / len(v)
                assert lo - 0.01 <= p <= hi + 0.01


def test_new_and_gone_values(spark):
    df = expenses(spark)
    sets = {y: set(g.conta) for y, g in df.toPandas().groupby("year")}
    seen, before, want = set(), set(), {}
    for year in sorted(sets):
        want[str(year)] = (len(sets[year]), len(sets[year] - seen), len(before - sets[year]), len(seen | sets[year]))
        seen, before = seen | sets[year], sets[year]
    got = new_values(summarise(df, keys=["verba"], columns=["conta"])).collect()
    assert {r.part: (r.n_distinct, r.n_new, r.n_gone, r.n_seen) for r in got} == want


def test_a_year_is_added_and_corrected(spark, tmp_path):
    path = str(tmp_path / "summaries")
    with pytest.raises(FileNotFoundError):
        stored_summaries(spark, path)
    df = expenses(spark, 2000)
    store_summaries(summarise(df.where("year < 2004")), path)
    store_summaries(summarise(df.where("year = 2004")), path)
    exact = ["column", "n", "n_null", "mean", "std", "min", "max"]
    whole = {r.column: r for r in merge_summaries(summarise(df)).select(exact).collect()}
    assert {r.column: r for r in merge_summaries(stored_summaries(spark, path)).select(exact).collect()} == whole
    corrected = df.where("year = 2001").limit(7)
    store_summaries(summarise(corrected), path)
    sizes = {(r.part, r.column): r.n for r in stored_summaries(spark, path).collect()}
    assert sizes[("2001", "valor")] == 7 and len(sizes) == 5 * 3
    assert sizes[("2004", "valor")] == df.where("year = 2004").count()


def test_odd_rows(spark, tmp_path):
    rows = [(2000, None, None, None), (2000, None, None, float("nan")), (None, "a", "", 1.0), (2001, "a", "", 1.0), (2001, "a", "", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "'x' as n")
    found = {(r.verba, r.column): r for r in merge_summaries(summarise(df, keys=["verba"], columns=["conta", "valor", "n"]), ["verba"]).collect()}
    assert (found[(None, "valor")].n, found[(None, "valor")].n_null, found[(None, "valor")].mean, found[(None, "valor")].q05) == (2, 2, None, None)
    assert (found[("a", "valor")].n, found[("a", "valor")].std, found[("a", "valor")].median, found[("a", "conta")].n_distinct) == (3, 0.0, 1.0, 1)
    empty = summarise(df.where("false"))
    assert empty.count() == 0 and merge_summaries(empty).count() == 0 and new_values(empty).count() == 0
    with pytest.raises(Exception, match="without a part"):
        store_summaries(summarise(df), str(tmp_path / "never"))


@pytest.mark.parametrize("name", ["merged_year_summaries", "new_spenders_by_year"])
def test_summary_queries_equal_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(spark, open_tables(sf_dir), sf_dir, name, QUERIES[name], SQL[name]) is None
