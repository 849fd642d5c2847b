"""Exact quantiles per group by distributed selection, without holding a group in memory.

A bounded sketch proposes, for every group and probability, a band of values around the wanted ranks; only rows inside
it are ranked. Where a band would still hold more than `band_rows` rows, rounds of exact counts (below the band, on
its ends, inside) confirm or move its ends and a sketch of the rows strictly inside narrows it, about two hundred times
a round. Values repeated any number of times end up on an end of the band or as one counted value, so the window that
ranks a band never sees many more than `band_rows` distinct values, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendguard.scratch import materialise

_ACCURACY = 10_000
_SLACK = 5  # ranks of the sketch, in units of its accuracy, that a proposed end keeps from the wanted rank
_STEPS = 500  # steps of the grid where the wanted share differs by group
_ROUNDS = 40
_INF = float("inf")


def _grid(shares: Sequence[float]) -> Column:
    # As text: hundreds of literal columns would each be a call into the JVM.
    steps = ", ".join(f"{s!r}D" for s in shares)
    return F.expr(f"percentile_approx(_v, array({steps}), {_ACCURACY})")


def _end(grid: Column, shares: Sequence[float], wanted: Column, side: int) -> Column:
    """Value at the last grid share safely below (`side` -1) or the first safely above `wanted`; null beyond the grid."""
    safe = wanted + side * _SLACK / _ACCURACY
    at = F.array(*[F.lit(float(s)) for s in shares]) if len(shares) < 50 else F.expr(
        f"transform(sequence(0, {len(shares) - 1}), i -> i / {len(shares) - 1}D)"
    )
    both = F.arrays_zip(at.alias("at"), grid.alias("v"))
    fit = F.filter(both, lambda e: e["at"] <= safe if side < 0 else e["at"] >= safe)
    return F.try_element_at(fit, F.lit(-1 if side < 0 else 1))["v"]


def _ranks(targets: DataFrame) -> DataFrame:
    at = F.col("p") * (F.col("n") - 1)
    return targets.withColumn("_k0", F.floor(at)).withColumn("_k1", F.ceil(at))


def _first_bands(rows: DataFrame, keys: list[str], probs: Sequence[float] | None, per_group: DataFrame | None) -> DataFrame:
    """Keys, p, n, ranks, band and `_wide`, the number of rows that the band may hold."""
    if per_group is None:
        near = {min(1.0, max(0.0, p + side * step * _SLACK / _ACCURACY)) for p in probs for side in (-1, 1) for step in (1, 2)}
        shares = sorted({0.0, 1.0} | near)
    else:
        shares = [i / _STEPS for i in range(_STEPS + 1)]
    # The written sketch is small and carries its size, so joins with the rows are broadcasts below the limit.
    sketch = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _grid(shares).alias("_grid")), "quantile_sketch")
    if per_group is None:
        wanted = sketch.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        span = 4.0 * _SLACK / _ACCURACY
    else:
        wanted = sketch.join(per_group.select(*keys, F.col("p").cast("double")), keys)
        span = 2.0 / _STEPS + 2.0 * _SLACK / _ACCURACY
    low, high = (_end(F.col("_grid"), shares, F.col("p"), side) for side in (-1, 1))
    return _ranks(wanted).select(
        *keys, "p", "n", "_k0", "_k1",
        F.coalesce(low, F.lit(-_INF)).alias("_lo"), F.coalesce(high, F.lit(_INF)).alias("_hi"),
        F.ceil(F.col("n") * span).alias("_wide"),
    )


def _met(rows: DataFrame, targets: DataFrame, keys: list[str], condition: str) -> DataFrame:
    """Rows with each of their group's targets, where `condition` holds."""
    if keys:
        return rows.join(targets, keys).where(condition)
    return rows.crossJoin(F.broadcast(targets)).where(condition)  # a row for each probability


def _narrowed(rows: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """One round: ends that the exact counts confirm stay, others go back; then the inside is sketched again."""
    value = F.col("_v")
    counted = materialise(
        _met(rows, bands, keys, "true").groupBy(*keys, "p", "n", "_k0", "_k1", "_lo", "_hi").agg(
            F.count_if(value < F.col("_lo")).alias("_below"), F.count_if(value == F.col("_lo")).alias("_at_lo"),
            F.count_if(value == F.col("_hi")).alias("_at_hi"), F.count_if(value <= F.col("_hi")).alias("_upto"),
        ),
        "quantile_counts",
    )
    inside = F.col("_upto") - F.col("_below") - F.col("_at_lo") - F.when(F.col("_hi") > F.col("_lo"), F.col("_at_hi")).otherwise(0)
    held = (F.col("_below") <= F.col("_k0")) & (F.col("_k1") < F.col("_upto"))
    checked = (
        counted.withColumn("_held", held).withColumn("_inside", F.when(held, inside).otherwise(F.col("n")))
        .withColumn("_under", F.when(held, F.col("_below") + F.col("_at_lo")).otherwise(F.lit(0)))
        # A band that missed its ranks is opened to all values of its group.
        .withColumn("_lo", F.when(held, F.col("_lo")).otherwise(F.lit(-_INF)))
        .withColumn("_hi", F.when(held, F.col("_hi")).otherwise(F.lit(_INF)))
    )
    checked = materialise(checked, "quantile_bands")
    shares = [i / _STEPS for i in range(_STEPS + 1)]
    grids = _met(rows, checked.select(*keys, "p", "_lo", "_hi"), keys, "_v > _lo and _v < _hi").groupBy(*keys, "p").agg(
        _grid(shares).alias("_grid")
    )
    again = checked.join(materialise(grids, "quantile_grids"), [*keys, "p"], "left")
    first, last = (F.try_divide(F.col(k) - F.col("_under"), F.col("_inside")) for k in ("_k0", "_k1"))
    low = F.when(first >= 0, _end(F.col("_grid"), shares, first, -1))
    high = F.when(last < 1, _end(F.col("_grid"), shares, last, 1))
    return again.select(
        *keys, "p", "n", "_k0", "_k1",
        F.coalesce(low, F.col("_lo")).alias("_lo"), F.coalesce(high, F.col("_hi")).alias("_hi"),
        F.when(F.col("_inside") > 0, F.ceil(F.col("_inside") * (2.0 / _STEPS + 2.0 * _SLACK / _ACCURACY))).otherwise(0).alias("_wide"),
    )


def _in_band(rows: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values inside each band with their counts; all rows below a band are one row with a null value."""
    return (
        _met(rows, bands, keys, "_v <= _hi")
        .groupBy(*keys, "p", "n", "_k0", "_k1", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def _pick(rows: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """The two values at the wanted ranks, null where the band missed one."""
    running = Window.partitionBy(*keys, "p").orderBy(F.col("_v").asc_nulls_first())
    ranked = _in_band(rows, bands, keys).withColumn("_cum", F.sum("_c").over(running))
    at = [F.min(F.when(F.col("_cum") > F.col(k), F.struct(F.col("_cum"), F.col("_v"))))["_v"] for k in ("_k0", "_k1")]
    return ranked.groupBy(*keys, "p", "n", "_k0", "_k1").agg(at[0].alias("_a"), at[1].alias("_b"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float] | None = None,
    per_group: DataFrame | None = None,
    band_rows: int = 50_000,
) -> DataFrame:
    """Linearly interpolated quantiles: one row per group and probability (`p`, `quantile`, `n`).

    Give either `probs`, the same for all groups, or `per_group`, a table of keys and `p`, one row per group. Null and
    NaN values are ignored; groups with a null key or without values have no row.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("_v")
    )
    bands = materialise(_first_bands(rows, keys, probs, per_group), "quantile_bands")
    ready = []
    for _ in range(_ROUNDS):
        if bands.where(F.col("_wide") > band_rows).isEmpty():
            break
        ready.append(bands.where(F.col("_wide") <= band_rows))
        bands = materialise(_narrowed(rows, bands.where(F.col("_wide") > band_rows), keys), "quantile_bands")
    for more in ready:
        bands = bands.unionByName(more)
    found = materialise(_pick(rows, bands, keys), "quantiles")
    missed = found.where("_a is null or _b is null").select(*keys, "p")
    if not missed.isEmpty():  # the sketch was worse than it promises: counts put the ends right
        again = bands.join(materialise(missed, "quantiles_missed"), [*keys, "p"], "left_semi")
        found = found.where("_a is not null and _b is not null").unionByName(_pick(rows, materialise(_narrowed(rows, again, keys), "quantile_bands"), keys))
    part = F.col("p") * (F.col("n") - 1) - F.col("_k0")
    quantile = F.col("_a") + (F.col("_b") - F.col("_a")) * part
    return found.select(*keys, "p", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(quantile).alias("quantile"), "n")


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    """Quantiles as columns, one row per group."""
    keys = list(keys)
    found = exact_quantiles(df, keys, value, list(names.values()))
    picks = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(k) for k, p in names.items()]
    return found.groupBy(*keys).agg(*picks)
