"""Mixing sources to target weights by subset-sum budget fitting.

Every source takes its whole documents as often as its target holds them; the rest of the target is a budget
for one more copy of some. Documents are counted by exact length; each length gives its proportional share,
and a bounded knapsack over the lengths fills what is left. Within a length, documents are picked by a seeded
hash, in salted slices, so that no length, source or group of copies is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendguard.llm.registry import query, table
from spendguard.scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 256


def source_targets(sizes: pd.DataFrame, weights: Sequence[float], share: float, most: float) -> pd.DataFrame:
    """`target` per source: weights repeat over the sources in code-point order (null last) and share out
    `share` of all sizes; a target stops at `most` times its source's size and the excess is shared again."""
    order = sorted(range(len(sizes)), key=lambda i: (pd.isna(sizes["source"].iloc[i]), _code_points(sizes["source"].iloc[i])))
    ordered = sizes.iloc[order].reset_index(drop=True)
    size = ordered["source_size"].to_numpy(float)
    weight = np.resize(np.asarray(weights, float), len(ordered))
    target, free, left = np.zeros(len(ordered)), np.full(len(ordered), True), share * size.sum()
    while free.any():
        portion = left * weight / weight[free].sum()
        over = free & (portion > most * size)
        if not over.any():
            target[free] = portion[free]
            break
        target[over] = most * size[over]
        left -= target[over].sum()
        free &= ~over
    return ordered.assign(target=target)


def _code_points(text) -> list[int]:
    return [] if pd.isna(text) else list(map(ord, str(text)))


def fill_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, at most `counts`, so that their lengths sum to `budget` or,
    where no choice does, to the nearest sum below that the search finds.

    Proportional shares first; of what remains, whole documents, longest first, until the rest is below the
    longest length; then an exact bounded knapsack over reachable sums, kept as bits of one integer per length.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    budget = min(budget, total)
    take = (counts * (budget / total)).astype(np.int64)
    take = np.minimum(take, counts)
    rest = budget - int((lengths * take).sum())
    while rest < 0:  # rounding of very large products
        i = int(np.argmax(np.where(take > 0, lengths, 0)))
        take[i] -= 1
        rest += int(lengths[i])
    order = np.argsort(-lengths)
    for i in order:
        if rest <= 2 * lengths[order[0]]:
            break
        more = min(int(counts[i] - take[i]), int(rest // lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    return take + _knapsack(lengths, counts - take, rest)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    reach, mask, steps = 1, (1 << (budget + 1)) - 1, []
    for i in np.argsort(lengths):
        left, size, batch = int(counts[i]), int(lengths[i]), 1
        while left and size * batch <= budget and not reach >> budget & 1:
            n = min(batch, left)
            steps.append((int(i), n, reach))
            reach |= reach << n * size & mask
            left, batch = left - n, batch * 2
    at, take = reach.bit_length() - 1, np.zeros(len(lengths), np.int64)
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """`id_col`, size, source_size, target and taken for every row of `docs`.

    `size` counts the words of the text (a null text has none), `taken` the words the mix takes, repeats
    counted: a whole number of copies, at most `most` of them. Sources may be null. Equal rows are separate
    documents. Reruns take the same documents. Columns other than the three named are ignored. The sources are
    few (their list passes through the driver); the lengths of one source pass through one task, counted.
    """
    return _mixed(docs, weights, share, most, seed, id_col, text_col, source_col, with_copies=False)


def _mixed(docs, weights, share, most, seed, id_col, text_col, source_col, with_copies, carry=()) -> DataFrame:
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialise(
        docs.select(
            F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"),
            F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40)).alias("_draw"), *carry,
        ),
        "sized",
    )
    slices = materialise(
        sized.groupBy("source", "size", (F.col("_draw") % SLICES).alias("_slice")).agg(F.count("*").alias("_n")),
        "length_counts",
    )
    by_source = slices.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")).toPandas()
    targets = source_targets(by_source, weights, share, most)
    targets = spark.createDataFrame(
        [(None if pd.isna(r.source) else r.source, int(r.source_size), float(r.target)) for r in targets.itertuples()],
        "source string, source_size long, target double",
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        copies = int(target // size) if size else 0
        take = fill_budget(
            group["size"].to_numpy(np.int64), group["_n"].to_numpy(np.int64), round(target - copies * size)
        )
        return pd.DataFrame(
            {
                "source": group["source"], "size": group["size"], "source_size": size, "target": target,
                "_copies": copies, "_take": take,
            }
        )

    lengths = slices.groupBy("source", "size").agg(F.sum("_n").alias("_n"))
    plan = materialise(
        lengths.join(targets, lengths["source"].eqNullSafe(targets["source"]))
        .select(lengths["source"], "size", "_n", "source_size", "target")
        .groupBy("source")
        .applyInPandas(
            fit, "source string, size long, source_size long, target double, _copies int, _take long"
        ),
        "length_plan",
    )
    # Of each length, slices are taken whole in order; one of them may be taken in part.
    earlier = Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    p, s = plan.alias("p"), slices.alias("s")
    shares = materialise(
        s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size")))
        .select("s.source", "s.size", "_slice", "_n", "source_size", "target", "_copies", "_take")
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_quota", F.greatest(F.lit(0), F.least("_n", F.col("_take") - F.col("_before"))))
        .drop("_before", "_take"),
        "slice_quota",
    )
    d, q = sized.alias("d"), shares.alias("q")
    joined = d.join(
        q,
        F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.size") == F.col("q.size"))
        & (F.col("d._draw") % SLICES == F.col("q._slice")),
    ).select("d.*", "_slice", "_n", "source_size", "target", "_copies", "_quota")
    whole = joined.where("_quota = 0 or _quota = _n").withColumn("_extra", (F.col("_quota") > 0).cast("int"))
    order = Window.partitionBy("source", "size", "_slice").orderBy("_draw", "_id")
    part = (
        joined.where("_quota > 0 and _quota < _n")
        .withColumn("_extra", (F.row_number().over(order) <= F.col("_quota")).cast("int"))
    )
    copies = (F.col("_copies") + F.col("_extra")).cast("int")
    extra = [copies.alias("copies"), *carry] if with_copies else []
    return whole.unionByName(part).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), *extra
    )


@query("op2_mixing")
def op2_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
