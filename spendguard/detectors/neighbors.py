"""Exact k nearest neighbours within each category, as a pruned join of point blocks.

1. Points are range-partitioned by category, buckets and numbers and packed into blocks of a bounded
   number of points.  A block row carries its bounding box and the points as one binary value, so a
   category that holds most rows is simply many blocks.
2. Every query block meets the reference block next to it in that order.  The distances found there
   bound the true k-th distance from above.
3. Block pairs whose boxes are farther apart than that bound are dropped; this is decided on box
   metadata from coarse to fine: partitions, runs of blocks, single blocks.  Only surviving pairs meet.
   Neighbouring query blocks form teams of a bounded size: they want mostly the same references, and a
   reference block travels once to a team and not once for every pair.  References come by the distance
   of their boxes, so the lists tighten early and most of the far boxes are left unread.
4. Per query the partial lists are merged to the k nearest.  No pair of points leaves a task.

The result is exact for any data; the boxes only decide how much work is skipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.detectors.space import Space, paired_distances, rough_distances
from spendguard.scratch import materialise, session_conf, tasks

BLOCK_POINTS = 512
_MIN_POINTS = 64
_PAIR_BATCH = 64
_PAIRS_PER_PART = 256
_TEAM_BLOCKS = 8
_UNROLLED = 12


def _block_starts(cells: np.ndarray, block_points: int) -> list[int]:
    """Block starts: at the latest after `block_points` rows, and at a change of buckets once a block
    has enough rows to be worth its own box."""
    changed = np.r_[False, (cells[1:] != cells[:-1]).any(axis=1)]
    least = min(_MIN_POINTS, block_points)
    starts = [0]
    for at in np.flatnonzero(changed).tolist() + [len(cells)]:
        while at - starts[-1] > block_points:
            starts.append(starts[-1] + block_points)
        if at < len(cells) and at - starts[-1] >= least:
            starts.append(at)
    return starts


def pack_blocks(points: DataFrame, space: Space, block_points: int = BLOCK_POINTS) -> DataFrame:
    """One row per block of nearby points of a category, with its bounding box."""
    z, buckets, weights = space.z, list(space.buckets), space.weights
    order = [C.CATEGORY_KEY, *buckets, *z, C.RECORD_ID]
    layout = [*z, *buckets, *weights]
    schema = (
        f"{C.CATEGORY_KEY} string, part int, run bigint, team bigint, block bigint, n int, lo array<double>, hi array<double>, "
        "ids binary, pts binary"
        + "".join(f", set_{b} array<int>, wmin_{b} double" for b in buckets)
    )

    def pack(batches):
        task = TaskContext.get().partitionId()
        for batch in batches:
            for key, part in batch.groupby(C.CATEGORY_KEY, sort=False):
                ids = part[C.RECORD_ID].to_numpy(np.int64)
                pts = part[layout].to_numpy(np.float64)
                rows = []
                starts = _block_starts(pts[:, len(z) : len(z) + len(buckets)], block_points)
                for number, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    p, i = pts[start:end], ids[start:end]
                    row = {
                        C.CATEGORY_KEY: key, "part": task, "run": ids[0],
                        "team": ids[starts[number - number % _TEAM_BLOCKS]], "block": i[0], "n": len(i),
                        "lo": p[:, : len(z)].min(0), "hi": p[:, : len(z)].max(0),
                        "ids": i.tobytes(), "pts": p.tobytes(),
                    }
                    for j, b in enumerate(buckets):
                        row[f"set_{b}"] = np.unique(p[:, len(z) + j]).astype(np.int32)
                        row[f"wmin_{b}"] = p[:, len(z) + len(buckets) + j].min()
                    rows.append(row)
                yield pd.DataFrame(rows)

    packed = (
        points.select(C.RECORD_ID, C.CATEGORY_KEY, *layout)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInPandas(pack, schema)
    )
    return materialise(packed, "blocks")


def _box_gap(space: Space) -> Column:
    """Smallest possible squared distance between a query box (q_) and a reference box (r_)."""
    # As text: one call into the JVM instead of several per dimension.
    side = "pow(greatest(r_lo[{0}] - q_hi[{0}], q_lo[{0}] - r_hi[{0}], 0D), 2)"
    d = len(space.numeric)
    if d > _UNROLLED:
        gap = F.expr(f"aggregate(sequence(0, {d - 1}), 0D, (s, i) -> s + {side.format('i')})")
    else:
        gap = F.expr(" + ".join(["0D", *[side.format(i) for i in range(d)]]))
    for b in space.buckets:
        apart = ~F.arrays_overlap(f"q_set_{b}", f"r_set_{b}")
        gap = gap + F.when(apart, F.col(f"q_wmin_{b}") + F.col(f"r_wmin_{b}")).otherwise(0.0)
    return gap


def _boxes(blocks: DataFrame, space: Space, prefix: str, level: str, parent: str | None = None) -> DataFrame:
    """Boxes of all blocks that share a value of `level`, with prefixed column names."""
    if level != "block":
        d = len(space.numeric)
        aggs = [
            F.expr(f"array({', '.join(f'{f}({side}[{i}])' for i in range(d))})").alias(side)
            for f, side in (("min", "lo"), ("max", "hi"))
        ]
        for b in space.buckets:
            # At most as many distinct values as the feature has buckets.
            aggs.append(F.array_distinct(F.flatten(F.collect_set(f"set_{b}"))).alias(f"set_{b}"))
            aggs.append(F.min(f"wmin_{b}").alias(f"wmin_{b}"))
        if "bound" in blocks.columns:
            aggs.append(F.max("bound").alias("bound"))
        blocks = blocks.groupBy(C.CATEGORY_KEY, *[c for c in (parent, level) if c]).agg(*aggs)
    drop = {C.CATEGORY_KEY, "ids", "pts", "n", "team", *({"part", "run", "block"} - {level, parent})}
    return blocks.select(C.CATEGORY_KEY, *[F.col(c).alias(f"{prefix}_{c}") for c in blocks.columns if c not in drop])


def _close_pairs(queries: DataFrame, refs: DataFrame, space: Space) -> DataFrame:
    """Block pairs whose boxes are within the query block's bound, with the distance (squared) of the boxes.

    Boxes are compared top down: partitions of the packing, then runs of blocks, then blocks.  Only the
    children of close pairs are compared, so no level compares everything with everything.
    """
    key = C.CATEGORY_KEY
    close = F.col("gap") <= F.col("q_bound") * (1 + 1e-9)
    pairs = _boxes(queries, space, "q", "part").join(_boxes(refs, space, "r", "part"), key).withColumn("gap", _box_gap(space)).where(close)
    for parent, level in (("part", "run"), ("run", "block")):
        pairs = (
            pairs.select(key, f"q_{parent}", f"r_{parent}")
            .repartition(queries.sparkSession.sparkContext.defaultParallelism)  # few pairs in one task would keep one core busy
            .join(_boxes(queries, space, "q", level, parent), [key, f"q_{parent}"])
            .join(_boxes(refs, space, "r", level, parent), [key, f"r_{parent}"])
            .withColumn("gap", _box_gap(space))
            .where(close)
        )
    return pairs.select(key, "q_block", "r_block", "gap")


def _home_pairs(queries: DataFrame, refs: DataFrame, space: Space) -> DataFrame:
    """Each query block with the reference block next to it in block order, if possible one that shares
    its first buckets.

    The order is cut into range partitions; a block whose neighbour lies beyond the cut takes the last or
    first reference block of the partitions on that side.
    """
    key = C.CATEGORY_KEY
    cell = F.array(*[F.array_min(f"set_{b}") for b in space.buckets]) if space.buckets else F.lit(0)
    absent = F.lit(None).cast("bigint")
    q_keys = queries.select(key, cell.alias("cell"), "lo", F.col("block").alias("q_block"), absent.alias("r_block"))
    r_keys = refs.select(key, cell.alias("cell"), "lo", absent.alias("q_block"), F.col("block").alias("r_block"))
    order = ["cell", "lo", "_is_query", "q_block", "r_block"]
    both = q_keys.unionByName(r_keys).withColumn("_is_query", F.col("q_block").isNotNull())
    ranged = materialise(
        both.repartitionByRange(key, *order).withColumn("_cut", F.spark_partition_id()), "block_order"
    )
    stop = F.when(F.col("r_block").isNotNull(), F.struct("cell", "r_block"))
    inside = Window.partitionBy("_cut", key).orderBy(*order)
    near = ranged.select(
        "*",
        F.last(stop, ignorenulls=True).over(inside).alias("_before"),
        F.first(stop, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("_after"),
    )
    position = F.struct(*order)
    edges = ranged.where(F.col("r_block").isNotNull()).groupBy("_cut", key).agg(
        F.max_by(stop, position).alias("_last"), F.min_by(stop, position).alias("_first")
    )
    cuts = ranged.select("_cut", key).distinct().join(edges, ["_cut", key], "left")
    # One row per partition and category.
    along = Window.partitionBy(key).orderBy("_cut")
    beyond = cuts.select(
        "_cut",
        key,
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    before, after = F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later")
    side = (
        F.when(before["cell"] == F.col("cell"), before["r_block"])
        .when(after["cell"] == F.col("cell"), after["r_block"])
        .otherwise(F.coalesce(before["r_block"], after["r_block"]))
    )
    return (
        near.where("_is_query")
        .join(materialise(beyond, "block_cuts"), ["_cut", key])
        .select(key, "q_block", side.alias("r_block"))
        .where(F.col("r_block").isNotNull())
    )


def _nearest_in_teams(k: int, n_numeric: int, n_buckets: int, exclude_self: bool):
    """Streaming top-k: the query blocks of a team come first and are held with their k best; its references pass by."""
    width = n_numeric + 2 * n_buckets

    def emit(key, part, held):
        for block, entries in held.items():
            for ids, _, dist, near, _ in entries:
                if part == 0 or (near >= 0).any():
                    yield pd.DataFrame(
                        {
                            C.CATEGORY_KEY: [key], "block": [block], "part": [part], "ids": [ids.tobytes()],
                            "dist": [dist.tobytes()], "near": [near.tobytes()],
                        }
                    )

    def run(batches):
        team, held = None, {}
        for batch in batches:
            gaps_known = "gaps" in batch.columns
            for row in batch.itertuples(index=False):
                if team != (row.category_key, row.team, row.part):
                    if held:
                        yield from emit(team[0], team[2], held)
                    team, held = (row.category_key, row.team, row.part), {}
                ids = np.frombuffer(row.ids, np.int64)
                pts = np.frombuffer(row.pts, np.float64).reshape(len(ids), width)
                if not row.is_ref:
                    dist, near, cap = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64), np.full(len(ids), np.inf)
                    if row.dist is not None:
                        known = np.frombuffer(row.dist).reshape(-1, k)
                        if row.part == 0:  # one part goes on from the lists so far, the others from their last distances
                            dist, near = known.copy(), np.frombuffer(row.near, np.int64).reshape(-1, k).copy()
                        cap = known[:, -1]
                    held.setdefault(row.block, []).append([ids, pts, dist, near, cap])
                    continue
                for block, gap in zip(row.targets, row.gaps if gaps_known else np.zeros(len(row.targets))):
                    for entry in held[block]:
                        # The lists may have become nearer than the box since the pair was chosen.
                        if gap <= np.minimum(entry[2][:, -1], entry[4]).max() * (1 + 1e-9) + 1e-300:
                            _take_nearer(entry[1], entry[0], *entry[2:5], pts, ids, n_numeric, n_buckets, exclude_self)
        if held:
            yield from emit(team[0], team[2], held)

    return run


def _merged_parts(dist: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of lists that lie side by side, by distance and reference."""
    order = np.lexsort((near, dist), axis=-1)[:, :k]
    return np.take_along_axis(dist, order, 1), np.take_along_axis(near, order, 1)


def _unpacked(lists: DataFrame, k: int, root: bool) -> DataFrame:
    """Lists of blocks as rows of records; `root` gives distances instead of squared ones.

    A block has its lists after the first search (part -1) and, where others were met, in parts that replace them: part 0
    goes on from the first lists, the others hold further references.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = table["part"].to_numpy()
        chosen = np.flatnonzero(parts >= 0) if (parts >= 0).any() else np.arange(len(parts))
        ids = np.frombuffer(table["ids"][0].as_py(), np.int64)
        found = [
            tuple(np.frombuffer(table[c][int(i)].as_py(), t).reshape(-1, k) for c, t in (("dist", np.float64), ("near", np.int64)))
            for i in chosen
        ]
        if len(found) > 1 and len(np.unique(parts[chosen])) == len(found):
            found = [_merged_parts(*(np.hstack(side) for side in zip(*found)), k)]
        # Blocks of the same records in the same order keep their lists; these records have several rows.
        dist, near = (np.concatenate(side) for side in zip(*found))
        full = near >= 0
        ends = np.r_[0, np.cumsum(full.sum(1))].astype(np.int32)
        values = np.sqrt(dist[full]) if root else dist[full]
        n = len(near)
        return pa.table(
            {
                C.CATEGORY_KEY: pa.array([table[C.CATEGORY_KEY][0].as_py()] * n, pa.string()),
                C.RECORD_ID: np.tile(ids, len(found)), "block": np.full(n, table["block"][0].as_py(), np.int64),
                "dist": pa.ListArray.from_arrays(ends, values), "near": pa.ListArray.from_arrays(ends, near[full]),
            }
        )

    return lists.select(C.CATEGORY_KEY, "block", "ids", "part", "dist", "near").groupBy(C.CATEGORY_KEY, "block", "ids").applyInArrow(run, _LISTS)


def _block_ids(blocks: DataFrame) -> DataFrame:
    """Category and record of every point of the blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({C.CATEGORY_KEY: row.category_key, C.RECORD_ID: np.frombuffer(row.ids, np.int64)})

    return blocks.select(C.CATEGORY_KEY, "ids").mapInPandas(run, f"{C.CATEGORY_KEY} string, {C.RECORD_ID} bigint")


def _take_nearer(pts, ids, dist, near, cap, r_pts, r_ids, n_numeric, n_buckets, exclude_self) -> None:
    """Merge one reference block into the k best lists `dist`, `near` of a query block; farther pairs than `cap` may be left out.

    Queries too far from the references' box are left out first. Rough distances pick the pairs that can matter; only those are measured exactly.
    """
    k = dist.shape[1]
    worst = np.minimum(dist[:, -1], cap)
    near_box = np.flatnonzero(_gap_to_box(pts, r_pts, n_numeric, n_buckets) <= worst * (1 + 1e-9) + 1e-300)
    if not len(near_box):
        return
    rough, error = rough_distances(pts[near_box], r_pts, n_numeric, n_buckets)
    if exclude_self:
        rough[ids[near_box, None] == r_ids[None, :]] = np.inf
    picked = np.flatnonzero(rough.min(axis=1) <= worst[near_box] + error)
    if not len(picked):
        return
    rough, error, rows = rough[picked], error[picked], near_box[picked]
    limit = worst[rows]
    if rough.shape[1] > k and np.isinf(limit).any():
        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
    close = rough <= (limit + 2 * error)[:, None]
    close &= rough < np.inf
    i, j = np.nonzero(close)
    exact = paired_distances(pts[rows[i]], r_pts[j], n_numeric, n_buckets)
    # The lists so far and the new pairs, ordered by query, distance and reference.
    row = np.concatenate([np.repeat(np.arange(len(rows)), k), i])
    d = np.concatenate([dist[rows].ravel(), exact])
    who = np.concatenate([near[rows].ravel(), r_ids[j]])
    order = np.lexsort((who, d, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(rows)))[row]
    kept = place < k
    dist[rows[row[kept]], place[kept]] = d[order][kept]
    near[rows[row[kept]], place[kept]] = who[order][kept]


def _gap_to_box(pts, r_pts, n_numeric, n_buckets) -> np.ndarray:
    """Smallest possible squared distance of every query to the references' bounding box."""
    x, y = pts[:, :n_numeric], r_pts[:, :n_numeric]
    beside = np.maximum(np.maximum(y.min(0) - x, x - y.max(0)), 0.0)
    gap = (beside * beside).sum(1)
    for j in range(n_numeric, n_numeric + n_buckets):
        w = j + n_buckets
        gap += np.where(np.isin(pts[:, j], r_pts[:, j]), 0.0, pts[:, w] + r_pts[:, w].min())
    return gap


_PARTIAL = f"{C.CATEGORY_KEY} string, block bigint, part int, ids binary, dist binary, near binary"
_LISTS = f"{C.CATEGORY_KEY} string, {C.RECORD_ID} bigint, block bigint, dist array<double>, near array<bigint>"


def _run_pairs(
    pairs: DataFrame, queries: DataFrame, refs: DataFrame, k: int, space: Space, exclude_self: bool, name: str, known: DataFrame | None = None
) -> DataFrame:
    """Attach the points to block pairs and keep the k nearest per query point and task, one row per block and part.

    `known` holds lists of the query blocks from other references.
    """
    key = C.CATEGORY_KEY
    spark = pairs.sparkSession
    teams = queries.select(key, "team", F.col("block").alias("q_block"))
    if "gap" not in pairs.columns:
        pairs = pairs.withColumn("gap", F.lit(0.0))
    # A team with a query block that reaches many reference blocks is split into parts of a bounded number of pairs.
    reached = pairs.groupBy(key, "q_block").agg(F.count(F.lit(1)).alias("_n")).join(teams, [key, "q_block"])
    parts = F.ceil(F.max("_n") / _PAIRS_PER_PART).cast("int").alias("_parts")
    load = materialise(reached.groupBy(key, "team").agg(parts), "pair_load")
    part = F.pmod(F.xxhash64("r_block"), F.col("_parts")).cast("int").alias("part")
    wanted = (
        pairs.join(teams, [key, "q_block"]).join(load, [key, "team"])
        .groupBy(key, "team", part, F.col("r_block").alias("block"))
        .agg(F.min("gap").alias("gap"), F.collect_list(F.struct("q_block", "gap")).alias("_met"))
        .withColumns({"targets": F.col("_met.q_block"), "gaps": F.col("_met.gap")}).drop("_met")
    )
    r = wanted.join(refs.select(key, "block", "ids", "pts"), [key, "block"]).withColumn("is_ref", F.lit(True))
    r = r.withColumns({"dist": F.lit(None).cast("binary"), "near": F.lit(None).cast("binary")})
    absent = F.lit(None).cast("binary")
    if known is None:
        lists = queries.select(key, "team", "block", "ids", "pts", absent.alias("dist"), absent.alias("near"))
    else:
        lists = queries.select(key, "team", "block", "ids", "pts").join(known.select(key, "block", "ids", "dist", "near"), [key, "block", "ids"])
    q = (
        lists.join(load, [key, "team"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        .withColumns({
            "is_ref": F.lit(False), "targets": F.array().cast("array<bigint>"), "gaps": F.array().cast("array<double>"), "gap": F.lit(0.0),
        })
    )
    # Work is spread evenly by the explicit layout, and a team arrives in one piece.
    place = [key, "team", "part"]
    fed = q.unionByName(r).repartition(tasks(spark), *place).sortWithinPartitions(*place, "is_ref", "gap", "block")
    search = _nearest_in_teams(k, len(space.numeric), len(space.buckets), exclude_self)
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=_PAIR_BATCH):
        return materialise(fed.mapInPandas(search, _PARTIAL), name)


def nearest(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    space: Space,
    exclude_self: bool = False,
) -> DataFrame:
    """k nearest references per query block point: (category_key, record_id, block, dist, near).

    `block` is the query block of the record, the smallest of a record with several rows. `queries` and `refs` are block tables.  `dist` holds distances in ascending order and `near` the
    reference records, ties broken by record; both are shorter than k where a category has fewer points.
    """
    key = C.CATEGORY_KEY
    # 2. The reference block next to each query block.
    home = materialise(_home_pairs(queries, refs, space), "home_pairs")
    first = _run_pairs(home, queries, refs, k, space, exclude_self, "home_neighbours")

    # 3. Block pairs that can still hold a nearer reference.
    reach = F.udf(lambda data: float(np.frombuffer(data).reshape(-1, k)[:, -1].max()), "double")  # one row per block
    bounds = first.select(key, "block", reach("dist").alias("bound")).groupBy(key, "block").agg(F.max("bound").alias("bound"))
    bounded = materialise(queries.drop("ids", "pts").join(bounds, [key, "block"]), "bounded_blocks")
    pairs = _close_pairs(bounded, refs, space).join(home, [key, "q_block", "r_block"], "left_anti")
    rest = _run_pairs(materialise(pairs, "block_pairs"), queries, refs, k, space, exclude_self, "far_neighbours", first)

    # 4. The far search goes on from the first lists. Parts of a block are merged as whole arrays; only the lists of records
    # with several rows are merged row by row.
    counts = _block_ids(queries).groupBy(key, C.RECORD_ID).agg(F.count(F.lit(1)).alias("_n"))
    repeated = materialise(counts.where("_n > 1").select(key, C.RECORD_ID), "repeated_records")
    once = repeated.isEmpty()
    lists = _unpacked(first.withColumn("part", F.lit(-1)).unionByName(rest), k, root=once)
    if once:
        return lists
    found = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("dist", "near"))))
    merged = lists.join(repeated, [key, C.RECORD_ID], "left_semi").groupBy(key, C.RECORD_ID).agg(
        F.min("block").alias("block"), F.slice(found, 1, k).alias("_b")
    )
    lists = lists.join(repeated, [key, C.RECORD_ID], "left_anti").unionByName(
        merged.select(key, C.RECORD_ID, "block", F.col("_b.dist").alias("dist"), F.col("_b.near").alias("near"))
    )
    return lists.withColumn("dist", F.transform("dist", F.sqrt))


def in_blocks(lists: DataFrame) -> DataFrame:
    """Lists with the block of their record; without a search's blocks, records are dealt out by hash."""
    if "block" in lists.columns:
        return lists
    blocks = lists.count() // BLOCK_POINTS + 1
    return lists.withColumn("block", F.pmod(F.xxhash64(C.RECORD_ID), F.lit(blocks)))


def neighbour_edges(found: DataFrame, k: int) -> DataFrame:
    """Neighbour lists as rows: (category_key, record_id, rank, neighbor_id, distance)."""
    return found.select(
        C.CATEGORY_KEY, C.RECORD_ID, F.posexplode(F.slice(F.arrays_zip("near", "dist"), 1, k)).alias("_i", "_e")
    ).select(
        C.CATEGORY_KEY, C.RECORD_ID, (F.col("_i") + 1).alias("rank"),
        F.col("_e.near").alias("neighbor_id"), F.col("_e.dist").alias("distance"),
    )


def knn_join(queries: DataFrame, refs: DataFrame, k: int, space: Space, exclude_self: bool = False) -> DataFrame:
    """The k nearest references of every query point as edges."""
    q, r = pack_blocks(queries, space), pack_blocks(refs, space)
    return neighbour_edges(nearest(q, r, k, space, exclude_self), k)
