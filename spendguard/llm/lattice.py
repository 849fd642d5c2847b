"""Near-duplicate vectors by E8 lattice hashing.

Unit vectors are projected to 16 random directions per table; each half is decoded to the nearest point of the
E8 lattice (Conway and Sloane 1982), and the two points with the label are the cell. A vector is stored in its
own cell and looked up in the nearest neighbouring cells too. Cells hold hashes and ids only; vectors are
fetched for cells where two can meet, and every link is verified by its cosine. Large cells are cut into
blocks of bounded size that meet pairwise, so no cell is one task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard.llm.graph import components
from spendguard.llm.jaccard import scramble
from spendguard.llm.registry import query, table
from spendguard.llm.vectors import all_finite, matrices
from spendguard.scratch import materialise

BLOCK = 512


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two of eight at +-1, or all at +-1/2 with an even number below zero."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd turn the worst coordinate."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 + 1/2."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _cells(unit: np.ndarray, number: int, width: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Points (x 2) of the own cell of every row, and of the `probes` nearest other cells: rows x probes x 16."""
    d = unit.shape[1]
    directions = np.random.default_rng([number, d]).standard_normal((d, 16))
    directions = np.linalg.qr(directions)[0] if d >= 16 else directions / np.linalg.norm(directions, axis=0)
    y = unit @ directions / width
    own = np.concatenate([nearest_e8(y[:, :8]), nearest_e8(y[:, 8:])], axis=1)
    rest = y - own
    # Squared distances grow by 2 - 2 r.v when a half moves by the root v.
    gain = np.concatenate([rest[:, :8] @ ROOTS.T, rest[:, 8:] @ ROOTS.T], axis=1)
    best = np.argpartition(-gain, probes, axis=1)[:, :probes]
    step = np.zeros((len(unit), probes, 16))
    side = best // 240
    step[..., :8] = np.where(side[..., None] == 0, ROOTS[best % 240], 0)
    step[..., 8:] = np.where(side[..., None] == 1, ROOTS[best % 240], 0)
    return np.rint(2 * own).astype(np.int64), np.rint(2 * (own[:, None, :] + step)).astype(np.int64)


def _hashed(points: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = scramble(seed.astype(np.uint64))
    for i in range(points.shape[-1]):
        h = scramble(h * np.uint64(0x9E3779B97F4A7C15) + points[..., i].astype(np.uint64))
    return h.view(np.int64)


def _unit_rows(column: pa.ListArray):
    for rows, matrix in matrices(column):
        matrix = matrix.astype(np.float64)
        yield rows, matrix / np.sqrt((matrix**2).sum(axis=1))[:, None]


def _keys(classes: DataFrame, cosine: float, tables: int, probes: int) -> DataFrame:
    """node and keys: for every table the own cell, then the `probes` neighbouring ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, seeds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, unit in _unit_rows(batch.column(2)):
                d = unit.shape[1]
                width = 5 * math.sqrt(2 - 2 * cosine) * math.sqrt(8 / max(d, 16))
                keys = np.empty((len(rows), tables, 1 + probes), np.int64)
                for number in range(tables):
                    own, near = _cells(unit, number, width, probes)
                    seed = seeds[rows].view(np.uint64) + np.uint64(number * 4096 + d)
                    keys[:, number, 0] = _hashed(own, seed)
                    keys[:, number, 1:] = _hashed(near, np.repeat(seed, probes).reshape(len(rows), probes))
                lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * (tables * (1 + probes)), keys.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), lists], ["node", "keys"])

    slim = classes.select("node", F.xxhash64("label").alias("seed"), "embedding")
    return slim.mapInArrow(run, "node long, keys array<long>")


def _elsewhere(keys: np.ndarray, number: int, node: np.ndarray) -> np.ndarray:
    """True where row x at home in a cell of table `number` and row y, found there too, count in another cell.

    A pair counts in the first table where it meets; there in the home of the smaller node if both homes see it.
    """
    away = np.zeros((len(keys), len(keys)), bool)
    for t in range(number + 1):
        seen = (keys[:, t, :1, None] == keys[:, t].T[None]).any(axis=1)  # x, y: y is in the home cell of x
        if t < number:
            away |= seen | seen.T
        else:
            away |= seen & seen.T & (keys[:, t, :1] != keys[:, t, :1].T) & (node[:, None] > node[None])
    return away


def _group_links(group: dict[str, np.ndarray], keys: np.ndarray, vectors: pa.Array, cosine: float) -> list[np.ndarray]:
    """node, root, links of the linked rows of one cell, or of two of its blocks.

    Links are sums of the class sizes over the pairs that count here; a root is the smallest node reached inside
    the group, so that a cluster leaves the task as a row a member, not as its pairs.
    """
    out = []
    for places, unit in _unit_rows(vectors):
        node, home, block, label, m = (group[c][places] for c in ("node", "home", "block", "label", "m"))
        home = home == 1
        close = unit @ unit.T >= cosine
        close &= (node[:, None] != node[None]) & (label[:, None] == label[None]) & home[:, None]
        if group["i"][0] != group["j"][0]:
            close &= block[:, None] != block[None]
        if not close.any():
            continue
        near = close | close.T
        order = np.argsort(node)
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        root = place.copy()
        while True:  # the smallest place among the neighbours, then the place that this one points to
            least = np.minimum(root, np.where(near, root[None], len(node)).min(axis=1))
            least = np.minimum(least, least[order[least]])
            if (least == root).all():
                break
            root = least
        here = close & ~_elsewhere(keys[places], int(group["number"][0]), node)
        links = here @ m + np.where(home, 0, m @ here)  # pairs of two rows at home are met from both sides
        kept = np.flatnonzero(near.any(axis=1))
        out.append(np.stack([node[kept], node[order[root[kept]]], links[kept]]))
    return out


def _meet(rows: DataFrame, cosine: float, tables: int) -> DataFrame:
    """node, root, links of every (key, i, j): rows at home against all others, of two blocks if i < j."""
    names = ("key", "number", "i", "j", "node", "home", "block", "label", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                rest = part if rest is None else pa.concat_tables([rest, part])
            if rest is None or not len(rest):
                continue
            rest = rest.combine_chunks()
            data = {n: rest.column(n).to_numpy() for n in names}
            new = np.any([np.diff(data[c]) != 0 for c in ("key", "number", "i", "j")], axis=0)
            cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(rest)]])
            last = len(cut) - 2 if batch is not None else len(cut) - 1  # the last group may go on
            keys = rest.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rest), tables, -1)
            found, vectors = [], rest.column("embedding").combine_chunks()
            for a, b in zip(cut[:last], cut[1 : last + 1]):
                if b - a > 1:
                    found += _group_links({n: v[a:b] for n, v in data.items()}, keys[a:b], vectors.slice(a, b - a), cosine)
            if found:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(found, axis=1))), ["node", "root", "links"])
            rest = rest.slice(cut[last])

    return rows.mapInArrow(run, "node long, root long, links long")


def near_vectors(
    rows: DataFrame,
    cosine: float = 0.98,
    tables: int = 4,
    probes: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """`id_col`, n_links, component_id and kept for every row of `rows`.

    Rows link when their labels are equal and their cosine, in double precision, is at least `cosine`; hashing
    may miss a link (tests hold the recall above 0.99) but every link is verified. Equal vectors of a label are
    one class and count as links of each other; a class is compared once, whatever its size. Vectors that are
    null, zero or hold null or non-finite components, and rows without a label or an id, link with nothing and
    are their own component. Vectors of different dimensions do not link. Rows that share an id are rows of their
    own: each counts its own links. Other columns are ignored.

    A pair that meets in several cells counts in one of them, which both rows know from their keys. So links are
    summed where they are found, and a cluster leaves a task as a row a member and group.
    """
    vector = F.col(vector_col)
    nonzero = F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    usable = all_finite(vector) & nonzero & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    known = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("embedding"),
        F.when(usable, F.xxhash64(F.col(label_col), vector)).alias("k1"),
        F.when(usable, F.xxhash64(vector, F.lit(97), F.col(label_col))).alias("k2"),
    )
    classes = materialise(
        known.where("k1 is not null").groupBy("k1", "k2").agg(
            F.min(F.struct("id", "label", "embedding")).alias("_first"), F.count("*").alias("m")
        ).select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "m", "_first.*"),
        "vector_classes",
    )
    keys = materialise(_keys(classes, cosine, tables, probes), "cell_keys")
    places = keys.select("node", F.posexplode("keys").alias("_at", "key")).select(
        "key", "node", F.expr(f"_at div {1 + probes}").cast("int").alias("number"),
        (F.col("_at") % (1 + probes) == 0).cast("int").alias("home"),
    )
    cells = (
        places.groupBy("key", "number").agg(F.count("*").alias("n"), F.max("home").alias("h"), F.min("node").alias("lo"), F.max("node").alias("hi"))
        .where("h = 1 and lo < hi").select("key", "number", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = places.join(cells, ["key", "number"]).withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    dealt = dealt.select(
        "key", "number", "node", "home", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    vectors = classes.select("node", F.xxhash64("label").alias("label"), "m", "embedding").join(keys, "node")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = ("key", "number", "i", "j")
    sorted_rows = dealt.join(vectors, "node").repartition(tasks, *group).sortWithinPartitions(*group)
    found = materialise(
        _meet(sorted_rows, cosine, tables).groupBy("node", "root").agg(F.sum("links").alias("links")), "vector_links"
    )
    parts = materialise(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "vector_components")
    counted = found.groupBy("node").agg(F.sum("links").alias("others"))
    linked = classes.select("node", "id").join(parts, "node")
    smallest = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    named = (
        classes.select("node", "k1", "k2", "id", "m").join(counted, "node", "left").join(parts, "node", "left").join(smallest, "component", "left")
        .select(
            F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
    )
    out = known.select("id", "k1", "k2").join(named, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


@query("op8_near_vectors")
def op8_near_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
