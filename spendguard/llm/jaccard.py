"""Self join of documents by Jaccard similarity of word n-grams, with a token-group matrix.

1. Equal n-gram sets form classes; from here on a class is one document.
2. Similar documents are gathered into groups: documents that share a min-hash are compared with the first of
   them, and verified links are joined to groups. A group of copies of any size needs one comparison each.
3. The token-group matrix holds, for every group, the union of its members' index tokens: under one global order
   of tokens (rare ones first), a set that overlaps enough with a larger one shares a token of its index prefix
   with the larger one's probe prefix. A document whose probe tokens are not in a group's row overlaps too
   little with every member; only the other groups are opened. Pairs with members are bounded by their
   sizes and by the tokens they share in slightly longer prefixes.
4. Opened pairs are verified with their whole sets; all links together give the components.

Hashes stand for n-grams (64 bits); sets are compared whole. No step pairs the members of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendguard.llm.graph import components
from spendguard.llm.language import text_chunks
from spendguard.llm.memory import tidy
from spendguard.llm.registry import query, table
from spendguard.scratch import materialise

MINHASHES = 6
SHARED = 4
ALIKE = 3  # equal min-hashes of documents that are compared to find groups
FILTER_BITS = 22
SKETCH_BITS = 20
SKETCH_SLICE = 1 << 14

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SEEDS = scramble(_BYTE[:MINHASHES] + np.uint64(1))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of all rows, and the row of each word."""
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    start[inner] = ~space[inner]  # a row's first byte starts a word whatever ends the row before
    where = np.flatnonzero(~space)
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(start[where])
    starts = where[first]
    place = where - np.repeat(starts, np.diff(np.append(first, len(where))))
    power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    value = _BYTE[_LOWER[data[where]] if lower else data[where]] * power[place]
    return scramble(np.add.reduceat(value, first)), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all rows, sorted within rows, and the first position of each row (rows + 1)."""
    words, row = word_hashes(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    step = np.uint64(0xD6E8FEB86659FD93)
    hashes, owner = [], []
    for size in range(1, width + 1):
        n = max(len(words) - size + 1, 0)
        keep = row[:n] == row[size - 1 : size - 1 + n]
        if size < width:
            keep &= count[row[:n]] == size  # a text of fewer words is one n-gram
        at = np.flatnonzero(keep)
        h = scramble(words[at] + np.uint64(size))
        for j in range(1, size):
            h = scramble(h * step + words[at + j])
        hashes.append(h)
        owner.append(row[at])
    h, r = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.searchsorted(r[new], np.arange(rows + 1))


def _least(numerator: int, denominator: int, n: np.ndarray) -> np.ndarray:
    """Fewest common n-grams that a set of n needs: the similarity is at most overlap / n."""
    return -(-numerator * n // denominator)


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """Per row its set's size, digest and min-hashes; per task a sketch of n-gram frequencies (n_shingles -1)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        schema = pa.schema(
            [("_id", pa.int64()), ("n_shingles", pa.int64()), ("_da", pa.int64()), ("_db", pa.int64()),
             ("_keys", pa.list_(pa.int64())), ("_slice", pa.int32()), ("_counts", pa.binary())]
        )
        for batch in batches:
            for start, end, data, offsets in text_chunks(batch.column(1)):
                h, cut = shingle_sets(data, offsets, width)
                n = np.diff(cut)
                has = np.flatnonzero(n)
                np.add.at(counts, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                digests, keys = np.zeros((2, end - start), np.uint64), np.zeros((end - start, MINHASHES), np.uint64)
                if len(has):
                    digests[0, has] = np.add.reduceat(scramble(h), cut[has])
                    digests[1, has] = np.bitwise_xor.reduceat(scramble(h * np.uint64(0x9FB21C651E98DF25)), cut[has])
                    for k in range(MINHASHES):
                        keys[has, k] = np.minimum.reduceat(scramble(h ^ _SEEDS[k]), cut[has])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start), pa.array(n, pa.int64()),
                        pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(end - start + 1) * MINHASHES, pa.int32()), pa.array(keys.ravel().view(np.int64))
                        ),
                        pa.nulls(end - start, pa.int32()), pa.nulls(end - start, pa.binary()),
                    ],
                    schema=schema,
                )
        slices = range(len(counts) // SKETCH_SLICE) if counts.any() else ()
        blobs = [counts[s * SKETCH_SLICE : (s + 1) * SKETCH_SLICE].tobytes() for s in slices]
        none = len(blobs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(none, pa.int64()), pa.array([-1] * none, pa.int64()), pa.nulls(none, pa.int64()),
                pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64())), pa.array(list(slices), pa.int32()),
                pa.array(blobs, pa.binary()),
            ],
            schema=schema,
        )

    return texts.mapInArrow(
        tidy(sketch), "_id long, n_shingles long, _da long, _db long, _keys array<long>, _slice int, _counts binary"
    )


def _frequencies(sketches: DataFrame) -> np.ndarray:
    """The merged frequency sketch: 2^20 counters whatever the input."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH_SLICE, np.uint64)
        for counts in group["_counts"]:
            total += np.frombuffer(counts, np.uint32)
        capped = np.minimum(total, (1 << 23) - 1).astype(np.uint32)
        return pd.DataFrame({"_slice": group["_slice"].iloc[:1], "_counts": [capped.tobytes()]})

    merged = np.zeros(1 << SKETCH_BITS, np.uint32)
    parts = sketches.where("n_shingles = -1").select("_slice", "_counts")
    for row in parts.groupBy("_slice").applyInPandas(add, "_slice int, _counts binary").collect():
        at = row["_slice"] * SKETCH_SLICE
        merged[at : at + SKETCH_SLICE] = np.frombuffer(row["_counts"], np.uint32)
    return merged


def _prefixes(texts: DataFrame, width: int, frequencies: np.ndarray, numerator: int, denominator: int) -> DataFrame:
    """Per row the prefix of its set: rare n-grams first, ties by hash; long enough for `SHARED` common ones."""
    shared = texts.sparkSession.sparkContext.broadcast(frequencies)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_chunks(batch.column(1)):
                h, cut = shingle_sets(data, offsets, width)
                n = np.diff(cut)
                often = shared.value[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort(((often << np.uint64(40)) | (h & np.uint64((1 << 40) - 1)), owner))
                length = np.minimum(n, n - _least(numerator, denominator, n) + SHARED)
                kept = h[order][np.arange(len(h)) - np.repeat(cut[:-1], n) < np.repeat(length, n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(kept.view(np.int64))
                        ),
                    ],
                    ["_id", "_prefix"],
                )

    return texts.mapInArrow(tidy(prefix), "_id long, _prefix array<long>")


def _marks(ids: DataFrame) -> np.ndarray:
    """A bit table of bounded size that has a bit for every id (and, by chance, bits for others)."""
    bits = ids.select(F.pmod(F.xxhash64("_id"), F.lit(1 << FILTER_BITS)).cast("int").alias("bit"))
    words = bits.groupBy(F.expr("bit div 32").cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, bit % 32))").alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for row in words.collect():
        table[row["w"]] = row["bits"]
    return table


def _sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The whole sets of the listed documents. The bit table keeps most other texts from being hashed, so no
    text is shuffled to find them; the join that follows is exact."""
    shared = texts.sparkSession.sparkContext.broadcast(_marks(ids))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(2).to_numpy()
            marked = shared.value[bits >> 5] >> (bits & 31).astype(np.uint32) & 1
            batch = batch.take(pa.array(np.flatnonzero(marked)))
            for start, end, data, offsets in text_chunks(batch.column(1)):
                h, cut = shingle_sets(data, offsets, width)
                blobs = [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(blobs, pa.binary())], ["_id", "_set"]
                )

    bit = F.pmod(F.xxhash64("_id"), F.lit(1 << FILTER_BITS))
    named = texts.where("_id is not null").select("_id", "_text", bit.alias("_bit"))
    return named.mapInArrow(tidy(whole), "_id long, _set binary").dropDuplicates(["_id"])


def _verified(pairs: DataFrame, texts: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if denominator * both >= numerator * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    side = {c: _sets(texts, pairs.select(F.col(c).alias("_id")), width) for c in ("a", "b")}
    first = pairs.select("a", "b").join(side["a"].select(F.col("_id").alias("a"), F.col("_set").alias("_x")), "a")
    second = first.join(side["b"].select(F.col("_id").alias("b"), F.col("_set").alias("_y")), "b")
    return second.select("a", "b", "_x", "_y").mapInArrow(tidy(check), "a long, b long")


def _comparable(x: str, y: str, numerator: int, denominator: int):
    return F.expr(f"{denominator} * least({x}, {y}) >= {numerator} * greatest({x}, {y})")


def similar_documents(
    docs: DataFrame,
    width: int = 4,
    numerator: int = 85,
    denominator: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry=(),
) -> DataFrame:
    """`id_col`, n_shingles and component_id for every row of `docs`.

    Documents link when denominator * intersection >= numerator * union of their sets of `width`-word n-grams;
    component_id is the smallest id reachable. A text of fewer words is one n-gram; a null text or one without
    words has an empty set and links with nothing. Rows that share an id (64-bit integers) are one document
    and should share a text; a row whose id is null takes part through its exact copies only. Other columns
    are ignored, whatever their names (`carry` lists those to pass on).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sketches = materialise(_sketches(texts, width), "sketches")
    known = sketches.where("n_shingles >= 0").drop("_slice", "_counts")
    classes = materialise(
        known.where("n_shingles > 0").groupBy("_da", "_db", "n_shingles")
        .agg(F.min("_id").alias("c"), F.first("_keys").alias("_keys")).where("c is not null"),
        "classes",
    )
    # Smaller sets link with equal ones only.
    smallest = next(n for n in range(1, 10**6) if n * denominator >= numerator * (n + 1))
    able = classes.where(F.col("n_shingles") >= smallest).select("c", F.col("n_shingles").alias("n"), "_keys")

    # Groups: documents with a common min-hash against the first of them.
    keyed = able.select("c", "n", "_keys", F.posexplode("_keys").alias("_k", "_key"))
    heads = keyed.groupBy("_k", "_key").agg(F.min(F.struct("c", "n", "_keys")).alias("_head"), F.count("*").alias("_m")).where("_m > 1")
    alike = F.size(F.filter(F.zip_with("_keys", "_head._keys", lambda x, y: x == y), lambda same: same))
    near = (
        keyed.join(heads, ["_k", "_key"]).where("c <> _head.c").where(alike >= ALIKE)
        .where(_comparable("n", "_head.n", numerator, denominator))
        .select(F.col("c").alias("a"), F.col("_head.c").alias("b")).distinct()
    )
    stars = materialise(_verified(materialise(near, "star_pairs"), texts, width, numerator, denominator), "star_links")
    groups = materialise(components(stars), "groups")

    # The matrix: tokens that occur in the index of a group and in a probe from outside it.
    prefixes = _prefixes(texts, width, _frequencies(sketches), numerator, denominator)
    members = able.select("c", "n").join(groups.withColumnRenamed("node", "c"), "c", "left").select(
        "c", "n", F.coalesce("component", "c").alias("g")
    )
    ordered = materialise(
        prefixes.join(members, prefixes["_id"] == members["c"]).dropDuplicates(["c"]).select("c", "n", "g", "_prefix"), "prefixes"
    )
    # Of two sets, the larger one probes (similarity <= overlap / n) the smaller one's index (overlap of equals).
    # Sets of n and m need an overlap of `overlap(n, m)`; where both sizes are known, prefixes shrink to it.
    needed = lambda n: f"(({numerator} * {n} + {denominator - 1}) div {denominator})"
    overlap = lambda n, m: f"(({numerator} * ({n} + {m}) + {denominator + numerator - 1}) div {denominator + numerator})"
    rows = ordered.select(
        "c", "n", "g", F.expr(f"posexplode(slice(_prefix, 1, cast(n - {needed('n')} + 1 as int)))").alias("_at", "token")
    ).withColumn("indexed", F.expr(f"_at < n - {overlap('n', 'n')} + 1"))
    apart = Window.partitionBy("token")
    inside = F.when(F.col("indexed"), F.col("g"))
    matrix = materialise(
        rows.withColumn("_low", F.min(inside).over(apart)).withColumn("_high", F.max(inside).over(apart))
        .withColumn("_lowest", F.min("g").over(apart)).withColumn("_highest", F.max("g").over(apart))
        .where("_low is not null and _lowest < _highest and (_low <> g or _high <> g or indexed)")
        .drop("_low", "_high", "_lowest", "_highest"),
        "token_rows",
    )
    indexed = matrix.where("indexed")
    unions = indexed.groupBy("token", "g").agg(F.min("n").alias("_least"), F.max("n").alias("_most")).withColumnRenamed("g", "h")
    smallest_other = f"greatest(_least, {needed('n')})"
    opened = materialise(
        matrix.join(unions, "token")
        .where(f"h <> g and _least <= n and {denominator} * _most >= {numerator} * n and _at <= n - {overlap('n', smallest_other)}")
        .select("c", "h").distinct(),
        "opened",
    )
    asking = matrix.join(opened, "c").select("c", "n", "h", "token", "_at")
    within = indexed.select(
        F.col("c").alias("d"), F.col("n").alias("m"), F.col("g").alias("h"), "token", F.col("_at").alias("_to")
    )
    found = (
        asking.join(within, ["token", "h"]).where(f"m <= n and {denominator} * m >= {numerator} * n")
        .where(f"_at <= n - {overlap('n', 'm')} and _to <= m - {overlap('n', 'm')}").select("c", "d", "n", "m").distinct()
    )
    longer = ordered.select("c", "_prefix")
    shared = f"{SHARED} + least({overlap('n', 'm')} - {needed('n')}, {overlap('n', 'm')} - {needed('m')})"
    common = (
        found.join(longer.withColumnRenamed("_prefix", "_pc"), "c")
        .join(longer.withColumnRenamed("c", "d").withColumnRenamed("_prefix", "_pd"), "d")
        .where(f"size(array_intersect(_pc, _pd)) >= least({shared}, {overlap('n', 'm')})")
    )
    across = materialise(
        common.select(F.greatest("c", "d").alias("a"), F.least("c", "d").alias("b")).distinct(), "pairs"
    )
    links = stars.unionByName(_verified(across, texts, width, numerator, denominator))
    parts = materialise(components(links), "components")
    named = classes.join(parts.withColumnRenamed("node", "c"), "c", "left").select(
        "_da", "_db", F.col("n_shingles").alias("_n"), F.coalesce("component", "c").alias("component_id")
    )
    out = known.join(
        named, (known["_da"] == named["_da"]) & (known["_db"] == named["_db"]) & (known["n_shingles"] == named["_n"]), "left"
    )
    return out.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("component_id", "_id").alias("component_id"))


@query("op7_ngram_jaccard")
def op7_ngram_jaccard(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"))
