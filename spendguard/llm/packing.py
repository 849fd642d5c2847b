"""Packing documents into token sequences of fixed capacity: bound-certified best-fit decreasing.

Each task packs a bounded number of pieces by best-fit decreasing and computes lower bounds on its number of
sequences with dual-feasible functions (Fekete and Schepers 2001). A task that meets its bound is certified.
The others give up the pieces of their sequences with room left; these are dealt out anew, so that tasks
exchange documents, and packed again. Rounds stop when everything is certified or nothing is saved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard.llm.bpe import SegmentIds
from spendguard.llm.memory import slices, tidy
from spendguard.llm.registry import query, table
from spendguard.scratch import materialise


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    ranks: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`id_col`, piece, start, length and ids (little-endian unsigned 32-bit) of every row of `docs`.

    A document is its token ids and then `end_id`; a null or empty text is `end_id` alone. Documents longer
    than `capacity` are cut so that all pieces but the first are full. Repeated rows give repeated pieces;
    columns other than the two named are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = SegmentIds(tokenizer, ranks)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows, pieces, starts, lengths, ids, size = [], [], [], [], [], 0
            texts = (text for part in slices(batch.column(1), 2_000_000) for text in part.to_pylist())
            for row, text in enumerate(texts):
                data = encode(text) + end
                n = len(data) // 4
                at, first = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    stop = first + piece * capacity
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(stop - at)
                    ids.append(data[4 * at : 4 * stop])
                    at = stop
                size += len(data)
                if size > 16_000_000:
                    yield _piece_batch(batch, rows, pieces, starts, lengths, ids)
                    rows, pieces, starts, lengths, ids, size = [], [], [], [], [], 0
            if rows:
                yield _piece_batch(batch, rows, pieces, starts, lengths, ids)

    slim = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    )
    kind = slim.schema["_id"].dataType.simpleString()
    out = slim.mapInArrow(tidy(cut), f"_id {kind}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("_id", id_col)


def _piece_batch(batch, rows, pieces, starts, lengths, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(rows, pa.int64())),
            pa.array(pieces, pa.int32()),
            pa.array(starts, pa.int64()),
            pa.array(lengths, pa.int64()),
            pa.array(ids, pa.binary()),
        ],
        ["_id", "piece", "start", "length", "ids"],
    )


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[x] items have size x (0 <= x <= capacity)."""
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    n, volume = np.cumsum(counts), np.cumsum(counts * x)
    eps = np.arange(1, capacity // 2 + 1)
    # Items over capacity - eps count as a bin each, those below eps as nothing.
    large = n[-1] - n[capacity - eps]
    middle = volume[capacity - eps] - volume[eps - 1]
    best = int((large + -(-middle // capacity)).max(initial=-(-int(volume[-1]) // capacity)))
    for cut in range(0, capacity // 2 + 1, max(1, capacity // 32)):
        raised = np.where(x > capacity - cut, capacity, np.where(x < cut, 0, x)) if cut else x
        for k in range(1, 21):
            steps = (k + 1) * raised
            value = np.where(steps % capacity == 0, raised * k, steps // capacity * capacity)
            best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the given order, and the room left in each bin."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    open_rooms = 0  # bit r: some bin has room r
    for i, size in enumerate(lengths.tolist()):
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                open_rooms ^= 1 << left
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - left
        left -= size
        room[b] = left
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def pack(
    pieces: DataFrame,
    capacity: int = 1024,
    length_col: str = "length",
    items_per_task: int = 60_000,
    max_rounds: int = 3,
    release_room: int = 4,
) -> DataFrame:
    """The rows of `pieces` with sequence_id, offset (both long) and certified (boolean).

    Lengths lie between 1 and `capacity`. All columns are carried along, so drop large ones first; columns
    named like the new ones are replaced. Equal rows are packed each; an empty table gives an empty one.
    `certified` says that the task that placed the row proved its number of sequences to be minimal.
    """
    spark = pieces.sparkSession
    rows = materialise(pieces.drop("sequence_id", "offset", "certified"), "pieces")
    parts = []
    columns = rows.columns
    for number in range(max_rounds):
        n = rows.count()
        if not n and number:
            break
        done = materialise(_pack_once(rows, capacity, length_col, math.ceil(n / items_per_task) or 1, number, release_room), "packed")
        if number:
            before, after = before_sequences, done.select("sequence_id").where("offset = 0").count()
            if after > before:  # keep what was
                parts.append(last)
                break
        kept, last = done.where("not released"), done.where("released")
        before_sequences = last.where("offset = 0").count()
        parts.append(kept)
        if not before_sequences or number == max_rounds - 1:
            parts.append(last)
            break
        rows = last.select(*columns)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.drop("released")


def _pack_once(rows, capacity, length_col, tasks, number, release_room) -> DataFrame:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        data = pa.Table.from_batches(got)
        lengths = data.column(length_col).to_numpy()
        order = np.argsort(-lengths, kind="stable")
        bins, offsets, room = best_fit(lengths[order], capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        certified = len(room) <= bound
        data = data.take(pa.array(order))
        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        released = (room[bins] >= release_room) & (not certified)
        for name, values in (
            ("sequence_id", pa.array(base + bins)),
            ("offset", pa.array(offsets)),
            ("certified", pa.array(np.full(len(bins), certified))),
            ("released", pa.array(released)),
        ):
            data = data.append_column(name, values)
        yield from data.combine_chunks().to_batches(max_chunksize=20_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(tasks).mapInArrow(
        tidy(packed), schema + ", sequence_id long, offset long, certified boolean, released boolean"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id and its ids (little-endian unsigned 32-bit), pieces in place."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` pieces
    joined = F.aggregate(ordered, F.lit(b""), lambda all_ids, one: F.concat(all_ids, one["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """Placement and checksum of every piece of `docs`."""
    import public_tokenizers

    pieces = cut_pieces(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query("op1_packing")
def op1_packing(spark, sf_dir):
    return packed_digests(table(spark, sf_dir, "documents"))
