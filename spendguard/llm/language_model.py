"""Scoring texts with a hierarchical Pitman-Yor language model (Teh 2006).

One restaurant per context, all sharing the root restaurant as parent; the root's base is uniform over the
known types and one unknown type. A context is the word before, by 40 bits of its hash, and every one has a restaurant.
Tables are seated by Gibbs sampling, and predictive probabilities are averaged over the samples.

Work is split by word. Each task turns its texts into blocks of (word, context) counts; the counts are shuffled to
buckets of words, and a bucket becomes one row that holds all counts of its words. Documents stay with their
block: a bucket sees one count of a pair a block, however many documents have it, and answers with one score.
Buckets send what they know of their contexts to shards of contexts, which sum it and send the totals back.
Given these and the totals of the frequent words (a bounded vector), buckets are sampled independently.
Frequent words are split over buckets by context. Samples depend on seeds only, so a bucket can be seated again,
alike, to score its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard.llm.jaccard import scramble, word_hashes
from spendguard.llm.language import held_out, text_chunks
from spendguard.llm.memory import give_back
from spendguard.llm.registry import query, table
from spendguard.scratch import keep, materialise, scope, session_conf, tasks

END = np.uint64(0x5851F42D4C957F2D)
CHUNK_BYTES = 2_000_000
HASH_BYTES = 1_000_000
CONTEXT = np.uint64((1 << 40) - 1)  # restaurants go by the lower 40 bits of the previous word's hash
UNIT = 2.0**-28  # of the scores that buckets send
SENT_WORDS = 500_000
#: Shuffle files go as soon as their job has written its table.
TIDY = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


@dataclass(frozen=True)
class Model:
    """Sizes, discounts, strengths and the totals that buckets share. Vectors are per frequent word; `frequent` is
    sorted. `contexts` (sorted), if given, have restaurants of their own, the others share one."""

    frequent: np.ndarray
    buckets: int
    seed: int
    contexts: np.ndarray | None = None
    discount: float = 0.8
    strength: float = 1.0
    root_discount: float = 0.8
    root_strength: float = 1.0
    types: int = 1
    tokens: int = 0
    word_counts: np.ndarray = field(default_factory=lambda: np.zeros(1))
    totals: tuple[float, ...] = ()  # per sample: tables of all contexts' restaurants
    word_tables: tuple[np.ndarray, ...] = ()  # per sample: root customers of frequent words
    root_tables: tuple[float, ...] = ()  # per sample

    def hot_of(self, words: np.ndarray) -> np.ndarray:
        """Place among the frequent words, or -1."""
        return _place(self.frequent, words)

    def context_of(self, words: np.ndarray) -> np.ndarray:
        if self.contexts is None:
            return words
        return np.where(_place(self.contexts, words) >= 0, words, np.uint64(0))

    def bucket_of(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Rare words whole; frequent ones by context, and by the pair where the context is frequent, too."""
        pair = np.where(self.hot_of(contexts) >= 0, scramble(words ^ scramble(contexts)), scramble(contexts))
        spread = np.where(self.hot_of(words) >= 0, pair, scramble(words))
        return (spread % np.uint64(self.buckets)).astype(np.int32)


def _place(among: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, words), len(among) - 1)
    return np.where(among[at] == words, at, -1)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: a row can be large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]
        if i % 64 == 63:
            give_back()
    give_back()


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with an end per row, their rows, and the word before each (the end before a row's first)."""
    rows = len(offsets) - 1
    parts, start = [], 0
    while start < rows:  # hashing needs many bytes per byte of text, so it takes a few rows at a time
        end = min(max(int(np.searchsorted(offsets, offsets[start] + HASH_BYTES, "right")) - 1, start + 1), rows)
        w, r = word_hashes(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        parts.append((w, r + start))
        start = end
    words = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, np.uint64)
    row = np.concatenate([r for _, r in parts]) if parts else np.zeros(0, np.int64)
    out = np.full(len(words) + rows, END)
    out[np.arange(len(words)) + row] = words
    owner = np.repeat(np.arange(rows), np.bincount(row, minlength=rows) + 1)
    before = np.append(END, out[:-1])
    return out, owner, before


def _texts(docs: DataFrame, id_col: str, text_col: str, held) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(held, F.lit(False)).alias("_held"),
        F.col(id_col).alias("_id"),
    )


def _frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, int, int]:
    """The `n` most frequent training words, most frequent first, the number of types and that of all tokens.

    Counts are whole: tasks send all their words, in parts of bounded size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(words, np.uint64(0)).view(np.int64)), pa.array(np.append(counts, 0)),
                    pa.array(np.append(np.zeros(len(words), np.int64), total)),
                ],
                ["word", "n", "total"],
            )

        for batch in batches:
            train = ~batch.column(1).to_numpy(zero_copy_only=False)
            for start, _, data, offsets in text_chunks(batch.column(0), CHUNK_BYTES):
                w, row, _before = _tokens(data, offsets)
                total += len(w)
                seen, times = np.unique(w[train[start + row]], return_counts=True)
                words, back = np.unique(np.concatenate([words, seen]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, times]), minlength=len(words)).astype(np.int64)
                if len(words) > SENT_WORDS:
                    yield sent()
                    words, counts, total = words[:0], counts[:0], 0
        yield sent()

    named = materialise(texts.mapInArrow(count, "word long, n long, total long"), "frequent")
    counts = named.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    total = named.agg(F.sum("total")).first()[0] or 0
    best = counts.orderBy(F.desc("n"), "word").limit(n).select("word").collect()
    return np.array([r["word"] for r in best], np.int64).view(np.uint64), counts.count(), total


_BLOBS = ("words", "word_pairs", "ks", "counts")
_DOCS = ("pair_docs", "docs", "times")
_ROW = ", ".join(f"{b} binary" for b in (*_BLOBS, *_DOCS))
_LISTS = ("ids", "held", "n_tokens")


def _block_rows(texts: DataFrame, model: Model, kind: str) -> DataFrame:
    """Counts of every block by bucket; a row with a negative bucket has the block's documents."""

    schema = pa.schema(
        [("block", pa.int64()), ("bucket", pa.int32()), *((b, pa.binary()) for b in (*_BLOBS, *_DOCS))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            held_all, ids_all = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            for start, end, data, offsets in text_chunks(batch.column(0), CHUNK_BYTES):
                for low in range(0, end - start, 60_000):  # document numbers of a block have 16 bits
                    high = min(low + 60_000, end - start)
                    part = offsets[low : high + 1]
                    held = held_all[start + low : start + high]
                    w, row, before = _tokens(data[part[0] : part[-1]], part - part[0])
                    lists = (ids_all.slice(start + low, high - low).to_pylist(), held.tolist(), np.bincount(row, minlength=high - low).tolist())
                    rows = _bucket_rows(w, model.context_of(before), row, held, model, block, lists)
                    columns = list(zip(*rows))
                    arrays = [pa.array(c, t.type) for c, t in zip(columns[:-1], schema)]
                    lists = [pa.array([x[i] if x else None for x in columns[-1]], t) for i, t in enumerate((pa.list_(ids_all.type), pa.list_(pa.bool_()), pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays([*arrays, *lists], [*schema.names, *_LISTS])
                    block += 1
            give_back()

    return texts.mapInArrow(
        run, f"block long, bucket int, {_ROW}, ids array<{kind}>, held array<boolean>, n_tokens array<long>"
    )


def _sorted(steps: bytes) -> np.ndarray:
    return np.cumsum(_numbers(steps).view(np.uint64), dtype=np.uint64)


def _bucket_rows(w, k, row, held, model: Model, block: int, lists: tuple) -> list[tuple]:
    """The (word, context) counts of one block, one tuple per bucket, and the documents of all its pairs in the
    order of buckets, words and contexts."""
    bucket = model.bucket_of(w, k)
    k = k & CONTEXT
    order = np.lexsort((row, k, w, bucket))
    w, k, row, bucket = w[order], k[order], row[order], bucket[order]
    new_word = np.ones(len(w), bool)
    new_word[1:] = (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1])
    new_pair = new_word.copy()
    new_pair[1:] |= k[1:] != k[:-1]
    new_doc = new_pair.copy()
    new_doc[1:] |= row[1:] != row[:-1]
    doc_at = np.flatnonzero(new_doc)
    times = np.diff(np.append(doc_at, len(w)))
    doc_pair = np.cumsum(new_pair)[doc_at] - 1
    pair_at = np.flatnonzero(new_pair)
    trained = np.bincount(doc_pair, np.where(held[row[doc_at]], 0, times), minlength=len(pair_at)).astype(np.int64)
    pair_docs = np.bincount(doc_pair, minlength=len(pair_at))
    word_at = np.flatnonzero(new_word)
    word_pairs = np.diff(np.append(np.cumsum(new_pair)[word_at] - 1, len(pair_at)))
    names, word_cut = np.unique(bucket[word_at], return_index=True)
    word_cut = np.append(word_cut, len(word_at))
    pair_cut = np.searchsorted(bucket[pair_at], np.append(names, model.buckets))
    documents = (pair_docs, row[doc_at], times)
    out = [(block, -1 - block % 1_000_003, *[None] * len(_BLOBS), *(_planes(b) for b in documents), lists)]
    for i, name in enumerate(names):
        ws, ps = (slice(c[i], c[i + 1]) for c in (word_cut, pair_cut))
        steps = np.diff(w[word_at[ws]], prepend=np.uint64(0))  # sorted: steps have fewer bytes than words
        blobs = (steps, word_pairs[ws], k[pair_at[ps]], trained[ps])
        out.append((block, int(name), *(_planes(b) for b in blobs), *[None] * len(_DOCS), None))
    return out


_MERGED = f"bucket int, blocks binary, sizes binary, places binary, words binary, contexts binary, word_pairs binary, ks binary, counts binary, block long, {', '.join(f'{b} binary' for b in _DOCS)}"


def _merge(rows: DataFrame, kind: str) -> DataFrame:
    """One row per bucket with the counts of all blocks and the place of every block's pairs among them; documents
    go through."""

    def one(bucket: int, parts: list[dict]) -> tuple:
        sizes = np.array([_numbers(p["word_pairs"]).sum() for p in parts], np.int64)
        ends = np.cumsum(sizes)
        w, ks, counts = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32)
        for p, n, end in zip(parts, sizes, ends):  # a block's blobs go once they are read
            w[end - n : end] = np.repeat(_sorted(p.pop("words")), _numbers(p.pop("word_pairs")))
            ks[end - n : end] = _numbers(p.pop("ks")).view(np.uint64)
            counts[end - n : end] = _numbers(p.pop("counts"))
        order = np.lexsort((ks, w)).astype(np.uint32)
        w, ks = w[order], ks[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (ks[1:] != ks[:-1])
        at = np.flatnonzero(new)
        pair = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        total = np.bincount(pair, counts[order])
        places = np.empty(len(order), np.int64)
        places[order] = pair
        del order, pair, counts, new
        places = np.concatenate([np.diff(places[e - n : e], prepend=0) for n, e in zip(sizes, ends)])  # ascending in a block
        merged, n_pairs = np.unique(w[at], return_counts=True)
        contexts, at_context = np.unique(ks[at], return_inverse=True)
        blocks = np.array([p["block"] for p in parts])
        steps = (np.diff(a, prepend=np.uint64(0)) for a in (merged, contexts))
        blobs = (blocks, sizes, places, *steps, n_pairs, at_context, total)
        return (bucket, *(_planes(b) for b in blobs), None, *[None] * len(_DOCS))

    names = [c.split()[0] for c in _MERGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []

        def flush():
            made = one(waiting[0]["bucket"], waiting)
            kinds = [pa.int32(), *[pa.binary()] * 8, pa.int64(), *[pa.binary()] * len(_DOCS)]
            arrays = [pa.array([x], t) for x, t in zip(made, kinds)]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(1, t) for t in lists)], [*names, *_LISTS])

        for batch in batches:
            lists = [batch.schema.field(c).type for c in _LISTS]
            numbers = batch.column(1).to_numpy()
            listed = np.flatnonzero(numbers < 0)
            if len(listed):
                part = batch.take(pa.array(listed))
                blank = [pa.nulls(len(listed), pa.binary())] * 8
                through = [part.column(c) for c in (*_DOCS, *_LISTS)]
                yield pa.RecordBatch.from_arrays([part.column(1), *blank, part.column(0), *through], [*names, *_LISTS])
            for row in _each(batch.select(["block", "bucket", *_BLOBS]).take(pa.array(np.flatnonzero(numbers >= 0)))):
                if waiting and waiting[0]["bucket"] != row["bucket"]:
                    yield flush()
                    waiting.clear()
                waiting.append(row)
        if waiting:
            yield flush()

    return rows.mapInArrow(run, f"{_MERGED}, ids array<{kind}>, held array<boolean>, n_tokens array<long>")


def seat(counts: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that `counts` customers open, one restaurant and dish per row: the next customer opens a table in
    proportion to `weight`, or joins one in proportion to customers less `discount` per table. From the 64th
    customer on they come in groups of a tenth of those seated."""
    opened = np.minimum(counts, 1).astype(np.float64)
    order = np.argsort(-counts.astype(np.int64), kind="stable")
    size, fresh = counts[order].astype(np.int64), weight[order]
    state = opened[order]
    n = 1
    live = int(np.searchsorted(-size, -n, "left"))
    while live:
        group = 1 if n < 64 else max(n // 10, 1)
        chance = fresh[:live] / (fresh[:live] + np.maximum(n - discount * state[:live], 1e-12))
        if group == 1:
            state[:live] += rng.random(live) < chance
        else:
            state[:live] += rng.binomial(np.minimum(group, size[:live] - n), np.clip(chance, 0, 1))
        n += group
        live = int(np.searchsorted(-size, -n, "left"))
    opened[order] = state
    return opened


class Bucket:
    """The counts of a bucket's words and samples of their seating; `told` are the answers of the shards, by round."""

    def __init__(self, row: dict, model: Model, told: list[dict] = ()):
        self.model, self.number = model, row["bucket"]
        self.words, self.contexts = _sorted(row["words"]), _sorted(row["contexts"])
        self.ks, self.counts = _numbers(row["ks"]), _numbers(row["counts"])
        self.word = np.repeat(np.arange(len(self.words)), _numbers(row["word_pairs"]))
        self.hot = model.hot_of(self.words)
        self.cold = self.hot < 0
        self.word_counts = np.bincount(self.word, self.counts, minlength=len(self.words))
        self.shard = (scramble(self.contexts) % np.uint64(model.buckets)).astype(np.int64)
        rounds: dict[int, list] = {}
        for answer in told:
            at = np.flatnonzero(self.shard == answer["shard"])
            values = _numbers(answer["values"]).reshape(-1, len(at)).astype(np.float64)
            known = rounds.setdefault(answer["round"], np.zeros((len(values), len(self.contexts))))
            known[:, at] = values
        # Per context of the bucket: the customers of its restaurant and, per sample, its tables.
        self.customers, *self.opened = [x for r in sorted(rounds) for x in rounds[r]] or [None]

    def root(self, customers: np.ndarray, tables: np.ndarray, root_tables: float, total: float) -> np.ndarray:
        m = self.model
        fresh = (m.root_strength + m.root_discount * root_tables) / (m.types + 1)
        return (customers - m.root_discount * tables + fresh) / (m.root_strength + total)

    def samples(self, start: int, kept: int):
        """`kept` samples after one sweep to forget the start: tables per pair, root customers and root tables per word."""
        m = self.model
        total, word_tables, root_tables = m.totals[start], m.word_tables[start], m.root_tables[start]
        opened = self.opened[start][self.ks] if self.opened else total / max(m.types, 1)
        fresh_root = (m.root_strength + m.root_discount * root_tables) / (m.types + 1)
        customers = np.bincount(self.word, self.counts > 0, minlength=len(self.words))
        customers[~self.cold] = word_tables[self.hot[~self.cold]]
        for sweep in range(kept + 1):
            rng = np.random.default_rng([m.seed, self.number, sweep])
            tables = seat(customers.round().astype(np.int64), np.full(len(self.words), fresh_root), m.root_discount, rng)
            parent = self.root(customers, tables, root_tables, total)
            seated = seat(self.counts, (m.strength + m.discount * opened) * parent[self.word], m.discount, rng)
            customers = np.bincount(self.word, seated, minlength=len(self.words))
            customers[~self.cold] = word_tables[self.hot[~self.cold]]
            if sweep:
                again = seat(customers.round().astype(np.int64), np.full(len(self.words), fresh_root), m.root_discount, rng)
                yield seated, customers, np.where(self.cold, again, 0)

    def totals(self, start: int, kept: int):
        """(kind, sample, place, value) of what the buckets have to sum, and per context rows of what shards do:
        customers before the first round, then the tables of every sample."""
        hot = np.flatnonzero(~self.cold)
        found = [*_vector("word_counts", 0, self.hot[hot], self.word_counts[hot])]
        found.append(("tokens", 0, 0, float(self.counts.sum())))
        found.append(("types", 0, 0, float((self.word_counts[self.cold] > 0).sum())))
        found.append(("once", 0, 0, float((self.counts == 1).sum())))
        found.append(("twice", 0, 0, float((self.counts == 2).sum())))
        asked = [] if self.opened else [np.bincount(self.ks, self.counts, minlength=len(self.contexts))]
        for s, (seated, customers, root) in enumerate(self.samples(start, kept)):
            asked.append(np.bincount(self.ks, seated, minlength=len(self.contexts)))
            found.append(("totals", s, 0, float(seated.sum())))
            mine = ~self.cold[self.word]
            found += _vector("word_tables", s, self.hot[self.word[mine]], seated[mine])
            found.append(("root_tables", s, 0, float(root.sum())))
            found.append(("root_once", s, 0, float((customers[self.cold] == 1).sum())))
            found.append(("root_twice", s, 0, float((customers[self.cold] == 2).sum())))
        return found, np.stack(asked)

    def questions(self, asked: np.ndarray):
        """(shard, contexts, values) of what the bucket knows of its contexts."""
        order = np.argsort(self.shard, kind="stable")
        shards, first = np.unique(self.shard[order], return_index=True)
        for shard, at in zip(shards, np.split(order, first[1:])):
            yield int(shard), self.contexts[at].tobytes(), _planes(asked[:, at])

    def log_scores(self, kept: int) -> tuple[np.ndarray, np.ndarray]:
        """Per pair the averaged predictive log10 probability, per word its whole count."""
        m = self.model
        chance = np.zeros(len(self.ks))
        for s, (seated, customers, root) in enumerate(self.samples(0, kept), start=1):
            hot = ~self.cold
            customers = customers.copy()
            customers[hot] = m.word_tables[s][self.hot[hot]]
            root[hot] = _hot_root(m, s)[self.hot[hot]]
            parent = self.root(customers, root, m.root_tables[s], m.totals[s])[self.word]
            kinds = self.customers[self.ks]
            backed = (m.strength + m.discount * self.opened[s][self.ks]) * parent
            chance += np.where(kinds > 0, (self.counts - m.discount * seated + backed) / (m.strength + kinds), parent)
        whole = np.where(self.cold, self.word_counts, m.word_counts[np.maximum(self.hot, 0)])
        return np.log10(chance / kept), whole


def _vector(kind: str, sample: int, places: np.ndarray, values: np.ndarray):
    summed = np.bincount(places, values) if len(places) else np.zeros(0)
    for at in np.flatnonzero(summed):
        yield kind, sample, int(at), float(summed[at])


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers of 0 or more: how many bytes each has, then the lowest bytes of all, the next bytes, and so on."""
    if values.dtype.kind == "f":
        values = np.rint(values).astype(np.int64)
    values = values.astype(np.uint64).ravel()
    size = max((int(values.max(initial=0)).bit_length() + 7) // 8, 1)
    return bytes([size]) + values.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    size = planes[0]
    out = np.zeros(((len(planes) - 1) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(planes, np.uint8, offset=1).reshape(size, -1).T
    return out.view(np.int64).ravel()


def _hot_root(model: Model, sample: int) -> np.ndarray:
    """Root tables of the frequent words, from their root customers: every caller draws the same."""
    fresh = (model.root_strength + model.root_discount * model.root_tables[0]) / (model.types + 1)
    rng = np.random.default_rng([model.seed, sample])
    customers = model.word_tables[sample].round().astype(np.int64)
    return seat(customers, np.full(len(customers), fresh), model.root_discount, rng)


_COUNTS = ("bucket", "words", "contexts", "word_pairs", "ks", "counts")


def _answered(merged: DataFrame, told: list[DataFrame], columns=_COUNTS) -> DataFrame:
    """Rows of buckets, each with the shards' answers of all rounds behind it."""
    own = merged.where("bucket >= 0").select(*columns)
    if not told:
        return own.selectExpr("*", "cast(null as int) as round", "cast(null as int) as shard", "cast(null as binary) as values")
    rows = own
    for i, answers in enumerate(told):
        rows = rows.unionByName(answers.withColumn("round", F.lit(i)), allowMissingColumns=True)
    parts = rows.repartition(max(tasks(merged.sparkSession), 1), "bucket")
    return parts.sortWithinPartitions("bucket", F.asc_nulls_first("round"), "shard")


def _buckets(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[dict, Bucket]]:
    head, told = None, []
    for batch in batches:
        for row in _each(batch):
            if row["round"] is None:
                if head is not None:
                    yield head, Bucket(head, model, told)
                head, told = row, []
            else:
                told.append(row)
    if head is not None:
        yield head, Bucket(head, model, told)


def _round(merged: DataFrame, told: list[DataFrame], model: Model, kept: int) -> tuple[dict[tuple[str, int], np.ndarray], DataFrame]:
    """The sums over all buckets, and for every bucket the sums of its contexts over all buckets."""
    shared = merged.sparkSession.sparkContext.broadcast(model)  # bounded by the number of frequent words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "sample", "place", "value", "shard", "bucket", "contexts", "values"]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        for _, bucket in _buckets(batches, shared.value):
            found, asked = bucket.totals(0, kept)
            rows = [(*f, *[None] * 4) for f in found]
            rows += [(*[None] * 4, shard, bucket.number, *blobs) for shard, *blobs in bucket.questions(asked)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []

        def sent() -> pa.RecordBatch:
            asked = [np.frombuffer(r["contexts"], np.uint64) for r in waiting]
            _, place = np.unique(np.concatenate(asked), return_inverse=True)
            values = np.concatenate([_numbers(r["values"]).reshape(-1, len(a)) for r, a in zip(waiting, asked)], axis=1)
            sums = np.stack([np.bincount(place, v)[place] for v in values])
            back = np.split(sums, np.cumsum([len(a) for a in asked])[:-1], axis=1)
            columns = ([r["bucket"] for r in waiting], [r["shard"] for r in waiting], [_planes(b) for b in back])
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "shard", "values"])

        for batch in batches:
            for row in _each(batch):
                if waiting and waiting[0]["shard"] != row["shard"]:
                    yield sent()
                    waiting.clear()
                waiting.append(row)
        if waiting:
            yield sent()

    parts = materialise(
        _answered(merged, told).mapInArrow(
            run, "kind string, sample int, place int, value double, shard int, bucket int, contexts binary, values binary"
        ),
        "round",
    )
    out: dict[tuple[str, int], np.ndarray] = {}
    for r in parts.where("shard is null").groupBy("kind", "sample", "place").agg(F.sum("value").alias("value")).collect():
        out.setdefault((r["kind"], r["sample"]), np.zeros(len(model.frequent)))[r["place"]] = r["value"]
    asked = parts.where("shard is not null").select("shard", "bucket", "contexts", "values")
    sorted_ = asked.repartition(max(tasks(merged.sparkSession), 1), "shard").sortWithinPartitions("shard", "bucket")
    return out, keep(sorted_.mapInArrow(answer, "bucket int, shard int, values binary"), "answers")


def _updated(model: Model, sums: dict, kept: int) -> Model:
    """`model` with the totals of the samples behind the ones it was sampled with."""
    n = len(model.frequent)
    get = lambda kind, s=0: sums.get((kind, s), np.zeros(n))
    types = int(get("types")[0] + (get("word_counts") > 0).sum())
    plain = replace(model, types=types, tokens=int(get("tokens")[0]), word_counts=get("word_counts"))
    totals = tuple(float(get("totals", s)[0]) for s in range(kept))
    word_tables = tuple(get("word_tables", s) for s in range(kept))
    grown = replace(plain, totals=(*plain.totals[:1], *totals), word_tables=(*plain.word_tables[:1], *word_tables))
    roots = tuple(get("root_tables", s)[0] + _hot_root(grown, s + 1).sum() for s in range(kept))
    return replace(grown, root_tables=(*plain.root_tables[:1], *roots))


def _discount(once: float, twice: float) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once + twice else 0.5


def score_texts(
    docs: DataFrame,
    held: F.Column | None = None,
    contexts: int | None = None,
    samples: int = 3,
    tokens_per_bucket: int = 1_300_000,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_words: int = 4_000,
) -> DataFrame:
    """Per row of `docs`: `id_col`, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows where `held` is not true and scores all of them, whole. Words are what white
    space leaves, A-Z in lower case, and one end per text, which a null or empty text has alone. base_score is
    the log10 probability of add-one counts, score that of the Pitman-Yor model averaged over `samples` seatings.
    Reruns on the same rows agree but for rounding, however they are partitioned. Every previous word has a restaurant of its own;
    with `contexts`, only so many most frequent ones and the end do. `tokens_per_bucket` bounds a task's memory,
    `hot_words` are split over buckets. Repeated rows count each; columns not named are ignored.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col, F.lit(False) if held is None else held)
    kind = texts.schema["_id"].dataType.simpleString()
    with scope(spark), session_conf(spark, **TIDY):
        ranked, n_types, n_tokens = _frequent(texts, max(hot_words, contexts or 0))
    frequent, own = (np.unique(np.append(ranked[:m], END)) for m in (hot_words, contexts or 0))
    n = len(frequent)
    model = Model(
        frequent=frequent, buckets=max(1, math.ceil(n_tokens / tokens_per_bucket)), seed=seed,
        contexts=None if contexts is None else own,
    )
    rows = _block_rows(texts, model, kind)
    with session_conf(spark, **TIDY):
        merged = materialise(_merge(rows.repartition(max(tasks(spark), 1), "bucket").sortWithinPartitions("bucket", "block"), kind), "buckets")

    # A first round from a guess of the totals (types near 0.8 of the customers' logarithm), then the samples.
    guess = max(n_tokens, 1) ** 0.8
    model = replace(
        model, types=max(n_types, 1), totals=(guess,), word_tables=(np.full(n, guess / n),), root_tables=(float(max(n_types, 1)),)
    )
    with scope(spark), session_conf(spark, **TIDY):
        first, answers = _round(merged, [], model, 1)
    model = _updated(model, first, 1)
    model = replace(
        model, totals=model.totals[1:], word_tables=model.word_tables[1:], root_tables=model.root_tables[1:],
        discount=_discount(first.get(("once", 0), [0])[0], first.get(("twice", 0), [0])[0]),
        root_discount=_discount(first.get(("root_once", 0), [0])[0], first.get(("root_twice", 0), [0])[0]),
    )
    with scope(spark), session_conf(spark, **TIDY):
        sums, more = _round(merged, [answers], model, samples)
    model = _updated(model, sums, samples)
    shared = spark.sparkContext.broadcast(model)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, bucket in _buckets(batches, shared.value):
            score, whole = bucket.log_scores(samples)
            values = (whole[bucket.word], -np.minimum(score, 0) / UNIT)
            places, blocks, sizes = (_numbers(row[c]) for c in ("places", "blocks", "sizes"))
            ends = np.cumsum(sizes)
            for low in range(0, len(blocks), 100):
                out = []
                for block, size, end in zip(blocks[low : low + 100], sizes[low : low + 100], ends[low : low + 100]):
                    at = np.cumsum(places[end - size : end])
                    out.append((int(block), bucket.number, *(_planes(v[at]) for v in values)))
                kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["block", "bucket", "whole", "score"])

    parts = _answered(merged, [answers, more], (*_COUNTS, "places", "blocks", "sizes")).mapInArrow(
        partial, "block long, bucket int, whole binary, score binary"
    )
    lists = merged.where("bucket < 0").select("block", *_DOCS, *_LISTS)
    together = parts.unionByName(lists, allowMissingColumns=True)

    n_train, n_known = model.tokens, model.types

    def gather(group: pa.Table) -> pa.Table:
        names = group.column("ids").combine_chunks()
        head = next(i for i in range(len(names)) if names[i].is_valid)
        ids = names[head].values
        pair_docs, docs, times = (
            _numbers(group.column(c)[head].as_py()) for c in _DOCS
        )
        answers = [r for r in group.select(["bucket", "whole", "score"]).to_pylist() if r["bucket"] is not None]
        answers.sort(key=lambda r: r["bucket"])
        pair = np.repeat(np.arange(len(pair_docs)), pair_docs)
        whole, score = (np.concatenate([_numbers(r[c]) for r in answers]) for c in ("whole", "score"))
        base = np.log10((whole + 1) / (n_train + n_known + 1))
        sums = [np.bincount(docs, times * v[pair], minlength=len(ids)) for v in (whole > 0, base, score)]
        return pa.table(
            {
                "_id": ids, "held_out": group.column("held")[head].values, "n_tokens": group.column("n_tokens")[head].values,
                "n_known": pa.array(sums[0].astype(np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(-sums[2] * UNIT),
            }
        )

    out = together.groupBy("block").applyInArrow(
        gather, f"_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query("op3_language_model")
def op3_language_model(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"), held=held_out("doc_id", 7))
