"""Importance resampling towards a target corpus by hashed n-gram features (Xie et al. 2023).

Two passes over the texts: one counts features by bucket, one sums the gains of a document's buckets out of an array.
The documents to draw are the ones with the highest scores (weight plus Gumbel noise seeded by the id). Their cutoff
is found by bracketing: a quantile sketch proposes two scores around the wanted rank, exact counts outside the
bracket confirm it or widen it, and only the rows inside a confirmed, small bracket are sorted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendguard.llm.memory import slices, tidy
from spendguard.llm.registry import query, table
from spendguard.operators.rank import distributed_rank
from spendguard.scratch import materialise

# The words of a text, once A-Z are lower case, are runs of digits, a-z and characters beyond ASCII.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_REACH = 256  # words up to this many bytes are appended to a checksum by table


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def _byte_steps() -> np.ndarray:
    """CRC-32 of zero bytes: the change of the register for each value of its low byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    return step


class BucketHash:
    """CRC-32 buckets of all runs of up to `width` words, from the checksums of single words.

    Checksums are linear: crc(a + b) = crc(a) pushed through len(b) zero bytes, xor crc(b). The push is four table
    look-ups, so whole arrays of runs are hashed at once and each distinct word is checksummed only once.
    """

    def __init__(self, buckets: int, width: int, cache_bytes: int = 64_000_000):
        self.buckets, self.width, self.limit = buckets, width, cache_bytes
        self.ids: dict[str, int] = {}
        steps = _byte_steps()
        # push[n, i, b]: byte i of the register is b and n zero bytes follow.
        push = np.empty((_REACH + 2, 4, 256), np.uint32)
        push[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
        for n in range(1, _REACH + 2):
            push[n] = steps[push[n - 1] & 0xFF] ^ (push[n - 1] >> 8)
        self.push = push.reshape(-1)
        self._forget()

    def _forget(self) -> None:
        self.ids.clear()
        self.size = 0
        self.alone, self.spaced, self.bytes = [], [], []

    def _learn(self, word: str) -> int:
        raw = word.encode()
        at = self.ids[word] = len(self.bytes)
        self.alone.append(zlib.crc32(raw))
        self.spaced.append(zlib.crc32(b" " + raw))
        self.bytes.append(len(raw) + 1)
        self.size += 300 + len(raw)
        return at

    def __call__(self, words: list[str], owners: list[int], starts: list[int]):
        """(bucket, owner) arrays of all runs inside the words of one owner; `starts[i]`: may runs start at word i."""
        if self.size > self.limit:
            self._forget()
        ids, learn = self.ids, self._learn
        flat = np.array([ids[w] if w in ids else learn(w) for w in words], np.int64)
        owner = np.asarray(owners, np.int64)
        spaced, lengths = np.array(self.spaced, np.uint32), np.array(self.bytes, np.int64)
        start = np.flatnonzero(starts)
        crc = np.array(self.alone, np.uint32)[flat[start]]
        out, whose = [crc % np.uint32(self.buckets)], [owner[start]]
        for n in range(1, self.width):
            inside = start + n < len(flat)
            inside[inside] = owner[start[inside] + n] == owner[start[inside]]
            start, crc = start[inside], crc[inside]
            added = flat[start + n]
            crc = self._pushed(crc, lengths[added]) ^ spaced[added]
            for i in np.flatnonzero(lengths[added] > _REACH):
                crc[i] = zlib.crc32(" ".join(words[start[i] : start[i] + n + 1]).encode())
            out.append(crc % np.uint32(self.buckets))
            whose.append(owner[start])
        return np.concatenate(out), np.concatenate(whose)

    def _pushed(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        at, push = np.minimum(n, _REACH + 1) * 1024, self.push
        low, second, third, high = ((crc >> np.uint32(shift)) & np.uint32(0xFF) for shift in (0, 8, 16, 24))
        return push[at + low] ^ push[at + 256 + second] ^ push[at + 512 + third] ^ push[at + 768 + high]


def _word_lists(text: str, width: int, most: int = 200_000) -> Iterator[tuple[list[str], int]]:
    """(words, how many of them runs may start at): the whole text, or parts of a very long one that overlap."""
    if len(text) < 4 * most:
        words = words_of(text)
        yield words, len(words)
        return
    found = (m.group() for m in _WORD.finditer(text.translate(_LOWER)))
    words = list(islice(found, most + width - 1))
    while len(words) > most:
        yield words, most
        words = words[most:] + list(islice(found, most))
    yield words, len(words)


def hashed_runs(texts: list[str], hashed: BucketHash, most: int = 200_000):
    """Blocks of (buckets, text numbers, word counts by text) that cover all runs of all texts."""
    words: list[str] = []
    owners: list[int] = []
    starts: list[bool] = []
    sizes = np.zeros(len(texts), np.int64)
    for number, text in enumerate(texts):
        for part, own in _word_lists(text, hashed.width, most):
            words += part
            owners += [number] * len(part)
            starts += [True] * own + [False] * (len(part) - own)
            sizes[number] += own
            if len(words) >= most:
                yield *hashed(words, owners, starts), sizes
                words, owners, starts, sizes = [], [], [], np.zeros(len(texts), np.int64)
    yield *hashed(words, owners, starts), sizes


def bucket_counts(
    docs: DataFrame, name: str, text_col: str = "text", buckets: int = 10_000, width: int = 3, max_bytes: int = 2_000_000
) -> DataFrame:
    """`bucket` and `name` (long): how many runs of 1 to `width` words of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = BucketHash(buckets, width), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column(0), max_bytes):
                for bucket, _, _ in hashed_runs(part.to_pylist(), hashed):
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "_n"])

    texts = docs.select(F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    return texts.mapInArrow(tidy(count), "bucket long, _n long").groupBy("bucket").agg(F.sum("_n").alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, width: int = 3) -> np.ndarray:
    """Gain of each bucket: thousandths of the log ratio of its smoothed shares in `target` and in `docs`."""
    counts = bucket_counts(docs, "s", buckets=buckets, width=width).join(
        bucket_counts(target, "t", buckets=buckets, width=width), "bucket", "full"
    )
    # At most `buckets` rows, whatever the input.
    got = np.array([(r["bucket"], r["s"] or 0, r["t"] or 0) for r in counts.collect()], np.int64).reshape(-1, 3)
    s, t = np.zeros((2, buckets))
    s[got[:, 0]], t[got[:, 0]] = got[:, 1], got[:, 2]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(
    docs: DataFrame, gains: np.ndarray, width: int = 3, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 2_000_000
) -> DataFrame:
    """`id_col`, n_words, n_features and weight (all long but the id) of every row; a null text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = BucketHash(len(gains), width)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), max_bytes):
                weight, size = np.zeros((2, len(part)), np.int64)
                for bucket, owner, words in hashed_runs(part.to_pylist(), hashed):
                    np.add.at(weight, owner, gains[bucket])
                    size += words
                runs = sum(np.maximum(size - n, 0) for n in range(width))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(size), pa.array(runs), pa.array(weight)], names
                )
                at += len(part)

    names = ["_id", "n_words", "n_features", "weight"]
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = slim.mapInArrow(tidy(weights), f"_id {kind}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("_id", id_col)


def _candidates(rows: DataFrame, column: str, share: float, accuracy: int) -> list[int]:
    """Values around the one that `share` of the rows lie above, from one sketch, and the middle of their range."""
    ladder = [0.0] + [sign * 2.0 * 4**i / accuracy for i in range(7) for sign in (-1, 1)]
    at = sorted({min(1.0, max(0.0, 1 - share + step)) for step in ladder})
    sketch = F.percentile_approx(column, F.array(*map(F.lit, at)), F.lit(accuracy))
    values, least, most = rows.agg(sketch, F.min(column), F.max(column)).first()
    return sorted({*values, least, (least + most) // 2, most})


def boundary(rows: DataFrame, n: int, count: int, keys: list[str], sort_rows: int = 100_000, accuracy: int = 10_000) -> tuple | None:
    """The keys (long, not null) of the `count`-th row in descending order of `keys` among `n`; None if `count` is 0.

    Each round proposes values by a sketch of the rows inside the bracket and counts exactly how many rows lie above
    and at each of them; the narrowest pair that holds the wanted rank is the next bracket, however wrong the sketch
    was. Brackets of at most `sort_rows` rows are sorted. A single value left hands its rows on to the next key.
    """
    if count < 1:
        return None
    inside, left, found = rows, count, []
    for key in keys:
        while True:
            if n <= sort_rows:
                last = inside.orderBy(*[F.col(c).desc() for c in keys]).offset(left - 1).limit(1).select(*keys).first()
                return tuple(last)
            values = _candidates(inside, key, left / n, accuracy)
            sums = [F.count(F.when(test, 1)) for v in values for test in (F.col(key) > v, F.col(key) >= v)]
            exact = inside.agg(*sums).first()
            above = dict(zip(values, exact[0::2]))
            upto = dict(zip(values, exact[1::2]))
            hit = [v for v in values if above[v] < left <= upto[v]]
            if hit:
                found.append(hit[0])
                left, n = left - above[hit[0]], upto[hit[0]] - above[hit[0]]
                inside = inside.where(F.col(key) == hit[0])
                break
            low = max(v for v in values if upto[v] >= left)
            high = min(v for v in values if above[v] < left)
            left, n = left - upto[high], above[low] - upto[high]
            inside = inside.where((F.col(key) > low) & (F.col(key) < high))
    return tuple(found)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    buckets: int = 10_000,
    width: int = 3,
    id_col: str = "doc_id",
    sort_rows: int = 100_000,
) -> DataFrame:
    """`id_col`, n_features, weight, score and rank (long) of every row of `docs`; rank is null for what is not drawn.

    `docs` and `target` have a `text`. Of the rows with at least `min_words` words, the floor of `percent` hundredths
    with the highest scores are drawn; ties go to the smaller id (null ids last), equal rows are drawn one by one.
    Texts that are null or empty weigh 0 and are never drawn; a null id counts as an empty one in the noise. An empty
    table gives an empty one, an empty target leaves all gains to the documents' own counts. Other columns are ignored.
    """
    gains = bucket_gains(docs, target, buckets, width)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(-1000 * F.log(-F.log((noise.cast("double") + 0.5) / 4294967296.0)))
    # Bitwise not turns ascending keys into descending ones; the row number makes equal rows differ.
    scored = materialise(
        weigh(docs, gains, width, id_col)
        .withColumn("score", F.col("weight") + gumbel)
        .withColumn("_named", F.col(id_col).isNotNull().cast("long"))
        .withColumn("_before", F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(0))))
        .withColumn("_row", F.monotonically_increasing_id()),
        "scored",
    )
    keys = ["score", "_named", "_before", "_row"]
    able = scored.where(F.col("n_words") >= min_words)
    n = able.count()
    last = boundary(able, n, percent * n // 100, keys, sort_rows)
    drawn = F.lit(False)
    if last is not None:
        drawn = (F.col("n_words") >= min_words) & (F.struct(*keys) >= F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(keys, last)]))
    columns = [id_col, "n_features", "weight", "score", "rank"]
    ranked = distributed_rank(scored.where(drawn), "rank", [F.col(c).desc() for c in keys])
    return ranked.select(*columns).unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*columns))


@query("op11_importance")
def op11_importance(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
