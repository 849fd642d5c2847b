"""Language identification by multilingual mixture inference.

Every language is a distribution over character n-grams (byte trigrams of lower-cased words with their
borders, hashed into a fixed table). A document is a mixture: each word is drawn from one of its languages, in
the document's proportions. Expectation-maximisation estimates the proportions; the set of languages is the
one with the best likelihood less a penalty per language (Lui, Lau and Baldwin 2014 take this view).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard.llm.memory import tidy
from spendguard.llm.registry import query, table

BITS = 18
SLICE = 1 << 12
CHUNK_BYTES = 1_000_000

# ASCII letters to lower case, other ASCII to the border byte; bytes of longer characters stay.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) of runs of rows of about `chunk_bytes`; null counts as empty."""
    column = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + chunk_bytes, "right"))
        end = min(max(end - 1, start + 1), len(column))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_grams(data: np.ndarray, offsets: np.ndarray):
    """Hashes of all n-grams, the index of the first n-gram of every word, and the row of every word."""
    n = len(data)
    rows = len(offsets) - 1
    # One border byte in front of every row, one behind the last.
    buffer = np.full(n + rows + 1, 32, np.uint32)
    lengths = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), lengths)
    at = np.arange(n) + row_of + 1
    buffer[at] = _FOLD[data]
    inside = buffer != 32
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    used = inside.copy()
    used[1:] |= inside[:-1]  # the border behind a word ends its last n-gram
    where = np.flatnonzero(used)
    gram = buffer[where] + (buffer[where - 1] << np.uint32(8)) + (np.where(start[where], 32, buffer[where - 2]) << np.uint32(16))
    hashed = (gram * np.uint32(2654435769)) >> np.uint32(32 - BITS)
    first = np.flatnonzero(start[where])
    starts = where[first]
    row_starts = offsets[:-1] + np.arange(rows)
    return hashed, first, np.searchsorted(row_starts, starts, "right") - 1


def _model_counts(docs: DataFrame) -> pd.DataFrame:
    """Hashed n-gram counts per language: `lang`, `slice` and `counts` (64-bit integers as bytes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, _end, data, offsets in text_chunks(batch.column(1)):
                hashed, first, row = word_grams(data, offsets)
                if not len(first):
                    continue
                gram_row = np.repeat(row, np.diff(np.append(first, len(hashed))))
                codes, names = pd.factorize(np.array(langs[start:_end], object))
                for code, name in enumerate(names):
                    mine = hashed[codes[gram_row] == code]
                    tables[name] = tables.get(name, 0) + np.bincount(mine, minlength=1 << BITS)
        rows = [
            (name, s, counts[s * SLICE : (s + 1) * SLICE].astype(np.int64).tobytes())
            for name, counts in tables.items()
            for s in range((1 << BITS) // SLICE)
        ]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.binary()))],
                ["lang", "slice", "counts"],
            )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for counts in group["counts"]:
            total += np.frombuffer(counts, np.int64)
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "slice": group["slice"].iloc[:1], "counts": [total.tobytes()]})

    schema = "lang string, slice int, counts binary"
    parts = docs.select("lang", "text").mapInArrow(tidy(count), schema)
    return parts.groupBy("lang", "slice").applyInPandas(add, schema).toPandas()


def fit_languages(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs_per_lang: int = 4_000,
    smoothing: float = 0.5,
) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and log-probabilities of the hashed n-grams, one row per language.

    At most about `max_docs_per_lang` documents per language are learned from, picked by a hash of `id_col`.
    Rows without a label or a text are ignored. The size of the model is languages x 2^18 numbers.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    full = {lang: n for lang, n in counts.items() if n > max_docs_per_lang}
    draw = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30))
    keep = F.lit(True)
    if full:
        limit = F.create_map(*[x for lang, n in full.items() for x in (F.lit(lang), F.lit(int((1 << 30) * max_docs_per_lang / n)))])
        keep = F.coalesce(draw < limit[F.col("lang")], F.lit(True))
    found = _model_counts(rows.where(keep))
    langs = sorted(set(found["lang"]), key=lambda s: list(map(ord, s)))
    weights = np.zeros((len(langs), 1 << BITS), np.float32)
    for i, lang in enumerate(langs):
        total = np.concatenate([np.frombuffer(c, np.int64) for c in found[found["lang"] == lang].sort_values("slice")["counts"]])
        weights[i] = np.log((total + smoothing) / (total.sum() + smoothing * len(total)))
    return langs, weights


def mixture(scores: np.ndarray, rows: np.ndarray, n_rows: int, penalty: float = 2.0, steps: int = 12):
    """Language and confidence of each row from the log-likelihoods of its words (words x languages)."""
    k = scores.shape[1]
    best, sure = np.full(n_rows, -1), np.zeros(n_rows)
    if not len(rows):
        return best, sure
    cut = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    there, words = rows[cut], np.diff(np.append(cut, len(rows)))
    doc = np.repeat(np.arange(len(there)), words)
    top = scores.max(axis=1)
    likely = np.exp(scores - top[:, None])
    one = np.add.reduceat(scores.astype(np.float64), cut, axis=0)
    single = one.argmax(axis=1)
    allowed = np.ones((len(there), k), bool)
    share, fit = _em(likely, doc, cut, words, allowed, steps)
    base = np.add.reduceat(top.astype(np.float64), cut)
    cost = penalty * np.log(words + 1.0)
    # The best sets of 1, 2, ... languages, by falling share; most documents end with one.
    chosen, value = np.zeros((len(there), k), bool), one.max(axis=1)
    chosen[np.arange(len(there)), single] = True
    order = np.argsort(-share, axis=1)
    mixed = np.flatnonzero(fit + base - cost > value)
    for size in range(2, k + 1):
        if not len(mixed):
            break
        picked = np.zeros((len(mixed), k), bool)
        np.put_along_axis(picked, order[mixed, :size], True, axis=1)
        word = np.isin(doc, mixed)
        local = np.searchsorted(mixed, doc[word])
        local_cut = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        part, got = _em(likely[word], local, local_cut, words[mixed], picked, steps)
        got = got + base[mixed] - (size - 1) * cost[mixed]
        better = got > value[mixed]
        chosen[mixed[better]], value[mixed[better]], share[mixed[better]] = picked[better], got[better], part[better]
        mixed = mixed[better]
    lone = chosen.sum(axis=1) == 1
    main = np.where(chosen, share, -1).argmax(axis=1)
    main[lone] = single[lone]
    odds = np.exp(one - one.max(axis=1, keepdims=True))
    trust = np.where(lone, 1 / odds.sum(axis=1), share[np.arange(len(there)), main])
    best[there], sure[there] = main, np.clip(trust, 0, 1)
    return best, sure


def _em(likely, doc, cut, words, allowed, steps):
    """Proportions per document after `steps` rounds, and the log-likelihood relative to the words' best."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        part = likely * share.astype(np.float32)[doc]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, cut, axis=0) / words[:, None]
        share = np.maximum(share, 1e-9) * allowed
        share /= share.sum(axis=1, keepdims=True)
    total = np.einsum("ij,ij->i", likely, share.astype(np.float32)[doc])
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)).astype(np.float64), cut)


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", carry=()
) -> DataFrame:
    """`id_col`, lang_pred and score for every row of `docs`; only the whole text decides.

    `lang_pred` is the language with the largest share in the chosen set, `score` that share, or with a single
    language its posterior probability. A text that is null or has no letter is `und` with score 0, as is
    everything when the model knows no language. Columns other than those named (and `carry`) are ignored.
    """
    langs, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # languages x 1 MB

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        for batch in batches:
            found, trust = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            for start, end, data, offsets in text_chunks(batch.column(0)) if langs else ():
                hashed, first, row = word_grams(data, offsets)
                if len(first):
                    scores = np.stack([np.add.reduceat(w[hashed], first) for w in shared.value], axis=1)
                    found[start:end], trust[start:end] = mixture(scores, row, end - start)
            found[~letters], trust[~letters] = -1, 0.0
            kept = [batch.column(c) for c in names_out]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names[found], pa.string()), pa.array(trust)], [*names_out, "lang_pred", "score"]
            )

    text = F.col(text_col).cast("string")
    others = {c: f"_keep_{i}" for i, c in enumerate(carry) if c not in (id_col, text_col)}
    inner = {**others, text_col: "_text"}
    slim = docs.select(
        text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col(id_col).alias("_id"),
        *[F.col(c).alias(n) for c, n in others.items()],
    )
    names_out = ["_id", *[inner[c] for c in carry if c != id_col]]
    schema = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names_out)
    out = slim.mapInArrow(tidy(predict), schema + ", lang_pred string, score double")
    return out.select(
        F.col("_id").alias(id_col), *[F.col(inner[c]).alias(c) for c in carry if c != id_col], "lang_pred", "score"
    )


def held_out(id_col: str, folds: int = 4):
    return F.crc32(F.col(id_col).cast("string")) % folds == 2


@query("op10_language")
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(F.coalesce(~held_out("doc_id"), F.lit(True))))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
