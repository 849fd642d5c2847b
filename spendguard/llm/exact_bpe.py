"""Encoding and decoding with a word-end BPE vocabulary by backtracking.

Merging by rank has one result for every string: the only sequence of tokens whose neighbours are all compatible,
that is, whose concatenation merges into just these two tokens. The encoder walks a word from the left, tries the
longest token that an Aho-Corasick automaton found at its place, and checks it against the token before; a failure
takes the next shorter token, and when there is none the token before is taken back and its place marked as a dead
end. A place is marked once, so the time is linear in the word. Decoding copies slices of one buffer that holds all
token strings, by a table of offsets.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard.llm.memory import slices, tidy
from spendguard.llm.registry import query, table

# Python splits at these four control characters; the vocabulary's splitter does not count them as white space.
_NOT_SPACE = re.compile(r"[\x1c-\x1f]")
_ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
_END = 256  # added to the last byte of a word


class CompatiblePairs(dict):
    """(left << 32 | right) → may the two tokens stand side by side; filled as pairs come up."""

    def __init__(self, halves: list[tuple[int, int]], merged: dict[int, int], limit: int = 2_000_000):
        super().__init__()
        self.halves, self.merged, self.limit = halves, merged, limit

    def __missing__(self, pair: int) -> bool:
        if len(self) >= self.limit:
            self.clear()
        fits = self[pair] = self.separate(pair >> 32, pair & 0xFFFFFFFF, sys.maxsize)
        return fits

    def separate(self, left: int, right: int, before: int) -> bool:
        """No merge of a rank below `before` crosses the border between two tokens.

        The merges of both tokens are undone from the latest one back; at each step, a merge of the two pieces
        that touch the border must not come before the merge undone last. Of equal ranks the left place is first.
        """
        while True:
            if self.merged.get(left << 32 | right, sys.maxsize) < before:
                return False
            (_, inner_left), (inner_right, _) = self.halves[left], self.halves[right]
            undo_left = inner_left != left and (left > right or inner_right == right)
            if undo_left:
                before, left = left, inner_left
            elif inner_right != right:
                before, right = right + 1, inner_right
            else:
                return True


class WordBpe:
    """A vocabulary whose ids ascend with the rank of their merge and whose words end in a marked byte."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        model, added = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        size = max([*vocab.values(), *added.values()]) + 1
        # One character per symbol: the byte, or the byte + 256 where the word ends.
        byte_of = {shown: b for b, shown in enumerate(_byte_characters())}
        self.strings = [""] * size
        for token, i in vocab.items():
            ended = token.endswith(mark) and token != mark
            body = [byte_of[c] for c in (token[: -len(mark)] if ended else token)]
            body[-1] += _END * ended
            self.strings[i] = "".join(map(chr, body))
        self.halves = [(i, i) for i in range(size)]
        self.merged: dict[int, int] = {}
        last = -1
        for merge in model["merges"]:
            left, right = (vocab[t] for t in (merge if isinstance(merge, list) else merge.split(" ")))
            token = vocab["".join(merge) if isinstance(merge, list) else merge.replace(" ", "")]
            if token <= last:
                raise ValueError("ids have to ascend with the rank of their merge")
            last = token
            self.halves[token] = left, right
            self.merged[left << 32 | right] = token
        self.pairs = CompatiblePairs(self.halves, self.merged)
        # Only tokens that merging really yields from their own string take part.
        real = [False] * size
        by_string = {}
        for i in sorted(vocab.values()):
            left, right = self.halves[i]
            real[i] = left == i or (real[left] and real[right] and self.pairs.separate(left, right, i))
            if real[i]:
                by_string[self.strings[i]] = i
        self.shorter = [-1] * size
        self.search = ahocorasick.Automaton()
        for string, i in by_string.items():
            self.search.add_word(string, i)
            self.shorter[i] = next((by_string[string[:n]] for n in range(len(string) - 1, 0, -1) if string[:n] in by_string), -1)
        self.search.make_automaton()
        self.sizes = [len(s) for s in self.strings]
        shown = {i: t for t, i in (vocab | added).items()}
        pieces = [(shown.get(i, "") + " ").encode() for i in range(size)]
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        symbols = word[:-1].decode("latin-1") + chr(word[-1] + _END)
        sizes, shorter, pairs = self.sizes, self.shorter, self.pairs
        longest = [-1] * len(symbols)
        for end, token in self.search.iter(symbols):  # ends ascend, so the longest at a place comes last
            longest[end + 1 - sizes[token]] = token
        dead = bytearray(len(symbols) + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < len(symbols):
            while token >= 0 and (dead[at + sizes[token]] or (ids and not pairs[ids[-1] << 32 | token])):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += sizes[token]
                token = longest[at] if at < len(symbols) else -1
            else:
                dead[at] = 1
                token = ids.pop()
                at -= sizes[token]
                token = shorter[token]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The token strings, joined by one space."""
        if not len(ids):
            return ""
        lengths = self.lengths[ids]
        starts = np.cumsum(lengths)
        places = np.repeat(self.offsets[ids] - (starts - lengths), lengths)
        places += np.arange(len(places))
        return self.buffer[places[:-1]].tobytes().decode()


def _byte_characters() -> list[str]:
    """The character that shows each byte: itself where it prints, else the next from U+0100 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printing]
    return [chr(b) if b in printing else chr(0x100 + hidden.index(b)) for b in range(256)]


class TextEncoder:
    """Whole texts to ids (little-endian unsigned 32-bit).

    The normaliser and the splitter are the tokenizer file's own, applied to each distinct stretch between white
    space; the ids of short stretches and of their words are kept in caches bounded by bytes.
    """

    def __init__(self, path: str, cache_bytes: int = 128_000_000):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.words = WordBpe(path)
        self.byte_of = {ord(shown): b for b, shown in enumerate(_byte_characters())}
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known = _Cache(self.encode_stretch, cache_bytes)
        self.known_words = _Cache(self.encode_word, cache_bytes // 2)

    def encode_word(self, word: str) -> bytes:
        return array("I", self.words.encode_word(word.translate(self.byte_of).encode("latin-1"))).tobytes()

    def encode_stretch(self, stretch: str) -> bytes:
        if stretch.isascii() and stretch.isalpha():  # a word of its own
            return self.known_words[stretch.lower()]
        ids = b""
        for i, part in enumerate(self.at_special.split(stretch) if self.at_special else [stretch]):
            if i % 2:
                ids += self.special[part].to_bytes(4, "little")
            elif part:
                ids += b"".join([self.known_words[word] for word, _ in self.split(self.normalise(part))])
        return ids

    def __call__(self, text: str) -> bytes:
        self.known.bound()
        self.known_words.bound()
        stretches = _ASCII_SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.known.__getitem__, stretches))


class _Cache(dict):
    """Ids of short strings; `bound` empties it when it takes more than about `limit` bytes."""

    def __init__(self, encode, limit: int, longest: int = 64):
        super().__init__()
        self.encode, self.limit, self.longest, self.size = encode, limit, longest, 0

    def __missing__(self, string: str) -> bytes:
        ids = self.encode(string)
        if len(string) <= self.longest:
            self[string] = ids
            self.size += 200 + 2 * len(string) + len(ids)
        return ids

    def bound(self) -> None:
        if self.size > self.limit:
            self.clear()
            self.size = 0


def _mapped(df: DataFrame, id_col: str, source, out: str, convert, max_bytes: int) -> DataFrame:
    """(id, converted values): one Arrow batch for each slice of the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = convert()
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), max_bytes):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *use(part)], names)
                at += len(part)

    slim = df.select(F.col(id_col).alias("_id"), source.alias("_in"))
    names = ["_id", *[part.split()[0] for part in out.split(", ")]]
    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(tidy(run), f"_id {kind}, {out}").withColumnRenamed("_id", id_col)


def encode_texts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 4_000_000
) -> DataFrame:
    """`id_col`, ids (binary, little-endian unsigned 32-bit) and n_tokens (long) of every row of `docs`.

    A null text counts as empty and has no ids; white space alone has none either. Special strings inside texts
    get their special id. Repeated rows are encoded each, a null id stays null, other columns are ignored whatever
    their names. Texts of any length are encoded whole.
    """

    def convert():
        encode = TextEncoder(tokenizer)

        def use(part: pa.Array) -> Iterable[pa.Array]:
            ids = pa.array(map(encode, part.to_pylist()), pa.binary())
            return ids, pa.array(pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4)

        return use

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return _mapped(docs, id_col, text, "ids binary, n_tokens long", convert, max_bytes)


def decode_ids(
    encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids", max_bytes: int = 4_000_000
) -> DataFrame:
    """`id_col`, text and ids of every row: the token strings of its ids, special ones included, joined by a space.

    No ids, or null, give an empty text. Repeated rows are decoded each; an id outside the vocabulary is an error.
    """

    def convert():
        words = WordBpe(tokenizer)

        def use(part: pa.Array) -> Iterable[pa.Array]:
            texts = (words.decode(np.frombuffer(ids, "<u4").astype(np.int64)) for ids in part.to_pylist())
            return pa.array(texts, pa.string()), part

        return use

    ids = F.coalesce(F.col(ids_col), F.lit(b""))
    return _mapped(encoded, id_col, ids, "text string, ids binary", convert, max_bytes)


@query("op12_exact_bpe")
def op12_exact_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
