"""Cached batch encoding with a byte-level BPE vocabulary.

A text is cut at safe boundaries: single spaces between two non-space characters. The vocabulary's splitter
starts a new piece at such a space whatever surrounds it, so the ids of a text are the ids of its segments one
after the other (tested against whole-text encoding). Segments repeat a lot; each distinct one is encoded once
by the tokenizer library and kept in a cache of bounded size.
"""

from __future__ import annotations

import os
import re
from array import array

# A space that touches other white space may belong to a longer white-space piece.
_UNSAFE = re.compile(r"\s | \s|^ | $")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


# Latin letters, punctuation and white space: the splitter of the rank file and the tokenizer's agree on these.
_PLAIN = re.compile(r"[\x00-\u024f\u2010-\u2027\u2030-\u205e]*")


# White space that is neither a space nor a line feed.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _segments(text: str) -> list[str]:
    if not _OTHER_SPACE.search(text):  # most texts: plain searches for what touches a space
        if not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "):
            return text.split(" ")
    return _SAFE_SPACE.split(text) if _UNSAFE.search(text) else text.split(" ")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Cache(dict):
    """What is known of segments; `bound` empties it when it takes more than about `limit` bytes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size = limit, 0

    def bound(self) -> None:
        if self.size > self.limit:
            self.clear()
            self.size = 0


class SegmentLengths:
    """Numbers of token ids, by the tokenizer library alone; unseen segments are encoded in batches."""

    def __init__(self, path: str, cache_bytes: int = 128_000_000):
        self.tokenizer = _tokenizer(path)
        self.first, self.later = _Cache(cache_bytes // 2), _Cache(cache_bytes)

    def _learn(self, cache: _Cache, keys: set, prefix: str) -> None:
        cache.bound()
        new = list(keys.difference(cache))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([prefix + key for key in part], add_special_tokens=False)
            cache.update(zip(part, map(len, found)))
            cache.size += sum(map(len, part)) + 150 * len(part)

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [_segments(t) for t in texts]
        self._learn(self.first, {s[0] for s in cut}, "")
        keys: set[str] = set()
        for s in cut:
            keys.update(s[1:])
        self._learn(self.later, keys, " ")
        later = self.later.__getitem__
        return [self.first[s[0]] + sum(map(later, s[1:])) for s in cut]


class _Ids(_Cache):
    def __init__(self, encode, prefix: str, limit: int):
        super().__init__(limit)
        self.encode, self.prefix = encode, prefix

    def __missing__(self, key: str) -> bytes:
        ids = self[key] = self.encode(self.prefix + key)
        self.size += 200 + len(key) + len(ids)
        return ids


class _Encoder:
    """Ids of one segment. Plain segments are encoded with the rank file of the same vocabulary, five times as fast as
    the tokenizer library on short strings; segments with other characters or special strings by the library itself.
    """

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.tokenizer = _tokenizer(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )

    def __call__(self, segment: str) -> bytes:
        if _PLAIN.fullmatch(segment) and not any(s in segment for s in self.special):
            ids = self.fast.encode_ordinary(segment)
        else:
            ids = self.tokenizer.encode(segment, add_special_tokens=False).ids
        return array("I", ids).tobytes()


class SegmentIds:
    """Token ids as little-endian unsigned 32-bit bytes. Caches know the encoder, not this object: without a cycle of
    references they are freed at the end of a task.
    """

    def __init__(self, path: str, ranks: str, cache_bytes: int = 96_000_000):
        self.encode = _Encoder(path, ranks)
        self.first = _Ids(self.encode, "", cache_bytes // 4)
        self.later = _Ids(self.encode, " ", cache_bytes)

    def __call__(self, text: str) -> bytes:
        cut = _segments(text)
        if len(cut) == 1:  # long texts without spaces are not worth keeping
            return self.encode(text)
        self.later.bound()
        self.first.bound()
        return self.first[cut[0]] + b"".join(map(self.later.__getitem__, cut[1:]))
