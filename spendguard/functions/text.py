"""Text and number formats as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a canonical decomposition and their ASCII spelling.
_SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
_SINGLE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i"}

# Text that pandas reads as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)

DECIMAL_BR = r"^[+-]?[0-9.]*(,[0-9]*)?([eE][+-]?[0-9]+)?$"


def _latin_table() -> tuple[str, str]:
    """Accented Latin letters (U+00A0–U+024F, U+1E00–U+1EFF) and their single ASCII base letter."""
    pairs = dict(_SINGLE)
    for code in (*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(code))
        base = "".join(ch for ch in base if not unicodedata.combining(ch))
        if len(base) == 1 and base.isascii():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _PLAIN = _latin_table()


def fold_ascii(c: Column) -> Column:
    """Replace accented Latin letters by their ASCII base letters and drop combining marks."""
    folded = F.translate(F.regexp_replace(c, "\\p{M}+", ""), _ACCENTED, _PLAIN)
    for letter, spelling in _SPELLED.items():
        folded = F.replace(folded, F.lit(letter), F.lit(spelling))
    return folded


def category_key(c: Column) -> Column:
    """File-safe category name: ASCII, upper case, space and slash become an underscore."""
    return F.translate(F.upper(fold_ascii(c)), " /", "__")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def null_token(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Trim, and turn the listed tokens into null."""
    trimmed = strip(c)
    return F.when(~trimmed.isin(*tokens), trimmed)


def parse_decimal_br(c: Column) -> Column:
    """`1.234,56` → 1234.56; anything that is not a plain number gives null."""
    text = strip(c)
    plain = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(text.rlike(DECIMAL_BR), plain.try_cast("double"))


def parse_timestamp(c: Column, formats: Sequence[str]) -> Column:
    """First format that fits; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def format_brl(c: Column, missing: str = "R$ —") -> Column:
    """1234.56 → `R$ 1.234,56`."""
    digits = F.translate(F.format_number(c, 2), ",.", ".,")
    return F.coalesce(F.concat(F.lit("R$ "), digits), F.lit(missing))
