from spendguard.functions.hashing import hash_bucket, one_hot, portable_unit, unit_hash
from spendguard.functions.scores import audit_score
from spendguard.functions.text import (
    category_key,
    fold_ascii,
    format_brl,
    null_token,
    parse_decimal_br,
    parse_timestamp,
)

__all__ = [
    "audit_score",
    "category_key",
    "fold_ascii",
    "format_brl",
    "hash_bucket",
    "null_token",
    "one_hot",
    "parse_decimal_br",
    "parse_timestamp",
    "portable_unit",
    "unit_hash",
]
