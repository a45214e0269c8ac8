"""Column helpers: built-in expressions only, usable on batch and streaming frames."""

from weftline.functions.numbers import (
    count_threshold,
    money_threshold,
    ratio6,
    support_package,
)
from weftline.functions.text import (
    boundary_tokens,
    fold_case,
    is_canonical_id,
    is_country_code,
    is_product_id,
    is_semantic_version,
    iso_date,
    local_name,
    looks_like_sql,
    mask_credentials,
    normalize_term,
    plural_variants,
    redact,
    row_digest,
    strip,
    text_lines,
)

__all__ = [
    "boundary_tokens",
    "count_threshold",
    "fold_case",
    "is_canonical_id",
    "is_country_code",
    "is_product_id",
    "is_semantic_version",
    "iso_date",
    "local_name",
    "looks_like_sql",
    "mask_credentials",
    "money_threshold",
    "normalize_term",
    "plural_variants",
    "ratio6",
    "redact",
    "row_digest",
    "strip",
    "support_package",
    "text_lines",
]
