from holdfast.functions.cleaning import (
    assign_value,
    blank,
    clean_numeric,
    finite,
    map_category,
    sanitise,
    strip_whitespace,
    to_boolean,
    to_number,
)
from holdfast.functions.hashing import key_hash, percent_bucket

__all__ = [
    "assign_value",
    "blank",
    "clean_numeric",
    "finite",
    "key_hash",
    "map_category",
    "percent_bucket",
    "sanitise",
    "strip_whitespace",
    "to_boolean",
    "to_number",
]
