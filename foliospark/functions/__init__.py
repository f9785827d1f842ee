"""Column functions; every one of them is a plain Spark expression."""

from foliospark.functions.json_columns import (
    doubles_to_json,
    ints_to_json,
    json_to_doubles,
    json_to_ints,
    parse_json,
    parse_json_checked,
    parse_variant,
    to_json_rooted,
    to_json_sorted,
    variant_field,
)

__all__ = [
    "doubles_to_json",
    "ints_to_json",
    "json_to_doubles",
    "json_to_ints",
    "parse_json",
    "parse_json_checked",
    "parse_variant",
    "to_json_rooted",
    "to_json_sorted",
    "variant_field",
]
