"""Version keys and branch parameters: JSON objects held as canonical text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: dict) -> str:
    """Keys sorted, so that equal objects are equal text."""
    return json.dumps(value, sort_keys=True, default=str)


def as_map(text: Column) -> Column:
    """A flat JSON object as a map of texts."""
    return F.from_json(text, "map<string,string>")


def json_value(value) -> str:
    """A value's JSON text, as `typed` gives it."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def typed(text: Column) -> Column:
    """A JSON object as a map of its values' JSON texts, so that 1, "1", 1.0, true and nested values stay apart."""
    quoted = lambda _, plain, v: F.when(F.schema_of_variant(v) == "STRING", F.to_json(v)).otherwise(F.coalesce(plain, F.lit("null")))
    return F.map_zip_with(as_map(text), F.from_json(text, "map<string,variant>"), quoted)


def json_object(value: Column) -> Column:
    """A map of JSON texts as a JSON object with sorted keys: the way back from `typed`."""
    name = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    pairs = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(name(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def canonical_map(value: Column) -> Column:
    """A map as JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def without_keys(value: Column, *keys: str) -> Column:
    return F.map_filter(value, lambda k, _: ~k.isin(*keys))


def merged(old: Column, new: Column) -> Column:
    """Both maps in one; the new one wins."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))


def suffix_matches(value: Column, name: str) -> Column:
    """Entries named exactly `name`, or else all whose name ends in `.name`."""
    exact = F.map_filter(value, lambda k, _: k == name)
    suffixed = F.map_filter(value, lambda k, _: k.endswith("." + name))
    return F.when(F.size(exact) > 0, exact).otherwise(suffixed)


def is_subset(small: Column, large: Column) -> Column:
    """Whether every entry of `small` is in `large`."""
    return F.size(F.map_filter(small, lambda k, v: ~F.element_at(large, k).eqNullSafe(v))) == 0


def variant_label(value: Column) -> Column:
    """'k=v, …' in the order of the names without their prefixes."""
    pairs = F.transform(F.map_entries(value), lambda e: F.concat(F.regexp_extract(e["key"], r"([^.]*)$", 1), F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ", ")
