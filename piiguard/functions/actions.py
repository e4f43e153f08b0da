"""Columns over agent actions: selectors, raw JSON shape, disabled targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
ACTION_TYPES = ("click", "fill", "scroll", "focus", "select")
ACTION_KEYS = ("action", "target", "parameters", "reasoning_id", "value_ref")
REQUIRED_KEYS = ("action", "target", "reasoning_id")


def selector_key(selector: Column) -> Column:
    """What a selector asks for, in the words of :func:`element_keys`; null for none of the known forms.

    Known forms are #id, [attribute], [attribute="value"] (an empty value asks for none) and a bare tag name.
    """
    attribute = r'\[([^=]+)(?:="([^"]*)")?\]'
    name, value = F.regexp_extract(selector, attribute, 1), F.regexp_extract(selector, attribute, 2)
    bracketed = F.when(name != "", F.concat(F.lit("["), name, F.when(value != "", F.concat(F.lit("="), value)).otherwise(F.lit(""))))
    tag = F.concat(F.lit("<"), selector)
    return F.when(selector.startswith("#"), selector).when(selector.startswith("[") & selector.endswith("]"), bracketed).otherwise(tag)


def element_keys(tag: Column, attributes: Column) -> Column:
    """Every key by which a selector can reach an element; an empty attribute gives none."""
    entries = F.filter(F.map_entries(attributes), lambda e: e["value"] != "")
    has = F.transform(entries, lambda e: F.concat(F.lit("["), e["key"]))
    valued = F.transform(entries, lambda e: F.concat(F.lit("["), e["key"], F.lit("="), e["value"]))
    own_id = F.transform(F.filter(entries, lambda e: e["key"] == "id"), lambda e: F.concat(F.lit("#"), e["value"]))
    return F.concat(F.array(F.concat(F.lit("<"), F.lower(tag))), own_id, has, valued)


def members(raw: Column) -> Column:
    """The members of a raw JSON action by name; null of what is no JSON object. To be held in a column, as it parses."""
    return F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>")


def parts(m: Column) -> list[Column]:
    """Columns of an action's :func:`members`: ``formed``, ``unknown`` (keys that no action has), and the strings of its fields.

    ``formed`` holds where all required keys are there, as strings, optional ones are of their kinds, and there is no other key.
    """
    kind = lambda k: F.schema_of_variant(F.try_element_at(m, F.lit(k)))
    unknown = F.array_except(F.map_keys(m), F.array(*map(F.lit, ACTION_KEYS)))
    shaped = F.size(unknown) == 0
    for key in REQUIRED_KEYS:
        shaped = shaped & F.coalesce(kind(key) == "STRING", F.lit(False))
    parameters, value_ref = kind("parameters"), kind("value_ref")
    shaped = shaped & (parameters.isNull() | parameters.startswith("OBJECT") | parameters.startswith("ARRAY"))
    formed = F.coalesce(shaped & (value_ref.isNull() | (value_ref == "STRING")), F.lit(False))
    texts = [F.try_variant_get(F.try_element_at(m, F.lit(k)), "$", "string").alias(k) for k in ("action", "target", "reasoning_id", "value_ref")]
    return [formed.alias("formed"), unknown.alias("unknown"), *texts]


def parsed(actions: DataFrame) -> DataFrame:
    """``actions`` with the columns of :func:`parts` in place of ``raw``, which is parsed once a row."""
    rest = [c for c in actions.columns if c != "raw"]
    return actions.select(*rest, members(F.col("raw")).alias("_members")).select(*rest, *parts(F.col("_members")))


def disabled(off: Column, readonly: Column, aria: Column) -> Column:
    """True where an element is disabled, read only, or announced as disabled."""
    set_ = lambda c: F.coalesce(c.isin("true", ""), F.lit(False))
    return set_(off) | set_(readonly) | F.coalesce(aria == "true", F.lit(False))
