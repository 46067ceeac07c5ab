"""Parsers for model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class number pattern and the class of a text without one.
DEWEY_PATTERN = r"\d{3}(?:\.\d+)?"
DEFAULT_DEWEY = "000.00"
ENTITY_TYPE = "array<struct<name:string,type:string>>"


def dewey(text: Column) -> Column:
    found = F.regexp_extract(text, f"({DEWEY_PATTERN})", 1)
    return F.when(found == "", DEFAULT_DEWEY).otherwise(F.coalesce(found, F.lit(DEFAULT_DEWEY)))


def comma_list(text: Column) -> Column:
    trimmed = F.transform(F.split(text, ","), lambda t: F.trim(t))
    return F.filter(trimmed, lambda t: t != "")


def category_confidence(text: Column) -> Column:
    """``category:confidence``; anything else gives (NULL, 0.0)."""
    parts = F.split(F.trim(text), ":")
    number = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    ok = (F.size(parts) == 2) & number.isNotNull()
    return F.struct(F.when(ok, F.trim(parts[0])).alias("category"),
                    F.when(ok, number).otherwise(F.lit(0.0)).alias("confidence"))


def entities(text: Column) -> Column:
    """Entities of the first JSON array in the text; broken or absent JSON gives an empty list."""
    found = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(F.when(found != "", found), ENTITY_TYPE, {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array().cast(ENTITY_TYPE))


def stream_piece(line: Column) -> Column:
    """Text carried by one ``data:`` line of a streamed response; NULL for the end marker."""
    body = F.regexp_replace(line, r"^data:\s*", "")
    return F.when(body != "[DONE]", F.get_json_object(body, "$.choices[0].delta.content"))
