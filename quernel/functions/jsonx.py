"""Answers that hold JSON: boxes, points, tool calls and loosely fenced documents, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "array<struct<bbox_2d:array<double>,label:string>>"


def fenced(text: Column) -> Column:
    """The content of the first fence (an open one runs to the end), else the text from the first [ to the last ]."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*(?:```|$)", 1)
    bare = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.when(F.contains(text, F.lit("```")), inside).otherwise(bare)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is found once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def boxes(text: Column) -> Column:
    """Boxes of four numbers; an answer that is not a list, or has a broken element, has none at all."""

    def good(found: Column) -> Column:
        broken = F.exists(found, lambda b: b.isNull() | b["bbox_2d"].isNull() | F.exists(b["bbox_2d"], lambda x: x.isNull()))
        return F.when(found.isNull() | broken, F.array().cast(BOX)).otherwise(F.filter(found, lambda b: F.size(b["bbox_2d"]) == 4))

    return let(F.from_json(fenced(text), BOX), good)


def points(text: Column) -> Column:
    """Points with labels; one without a label is named by its place, from 1 on."""
    found = F.from_json(fenced(text), "array<struct<point_2d:array<double>,label:string>>")
    good = F.filter(F.coalesce(found, F.array().cast("array<struct<point_2d:array<double>,label:string>>")), lambda p: F.size(p["point_2d"]) == 2)
    return F.transform(good, lambda p, k: F.struct(p["point_2d"].alias("point"), F.coalesce(p["label"], F.concat(F.lit("point_"), (k + 1).cast("string"))).alias("label")))


def boxes_3d(text: Column) -> Column:
    """3-D boxes of nine numbers; one object counts as a list of one, anything else as none."""
    kind = "array<struct<bbox_3d:array<double>,label:string>>"
    body = F.when(F.contains(text, F.lit("```")), fenced(text)).when(F.trim(text).startswith("{"), F.trim(text)).otherwise(fenced(text))
    listed = F.when(F.trim(body).startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return F.filter(F.coalesce(F.from_json(listed, kind), F.array().cast(kind)), lambda b: F.size(b["bbox_3d"]) == 9)


def parsed_or_null(text: Column) -> Column:
    """Parsed JSON, null where a text is none. A text that does not begin as JSON does is not given to the parser, as each of its errors costs as much as many rows."""
    return F.when(text.rlike(r'^[ \t\r\n]*[\[{"0-9tfn-]'), F.try_parse_json(text))


def document(text: Column) -> Column:
    """A fenced or bare document: (json, error); where it does not parse, the raw text and true."""
    body = F.when(F.contains(text, F.lit("```")), fenced(text)).otherwise(F.trim(text))
    return let(parsed_or_null(body), lambda parsed: F.struct(F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(text).alias("json"), parsed.isNull().alias("error")))


def canonical(text: Column) -> Column:
    """Compact JSON with sorted keys if a text parses, else the text with blanks collapsed."""
    return F.coalesce(F.to_json(parsed_or_null(text)), F.trim(F.regexp_replace(text, r"\s+", " ")))


def tool_call(text: Column, schema: str) -> Column:
    return F.from_json(F.regexp_extract(text, r"(?s)<tool_call>\s*(.*?)\s*</tool_call>", 1), schema)


def whole_number_keys(values: Column) -> Column:
    """A map whose keys are numbers written as strings, by number."""
    return F.transform_keys(values, lambda k, v: k.cast("int"))
