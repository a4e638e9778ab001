"""From positioned text runs to lines, and from lines to headings, paragraphs and tables.

Tables are keyed (doc_id, page); a page is the largest group that a task takes whole.
Everything that is not an ordered walk over a page's items is a Column expression.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import text as T
from reportmill.operators.walk import walk_groups

ITEM_SCHEMA = "doc_id string, page int, item_ix int, str string, transform array<double>, width double, height double, font_name string"
LINE_SCHEMA = "doc_id string, page int, line_ix int, y double, font_size double, cells array<struct<text:string,x:double,width:double>>, text string"
BLOCK_SCHEMA = "doc_id string, page int, block_ix int, kind string, level int, text string, rows array<array<string>>"

CELL_GAP, LINE_TOLERANCE, SAME_BASELINE = 1.2, 0.5, 0.01
EDGE_BAND, LEAST_EXTENT = 0.15, 100.0
HEADING_RATIO, LEVEL_1, LEVEL_2, HEADING_CHARS = 1.12, 1.6, 1.25, 70
COLUMN_TOLERANCE, LEAST_COLUMN_TOLERANCE = 1.5, 4.0
SCANNED_CHARS, LEAST_CONFIDENCE = 12, 35.0


def _at(c: Column, i: int) -> Column:
    return F.coalesce(F.try_element_at(c, F.lit(i)), F.lit(0.0))


def font_size(transform: Column, height: Column) -> Column:
    size = F.hypot(_at(transform, 2), _at(transform, 4))
    return F.when(size > 0, size).otherwise(height)


def valid_items(raw: DataFrame, column: str = "json") -> DataFrame:
    """Items from JSON text: those with a string, a transform array and numeric sizes."""
    schema = "str string, transform array<double>, width double, height double, fontName string"
    parsed = raw.withColumn("item", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    whole = [F.col(f"item.{c}").isNotNull() for c in ("str", "transform", "width", "height")]
    ok = whole[0] & whole[1] & whole[2] & whole[3]
    rest = [c for c in raw.columns if c != column]
    return parsed.filter(ok).select(*rest, "item.str", "item.transform", "item.width", "item.height", F.col("item.fontName").alias("font_name"))


def scanned_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page) of all ``pages`` whose items hold hardly any characters."""
    solid = F.length(F.regexp_replace("str", T.WS, ""))
    counts = items.groupBy("doc_id", "page").agg(F.sum(solid).alias("chars"))
    return pages.join(counts, ["doc_id", "page"], "left").filter(F.coalesce("chars", F.lit(0)) < SCANNED_CHARS).select("doc_id", "page")


def ocr_items(words: DataFrame) -> DataFrame:
    """Recognised words as text items: pixels to points, y upwards, doubtful words dropped."""
    height = (F.col("line_bbox.y1") - F.col("line_bbox.y0")) / F.col("scale")
    base = F.col("page_height") - F.col("line_bbox.y1") / F.col("scale")
    kept = words.withColumn("h", height).withColumn("t", T.trim_ws(F.col("text")))
    kept = kept.filter((F.col("h") > 0) & (F.col("t") != "") & (F.col("confidence") >= LEAST_CONFIDENCE))
    order = Window.partitionBy("doc_id", "page").orderBy("line_ix", "word_ix")
    zero = F.lit(0.0)
    return kept.select(
        "doc_id",
        "page",
        (F.row_number().over(order) - 1).alias("item_ix"),
        F.col("t").alias("str"),
        F.array("h", zero, zero, "h", F.col("word_bbox.x0") / F.col("scale"), base).alias("transform"),
        ((F.col("word_bbox.x1") - F.col("word_bbox.x0")) / F.col("scale")).alias("width"),
        F.col("h").alias("height"),
        F.lit(None).cast("string").alias("font_name"),
    )


def overlay(items: DataFrame, recognised: DataFrame) -> DataFrame:
    """Recognised pages replace the original ones as a whole."""
    pages = recognised.select("doc_id", "page").distinct()
    return items.join(pages, ["doc_id", "page"], "left_anti").unionByName(recognised)


def split_cells(text: Column, x: Column, width: Column) -> Column:
    """Cells of one item: parts between three or more blanks, at estimated places."""
    per_char = F.when(F.length(text) > 0, width / F.length(text)).otherwise(0.0)
    wide = f"{T.WS}{{3,}}"
    lead_of = lambda t: F.length(t) - F.length(F.regexp_replace(t, f"^{T.WS}+", ""))
    cell = lambda body, at: F.struct(body.alias("text"), (x + at * per_char).alias("x"), (F.length(body) * per_char).alias("width"))
    parts = F.split(text, f"(?<={T.WS}{{3}})(?!{T.WS})|(?<!{T.WS})(?={wide})", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,x:double,width:double>>").alias("cells"))

    def add(a: Column, piece: Column) -> Column:
        more = T.let(T.trim_ws(piece), lambda body: F.when(body == "", a["cells"]).otherwise(F.array_append(a["cells"], cell(body, a["at"] + lead_of(piece)))))
        return F.struct((a["at"] + F.length(piece)).alias("at"), more.alias("cells"))

    split = F.aggregate(parts, start, add, lambda a: a["cells"])
    whole = F.array(F.struct(T.trim_ws(text).alias("text"), x.alias("x"), width.alias("width")))
    one = T.let(T.trim_ws(text), lambda body: F.array(cell(body, lead_of(text))))
    cells = F.when(text.rlike(wide), split).otherwise(one)
    return F.when(T.trim_ws(text) == "", whole).otherwise(cells)


def _page_lines(rows: list[dict]) -> list[dict]:
    """Walk a page's items downwards; a line keeps the baseline of its first item."""

    def by_place(a: dict, b: dict) -> float:
        down = b["y"] - a["y"]
        return down if abs(down) > SAME_BASELINE else a["x"] - b["x"]

    groups: list[list[dict]] = []
    for item in sorted(rows, key=cmp_to_key(by_place)):
        near = max(1.0, LINE_TOLERANCE * item["size"])
        if groups and abs(item["y"] - groups[-1][0]["y"]) <= near:
            groups[-1].append(item)
        else:
            groups.append([item])
    return [_line(group) | {"line_ix": ix} for ix, group in enumerate(groups)]


def _line(group: list[dict]) -> dict:
    """Items of one line from left to right; near cells are joined."""
    if len(group) == 1 and len(group[0]["cells"]) == 1:
        item = group[0]
        return {"y": item["y"], "font_size": item["size"], "cells": item["cells"], "text": item["cells"][0]["text"]}
    size = max(i["size"] for i in group)
    cells: list[dict] = []
    for item in sorted(group, key=lambda i: i["x"]):
        for part in item["cells"]:
            end = cells[-1]["x"] + cells[-1]["width"] if cells else None
            if cells and part["x"] - end <= CELL_GAP * size:
                joint = " ".join(f"{cells[-1]['text']} {part['text']}".split())
                cells[-1] |= {"text": joint, "width": part["x"] + part["width"] - cells[-1]["x"]}
            else:
                cells.append(dict(part))
    y = sum(i["y"] for i in group) / len(group)
    return {"y": y, "font_size": size, "cells": cells, "text": "  ".join(c["text"] for c in cells)}


def lines(items: DataFrame) -> DataFrame:
    """Visual lines of each page, from top to bottom, with their cells from left to right."""
    solid = items.filter(T.trim_ws(F.col("str")) != "")
    x, y = _at(F.col("transform"), 5), _at(F.col("transform"), 6)
    ready = solid.select("doc_id", "page", "item_ix", x.alias("x"), y.alias("y"), font_size(F.col("transform"), F.col("height")).alias("size"), split_cells(F.col("str"), x, F.col("width")).alias("cells"))
    return walk_groups(ready, ["doc_id", "page"], ["item_ix"], _page_lines, LINE_SCHEMA)


def strip_furniture(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines without running headers and footers.

    A line in the top or bottom band of its page goes if its blurred text stands in such a
    band on half of the document's pages, two at least; ``pages`` (doc_id, page) also has
    those without lines.
    """
    on_page = Window.partitionBy("doc_id", "page")
    top, bottom = F.max("y").over(on_page), F.min("y").over(on_page)
    band = (top - bottom) * EDGE_BAND
    at_edge = (top - bottom >= LEAST_EXTENT) & ((F.col("y") >= top - band) | (F.col("y") <= bottom + band))
    keyed = found.withColumn("_key", T.furniture_key(F.col("text"))).withColumn("_edge", at_edge & (F.col("_key") != ""))
    n = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("_n")).filter("_n >= 2")
    often = keyed.filter("_edge").groupBy("doc_id", "_key").agg(F.countDistinct("page").alias("_pages"))
    running = often.join(n, "doc_id").filter(F.col("_pages") >= F.greatest(F.lit(2), F.ceil(F.col("_n") / 2))).select("doc_id", "_key", F.lit(True).alias("_edge"))
    return keyed.join(running, ["doc_id", "_key", "_edge"], "left_anti").select(*found.columns)


def half_points(size: Column) -> Column:
    return F.floor(size * 2 + 0.5) / 2


def body_sizes(found: DataFrame) -> DataFrame:
    """(doc_id, page, body): the most frequent font size to half a point, ties to the smaller."""
    counts = found.groupBy("doc_id", "page", half_points(F.col("font_size")).alias("body")).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("doc_id", "page").orderBy(F.desc("n"), "body")
    return counts.withColumn("r", F.row_number().over(best)).filter("r = 1").select("doc_id", "page", "body")


def is_heading(text: Column, cells: Column, size: Column, body: Column) -> Column:
    bare = T.trim_ws(text)
    letters = F.regexp_replace(bare, r"\([^)]*\)", "")
    capitals = letters.rlike("[A-Z]") & (letters == F.upper(letters))
    fits = (F.size(cells) <= 1) & F.length(bare).between(1, HEADING_CHARS)
    return fits & ((size >= HEADING_RATIO * body) | capitals)


def heading_level(size: Column, body: Column) -> Column:
    ratio = size / F.nullif(body, F.lit(0.0))
    return F.when(body <= 0, 2).when(ratio >= LEVEL_1, 1).when(ratio >= LEVEL_2, 2).otherwise(3)


def aligned(first: list, size: float, cells: list) -> bool:
    """Whether a line's cells stand below those of a table's first line."""
    if len(cells) < 2:
        return False
    near = max(LEAST_COLUMN_TOLERANCE, COLUMN_TOLERANCE * size)
    hits = sum(any(abs(a["x"] - c["x"]) <= near for a in first) for c in cells)
    return hits >= max(2, min(len(first), len(cells)) - 1)


def _page_blocks(rows: list[dict]) -> list[dict]:
    """Headings, then tables, then paragraphs up to the next of either.

    A table starts where the next line shares a line's columns; how far it goes is walked once,
    from the line that it starts at.
    """
    n = len(rows)

    def below(i: int, j: int) -> bool:
        return j < n and aligned(rows[i]["cells"], rows[i]["font_size"], rows[j]["cells"])

    starts = [len(r["cells"]) >= 2 and below(i, i + 1) for i, r in enumerate(rows)]
    out, i = [], 0
    while i < n:
        j = i + 1
        if rows[i]["heading"]:
            out.append(("heading", rows[i]["level"], rows[i]["text"].strip(), None, 1))
        elif starts[i]:
            while below(i, j):
                j += 1
            cells = [[c["text"] for c in r["cells"]] for r in rows[i:j]]
            out.append(("table", None, "\n".join(" | ".join(r) for r in cells), cells, j - i))
        else:
            while j < n and not rows[j]["heading"] and not starts[j]:
                j += 1
            out.append(("paragraph", None, " ".join(r["text"].strip() for r in rows[i:j]), None, j - i))
        i = j
    names = ("kind", "level", "text", "rows", "n_lines")
    return [dict(zip(names, block, strict=True)) | {"block_ix": ix} for ix, block in enumerate(out)]


def _judged_blocks(rows: list[dict]) -> list[dict]:
    """Blocks of a page's lines by its most frequent font size, as :func:`body_sizes`, :func:`is_heading` and :func:`heading_level` have it."""
    counts = Counter(math.floor(r["font_size"] * 2 + 0.5) / 2 for r in rows)
    body = min(counts, key=lambda size: (-counts[size], size))
    for r in rows:
        r["heading"] = r["short"] and (r["font_size"] >= HEADING_RATIO * body or r["capitals"])
        ratio = r["font_size"] / body if body > 0 else LEVEL_2
        r["level"] = 1 if ratio >= LEVEL_1 else 2 if ratio >= LEVEL_2 else 3
    return _page_blocks(rows)


def blocks(found: DataFrame, n_lines: bool = False) -> DataFrame:
    """Typed blocks of each page: heading (with level), paragraph, or table (with rows); with ``n_lines``, how many lines each took.

    A page's lines are dealt and read once; its body size is counted where they lie.
    """
    never = F.lit(1e300)  # a body size that no line is large against
    ready = found.withColumn("short", is_heading(F.col("text"), F.col("cells"), F.lit(1.0), F.lit(0.0)))
    ready = ready.withColumn("capitals", is_heading(F.col("text"), F.col("cells"), F.lit(0.0), never))
    return walk_groups(ready, ["doc_id", "page"], ["line_ix"], _judged_blocks, BLOCK_SCHEMA + (", n_lines bigint" if n_lines else ""))


def extract(items: DataFrame, pages: DataFrame) -> DataFrame:
    return blocks(strip_furniture(lines(items), pages))


def section_count(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.count_if(F.col("kind") == "heading").alias("sections"))
