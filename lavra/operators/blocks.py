"""From the lines of pages to blocks and Markdown: joints between lines, tables, headings, lists, paragraphs.

lines: doc_id, page, line, plain, x, y, width, size, edge; of these may be missing (or null) bold_ratio, leader, urls,
cells and splits. Everything is told by flags of a line and of the line before, by windows over a page, and, for
tables, by one fold over those rows of a page that have cells, since a table's grid is its first row's. All
of it follows one shuffle by page. A page is what one sheet holds: text without pages is to be cut into pages first.

Defined results: a null plain is an empty line; null coordinates make a break; lines of equal number in a page come in
any order among themselves; rows without doc_id or page are in no table; paragraphs of blanks are no blocks; empty
tables give empty results; other columns are left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

from lavra.functions.text import trim
from lavra.operators.layout import HYPHEN, LINE_KEY, dehyphenate, escape_cell, escape_inline, heading_level, is_field, is_leader, is_rubric, legal_unit, list_item

# Measures of the rules, in sizes of the letters where not said otherwise.
FAR_GAP, OTHER_SIZE, HYPHEN_GAP, LOWER_GAP, SENTENCE_GAP, JOINED_GAP = 1.85, 0.22, 1.75, 1.55, 1.25, 1.7
SHORT_OF_EDGE, LEAST_SHORT, LEAST_HYPHENED = 2.8, 36.0, 20
GRID, TABLE_SIZE, TABLE_GAP, LEAST_ROWS = 16, 0.28, 1.9, 3
NO_TEXT_SIZE = 12.0
ENDED = r"[.!?…][\"')\]]*\z"

_OPTIONAL = {"bold_ratio": "double", "leader": "boolean", "urls": "array<string>", "cells": "array<string>", "splits": "array<double>"}


def _order() -> WindowSpec:
    return Window.partitionBy(*LINE_KEY).orderBy("line")


def _flagged(lines: DataFrame) -> DataFrame:
    """lines with the missing columns and what the rules ask of one line."""
    given = [F.col(c) for c in (*LINE_KEY, "line", "x", "y", "width", "size", "edge")] + [F.coalesce("plain", F.lit("")).alias("plain")]
    given += [(F.col(c) if c in lines.columns else F.lit(None)).cast(t).alias(c) for c, t in _OPTIONAL.items()]
    t = F.col("plain")
    own = lines.select(*given).withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))
    return own.withColumns({
        "field": is_field(t), "rubric": is_rubric(t), "led": F.coalesce("leader", F.lit(False)) | is_leader(t), "item": list_item(t), "unit": legal_unit(t),
        "lower": t.rlike(r"^\p{Ll}"), "hyphened": t.rlike(f"{HYPHEN}\\z"), "ended": t.rlike(ENDED),
    })


def _joints(flagged: DataFrame, hyphens: bool) -> DataFrame:
    was = lambda c: F.lag(c).over(_order())
    own = flagged.withColumns({f"p_{c}": was(c) for c in ("plain", "x", "y", "width", "size", "edge", "field", "rubric", "led", "hyphened", "ended")})
    t, gap, size = F.col("plain"), F.col("y") - F.col("p_y"), F.greatest("p_size", "size", F.lit(1.0))
    word = F.lit(hyphens) & F.col("p_hyphened") & dehyphenate(F.col("p_plain"), t) & F.col("lower") & (F.length("p_plain") >= LEAST_HYPHENED) & (gap < size * HYPHEN_GAP)
    full = F.col("p_x") + F.col("p_width") >= F.col("p_edge") - F.greatest(F.lit(LEAST_SHORT), F.col("p_size") * SHORT_OF_EDGE)
    breaks = [
        gap > size * FAR_GAP, F.abs(F.col("p_size") - F.col("size")) > size * OTHER_SIZE, F.col("unit"), F.col("field"), F.col("p_field") & ~F.col("lower"),
        F.col("p_rubric") | F.col("rubric"), F.col("p_led") | F.col("led"), F.col("item").isNotNull(),
    ]
    joint = F.when(F.col("p_plain").isNull() | gap.isNull(), "break")
    for b in breaks:
        joint = joint.when(b, "break")
    joint = joint.when(word, "hyphen").when(t.rlike("^[\\p{Ll}(“\"]") & (gap < size * LOWER_GAP), "space").when(~F.coalesce(full, F.lit(False)), "break")
    joint = joint.when(F.col("p_ended") & t.rlike("^[\\p{Lu}\\d“\"]") & (gap > size * SENTENCE_GAP), "break").when(gap < size * JOINED_GAP, "space").otherwise("break")
    return own.withColumn("joint", joint)


def joints(lines: DataFrame, hyphens: bool = True) -> DataFrame:
    """doc_id, page, line, joint: what stands between a line and the one before it: hyphen (a word goes on), space
    or break. The first rule that fits decides, and without one it is a break."""
    return _joints(_flagged(lines), hyphens).select(*LINE_KEY, "line", "joint")


def _fits(first: Column, row: Column, y_before: Column) -> Column:
    """Whether a row goes on a table that begins with `first`."""
    grid = (F.size(first["splits"]) == F.size(row["splits"])) & F.forall(F.arrays_zip(first["splits"].alias("a"), row["splits"].alias("b")), lambda z: F.abs(z["a"] - z["b"]) <= GRID)
    size = F.abs(row["size"] - first["size"]) <= first["size"] * TABLE_SIZE
    return row["free"] & (row["n"] == first["n"]) & (F.size(first["splits"]) >= 2) & grid & size & (row["y"] - y_before <= row["size"] * TABLE_GAP)


def _runs(flagged: DataFrame) -> DataFrame:
    """flagged lines with `at` (place in the page, from 1) and `run`, the place of the first row of their table or null."""
    order = _order()
    free = ~(F.col("field") | F.col("rubric") | F.col("item").isNotNull())
    row = F.struct("at", "y", "size", F.col("splits"), F.size("cells").alias("n"), free.alias("free"))
    placed = flagged.withColumn("at", F.row_number().over(order)).withColumn("row", F.when(F.col("cells").isNotNull() & F.col("splits").isNotNull(), row))
    placed = placed.withColumns({"row1": F.lead("row", 1).over(order), "row2": F.lead("row", 2).over(order)})
    opens = ~is_field(F.replace("plain", F.lit(" · "), F.lit(" "))) & ~F.exists("cells", lambda c: trim(c).rlike("^[:·]")) & (F.size("cells") >= 2) & (F.size("splits") >= 2) & free
    three = _fits(F.col("row"), F.col("row1"), F.col("y")) & _fits(F.col("row"), F.col("row2"), F.col("row1.y"))
    some = placed.filter("row is not null").select(*LINE_KEY, F.struct("row.*", F.coalesce(opens & three, F.lit(False)).alias("opens")).alias("r"))
    pages = some.groupBy(*LINE_KEY).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    kind = some.schema["r"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("first"), F.lit(None).cast(kind).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        on = F.coalesce((r["at"] == acc["last"]["at"] + 1) & _fits(acc["first"], r, acc["last"]["y"]), F.lit(False))
        first = F.when(on, acc["first"]).when(r["opens"], r)
        return F.struct(first.alias("first"), r.alias("last"), F.concat(acc["out"], F.array(first["at"])).alias("out"))

    runs = pages.select(*LINE_KEY, F.map_from_arrays(F.transform("rs", lambda r: r["at"]), F.aggregate("rs", start, step, lambda a: a["out"])).alias("runs"))
    return placed.join(runs, LINE_KEY, "left").withColumn("run", F.element_at("runs", F.col("at"))).drop("row", "row1", "row2", "runs")


def table_runs(lines: DataFrame) -> DataFrame:
    """doc_id, page, line, run of the lines that are rows of a table; run is the line of its first row.

    Three rows or more in sequence, each with as many cells as the first, splits within 16 of the first row's, a size
    within 28 % of the first's, and no further than 1.9 sizes below the row before. A row that could not begin
    three leaves the next one to begin."""
    found = _runs(_flagged(lines)).filter("run is not null")
    return found.withColumn("run", F.first("line").over(Window.partitionBy(*LINE_KEY, "run").orderBy("at"))).select(*LINE_KEY, "line", "run")


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, page, body: the size at which half of the characters of a page are reached; 12 without any."""
    n = F.length("plain").cast("bigint")
    sums = lines.groupBy(*LINE_KEY, "size").agg(F.sum(F.coalesce(n, F.lit(0))).alias("n"))
    up = Window.partitionBy(*LINE_KEY).orderBy("size")
    run = sums.withColumns({"run": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy(*LINE_KEY))})
    return run.groupBy(*LINE_KEY).agg(F.coalesce(F.min(F.when((F.col("n") > 0) & (F.col("run") >= F.col("all") / 2), F.col("size"))), F.lit(NO_TEXT_SIZE)).alias("body"))


def heading(body: Column) -> Column:
    """Level of a flagged line that is a heading, else null."""
    t = F.col("plain")
    ratio = F.when(body > 0, F.col("size") / body).otherwise(1.0)
    n, listed = F.length(t), F.col("item").isNotNull()
    none = ~n.between(2, 160) | (listed & (ratio < 1.2)) | F.col("field") | F.col("led")
    bold = (F.coalesce("bold_ratio", F.lit(0.0)) >= 0.8) & (ratio >= 0.96) & (n <= 90) & ~t.rlike(r"[.!?:,;]\z") & ~listed
    return (
        F.when(none, F.lit(None).cast("int")).when(F.col("rubric"), 2).when((ratio >= 1.45) & (n <= 140), heading_level(ratio))
        .when((ratio >= 1.18) & ~F.col("ended") & (n <= 140), heading_level(ratio)).when(bold, 3)
    )


def headings(lines: DataFrame) -> DataFrame:
    """doc_id, page, line, level of the lines that look like headings, tables aside."""
    own = _flagged(lines).join(body_size(_flagged(lines)), LINE_KEY, "left")
    return own.select(*LINE_KEY, "line", heading(F.coalesce("body", F.lit(NO_TEXT_SIZE))).alias("level")).filter("level is not null")


def block_lines(lines: DataFrame, hyphens: bool = True, headings: bool = True, reflow: bool = True) -> DataFrame:
    """Flagged lines with kind (table, heading, ol, ul, para: of the block), block (number in the page), part (number of
    the item or row in it), level and joint."""
    order = _order()
    runs = _joints(_runs(_flagged(lines)), hyphens).join(body_size(_flagged(lines)), LINE_KEY, "left")
    level = F.when(F.lit(headings), heading(F.coalesce("body", F.lit(NO_TEXT_SIZE))))
    own = runs.withColumn("level", F.when(F.col("run").isNull(), level))
    own = own.withColumn("own", F.when(F.col("run").isNotNull(), "table").when(F.col("level").isNotNull(), "heading").when(F.col("item").isNotNull(), F.col("item.kind")).otherwise("para"))
    near = (F.col("y") - F.col("p_y") < F.col("size") * JOINED_GAP) & (F.col("x") >= F.col("p_x") - 2) & (F.col("joint") != "break")
    goes_on = (F.col("own") == "para") & F.coalesce(near, F.lit(False))
    # a line that goes on belongs to what the last line that does not has begun, a list's item or else a paragraph
    own = own.withColumn("from", F.last(F.when(~goes_on, F.col("own")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("kind", F.when(goes_on & F.col("from").isin("ol", "ul"), F.col("from")).otherwise(F.col("own")))
    before = F.lag("kind").over(order)
    is_list = F.col("kind").isin("ol", "ul")
    begins = (
        F.when(F.col("kind") == "table", F.col("run") == F.col("at")).when(F.col("kind") == "heading", True).when(is_list, ~before.eqNullSafe(F.col("kind")))
        .otherwise(F.lit(not reflow) | ~before.eqNullSafe(F.lit("para")) | (F.col("joint") == "break"))
    )
    own = own.withColumn("block", F.sum(begins.cast("int")).over(order).cast("int"))
    part = F.when(is_list, F.sum((F.col("own") == F.col("kind")).cast("int")).over(order)).when(F.col("kind") == "table", F.col("at")).otherwise(0)
    return own.withColumn("part", part.cast("int"))


def lines_to_blocks(lines: DataFrame, hyphens: bool = True, headings: bool = True, reflow: bool = True) -> DataFrame:
    """doc_id, page, block (from 0), kind, level (of headings), text and urls (of headings and paragraphs), items
    (array of n, text, urls; of lists) and rows (array of cells; of tables)."""
    own = block_lines(lines, hyphens, headings, reflow)
    said = F.when(F.col("own").isin("ol", "ul"), F.col("item.rest")).otherwise(F.col("plain"))
    ls = F.array_sort(F.collect_list(F.struct("at", "joint", said.alias("t"))))
    glue = lambda acc, x: F.when(x["joint"] == "hyphen", F.concat(F.regexp_replace(acc, f"{HYPHEN}\\z", ""), x["t"])).otherwise(F.concat(acc, F.lit(" "), x["t"]))
    text = F.aggregate(F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0))), ls[0]["t"], glue)
    parts = own.groupBy(*LINE_KEY, "block", "kind", "part").agg(
        text.alias("text"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "urls"))), lambda x: x["urls"]))).alias("urls"),
        F.min_by("item.n", "at").alias("n"), F.min_by("cells", "at").alias("cells"), F.min("level").alias("level"),
    )
    each = F.array_sort(F.collect_list(F.struct("part", "n", "text", "urls", "cells")))
    whole = parts.groupBy(*LINE_KEY, "block", "kind").agg(each.alias("ps"), F.min("level").alias("level"))
    single, listed = F.col("kind").isin("heading", "para"), F.col("kind").isin("ol", "ul")
    shown = F.when(F.col("kind") == "para", trim(F.col("ps")[0]["text"])).when(single, F.col("ps")[0]["text"])
    out = whole.select(
        *LINE_KEY, "block", "kind", "level", shown.alias("text"), F.when(single, F.col("ps")[0]["urls"]).alias("urls"),
        F.when(listed, F.transform("ps", lambda p: F.struct(p["n"].alias("n"), p["text"].alias("text"), p["urls"].alias("urls")))).alias("items"),
        F.when(F.col("kind") == "table", F.transform("ps", lambda p: p["cells"])).alias("rows"),
    ).filter("kind <> 'para' or text <> ''")
    return out.withColumn("block", (F.row_number().over(Window.partitionBy(*LINE_KEY).orderBy("block")) - 1).cast("int"))


def decorated(text: Column, urls: Column) -> Column:
    """A text of Markdown with its addresses: one is its link, several follow in brackets."""
    t = escape_inline(text)
    several = F.concat(t, F.lit(" ("), F.array_join(F.transform(urls, lambda u: F.concat(F.lit("<"), u, F.lit(">"))), ", "), F.lit(")"))
    return F.when(F.size(urls) == 1, F.concat(F.lit("["), t, F.lit("]("), urls[0], F.lit(")"))).when(F.size(urls) > 1, several).otherwise(t)


def markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, page, md: the blocks of each page, a blank line between them."""
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rows = F.transform("rows", lambda r: bar(F.transform(r, escape_cell)))
    rule = bar(F.transform(F.get("rows", F.lit(0)), lambda _: F.lit("---")))
    table = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.greatest(F.size("rows") - 1, F.lit(0)))), "\n")
    item = lambda i: F.concat(F.when(F.col("kind") == "ol", F.concat(i["n"].cast("string"), F.lit(". "))).otherwise("- "), decorated(i["text"], i["urls"]))
    own = decorated(F.col("text"), F.col("urls"))
    md = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), own)).when(F.col("kind") == "table", table).when(F.col("kind") == "para", own)
    md = md.otherwise(F.array_join(F.transform("items", item), "\n"))
    each = F.array_sort(F.collect_list(F.struct("block", md.alias("md"))))
    return blocks.groupBy(*LINE_KEY).agg(F.array_join(F.transform(each, lambda b: b["md"]), "\n\n").alias("md"))
