"""Rules of layout: hyphens, cleaning, lists, headings, legal units, page ranges, escapes, and the operators over
pages, lines and glyphs as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lavra.functions.text import CNJ, _latin, first, has, squeeze, trim
from lavra.operators.search import fold_text

# Endings that a broken word has, ligatures, openings of legal units.
BROKEN = (
    "^(?:ção|ções|ssão|sões|mento|menta|mente|dade|agens|agem|ário|ária|ência|ância|ável|ível|ando|endo|indo|ado|ada|idos|idas|oso|osa|ente|antes|ência)$"
)
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
UNIT = r"^(?:Ementa|Relatório|Voto|Acórdão|Decisão|Despacho|Dispositivo|Extrato|Intimação|Edital|Portaria|Resolução|Certidão|Conclusão)\b"
HEADER = r"^(?:Processo|Proc\.|Autos|Classe)\b"
HYPHEN = "[-‐‑]"


def dehyphenate(prev: Column, nxt: Column) -> Column:
    """Whether the hyphen at the end of prev breaks a word, rather than belonging to a compound or a code."""
    t = trim(prev)
    left = F.regexp_extract(F.regexp_replace(t, f"{HYPHEN}\\z", ""), r"(\S*)\z", 1)
    right = F.regexp_replace(F.regexp_extract(trim(nxt), r"^(\S*)", 1), r"(?s)[^\p{L}].*\z", "")
    refused = ~t.rlike(f"{HYPHEN}\\z") | (F.length(left) < 2) | (F.length(right) < 2) | (left.rlike(r"\d")) | right.rlike(r"\d") | left.rlike(r"[./\\]")
    return F.when(refused, False).when(has(right, BROKEN), True).otherwise(~((F.length(left) >= 4) & (F.length(right) >= 4)))


def clean_plain(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), "­", "")
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"[ \t]*(?:[.…]{4,})[ \t]*(?:·[ \t]*)?", " — ")
    return trim(F.regexp_replace(out, r"[ \t]{2,}", " "))


def repair_quotes(text: Column) -> Column:
    """Inverted question marks that stand for quotation marks."""
    out = F.regexp_replace(text, "¿¿([^¿]{0,240})¿¿", "“$1”")
    out = F.regexp_replace(out, "¿([^¿\n]{0,240})¿", "“$1”")
    return F.regexp_replace(F.regexp_replace(out, r"¿(?=\S)", "“"), "¿", "”")


def list_item(text: Column) -> Column:
    """kind (ol, ul), rest and n of a list item, null if the text is none."""
    ol = r"^(\d{1,3})[.)]\s+(\S[^\n\r]*)\z"
    n = F.regexp_extract(text, ol, 1)
    item = lambda kind, p, g, num: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, p, g).alias("rest"), num.cast("int").alias("n"))
    letter, bullet, dash = r"(?i)^[a-z]\)\s+(\S[^\n\r]*)\z", r"^[•·▪▸►◦‣–—]\s+(\S[^\n\r]*)\z", r"^-\s+(\S[^\n\r]*)\z"
    return (
        F.when((n != "") & (F.coalesce(n.try_cast("int"), F.lit(999)) <= 200), item("ol", ol, 2, n.try_cast("int")))
        .when(text.rlike(letter), item("ul", letter, 1, F.lit(0)))
        .when(text.rlike(bullet), item("ul", bullet, 1, F.lit(0)))
        .when(text.rlike(dash) & (F.length(text) <= 110), item("ul", dash, 1, F.lit(0)))
    )


def heading_level(ratio: Column) -> Column:
    return F.when(ratio >= 1.7, 1).when(ratio >= 1.28, 2).otherwise(3)


def is_field(text: Column) -> Column:
    return trim(text).rlike(r"^\p{Lu}[\p{L}0-9 .()ºª°/-]{1,60}\s*:\s+\S") & (F.length(first(trim(text), r"^[^:]*:\s+(\S[^\n\r]*)$", 1)) <= 80)


def is_rubric(text: Column) -> Column:
    letters = F.regexp_replace(text, "[^A-Za-zÀ-ÿ]", "")
    upper = F.length(F.regexp_replace(letters, "[^A-ZÁÉÍÓÚÂÊÔÃÕÇ]", ""))
    fits = (F.length(text) >= 3) & (F.length(text) <= 56) & ~text.rlike(r"[.!?,;:]\z") & ~text.contains(":")
    return fits & (F.length(letters) >= 4) & (upper / F.greatest(F.length(letters), F.lit(1)) > 0.85)


def is_leader(text: Column) -> Column:
    return text.rlike(r"\.{4,}|…{2,}") | text.rlike(r" — \d{1,4}\z")


def legal_unit(text: Column) -> Column:
    line = trim(text)
    return (has(line, CNJ, "") & (F.length(line) < 140)) | (has(line, HEADER, "") & (F.length(line) < 180)) | (has(line, UNIT, "") & (F.length(line) < 100))


def escape_inline(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\`*_{}\[\]#<>]", r"\\$0")


def escape_cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(escape_inline(text), r"\|", r"\\|"), r"\s+", " "))


def page_spec(specs: DataFrame) -> DataFrame:
    """specs(spec, total) with pages: "1-3, 5" as sorted distinct numbers, swapped bounds put right, what lies
    outside a range's total left out; null where the spec is an error (no number, a single page outside, or
    no page at all). An empty spec is all pages."""
    part = F.filter(F.transform(F.split("spec", ","), lambda x: trim(x)), lambda x: x != "")
    pattern = r"^(\d+)(?:\s*[-–]\s*(\d+))?\z"

    def pages(x: Column) -> Column:
        a = F.regexp_extract(x, pattern, 1).try_cast("int")
        b = F.coalesce(F.regexp_extract(x, pattern, 2).try_cast("int"), a)
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), F.col("total"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    single = lambda x: (F.regexp_extract(x, pattern, 2) == "") & ~F.coalesce(F.regexp_extract(x, pattern, 1).try_cast("int").between(1, F.col("total")), F.lit(False))
    wrong = F.exists("part", lambda x: ~x.rlike(pattern) | single(x))
    got = F.array_sort(F.array_distinct(F.flatten(F.transform("part", pages))))
    df = specs.withColumn("part", part)
    return df.select("spec", "total", F.when(F.size("part") == 0, F.sequence(F.lit(1), F.col("total"))).when(wrong | (F.size(got) == 0), None).otherwise(got).alias("pages"))


# ---- pages as tables: lines(doc_id, page, line, plain, x, y, width, height, ...), glyphs(doc_id, page, x, y, width, size, str)
#
# Nulls in a coordinate leave the row out of what is measured; repeated rows count as often as they occur; empty
# tables give empty results; columns of the input pass through unless a result has their name.

BINS = 48
LINE_KEY = ["doc_id", "page"]


def column_edge(lines: DataFrame) -> DataFrame:
    """Right edge of the text of each page: of the ends of its long lines (24 characters and the median length at
    least; all lines if fewer than four are long) the one at 85 % of the order."""
    by = Window.partitionBy(*LINE_KEY)
    known = lines.filter(F.col("x").isNotNull() & F.col("width").isNotNull()).select(*LINE_KEY, F.length("plain").alias("n"), (F.col("x") + F.col("width")).alias("end"))
    counted = known.select("*", F.count("*").over(by).alias("all"), F.row_number().over(by.orderBy("n", "end")).alias("at"))
    half = F.max(F.when(F.col("at") == F.floor((F.col("all") - 1) / 2) + 1, F.col("n"))).over(by)
    long = counted.withColumn("long", F.col("n") >= F.greatest(F.lit(24), half))
    used = long.withColumn("many", F.count_if("long").over(by) >= 4).filter(F.col("long") | ~F.col("many"))
    ends = Window.partitionBy(*LINE_KEY)
    ranked = used.select(*LINE_KEY, "end", F.row_number().over(ends.orderBy("end")).alias("at"), F.count("*").over(ends).alias("all"))
    return ranked.filter(F.col("at") == F.floor((F.col("all") - 1) * 0.85) + 1).select(*LINE_KEY, F.col("end").alias("edge"))


def column_gutter(glyphs: DataFrame, page_width: str = "page_width") -> DataFrame:
    """The gutter of each page of two columns: doc_id, page, gutter. The width is cut into 48 bins, a glyph covers
    its bins by its size; the longest run of bins with at most 4 % of the fullest, between 20 and 80 % of the
    width, is a gutter if it is two bins and 4 % of the width at least, ten visible glyphs are on the page, and
    four on either side. Pages narrower than 200 have none."""
    seen = glyphs.filter((trim(F.col("str")) != "") & (F.col(page_width) >= 200)).withColumn("bin_w", F.col(page_width) / BINS)
    low = F.greatest(F.lit(0), F.floor(F.col("x") / F.col("bin_w")).cast("int"))
    high = F.least(F.lit(BINS - 1), F.floor((F.col("x") + F.greatest("width", F.lit(1))) / F.col("bin_w")).cast("int"))
    covered = seen.withColumn("low", low).withColumn("high", high).filter("low <= high").select(*LINE_KEY, "size", F.explode(F.sequence("low", "high")).alias("bin"))
    cover = covered.groupBy(*LINE_KEY, "bin").agg(F.sum("size").alias("cover"))
    pages = seen.groupBy(*LINE_KEY).agg(F.first("bin_w").alias("bin_w"), F.count("*").alias("glyphs")).filter("glyphs >= 10")
    bins = pages.select("*", F.explode(F.sequence(F.lit(int(BINS * 0.2)), F.lit(-(-BINS * 8 // 10) - 1))).alias("bin"))
    most = cover.groupBy(*LINE_KEY).agg(F.max("cover").alias("most"))
    open_ = bins.join(cover, [*LINE_KEY, "bin"], "left").join(most, LINE_KEY).filter(F.coalesce("cover", F.lit(0)) <= F.col("most") * 0.04)
    run = open_.withColumn("run", F.col("bin") - F.row_number().over(Window.partitionBy(*LINE_KEY).orderBy("bin")))
    runs = run.groupBy(*LINE_KEY, "bin_w", "run").agg(F.min("bin").alias("start"), F.count("*").alias("len"))
    best = runs.groupBy(*LINE_KEY, "bin_w").agg(F.max(F.struct("len", (-F.col("start")).alias("back"))).alias("b"))
    wide = best.filter((F.col("b.len") >= 2) & (F.col("b.len") * F.col("bin_w") >= BINS * F.col("bin_w") * 0.04))
    placed = wide.select(*LINE_KEY, ((F.col("b.len") / 2 - F.col("b.back")) * F.col("bin_w")).alias("gutter"))
    sides = seen.join(placed, LINE_KEY).groupBy(*LINE_KEY, "gutter").agg(F.count_if(F.col("x") + F.col("width") / 2 < F.col("gutter")).alias("l"), F.count("*").alias("n"))
    return sides.filter((F.col("l") >= 4) & (F.col("n") - F.col("l") >= 4)).select(*LINE_KEY, "gutter")


def zone(y: Column, height: Column) -> Column:
    return F.when(y < height * 0.08, "top").when(y > height * 0.92, "bottom").otherwise("body")


def chrome_key(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(text), r"\d+", "#"))


def lone_page_number(text: Column) -> Column:
    return has(trim(text), r"^(?:p[aá]g(?:ina|\.)?\s*)?\d{1,4}$")


def without_chrome(lines: DataFrame) -> DataFrame:
    """lines(doc_id, page, plain, y, height, ...) without running heads and feet: lone page numbers in a margin,
    and, in documents of two pages or more, margin texts (digits aside) that stand on 60 % of the pages and on
    two at least. Counts are of pages, so a text repeated on one page counts once."""
    margin = zone(F.col("y"), F.col("height"))
    keyed = lines.withColumn("zone__", margin).withColumn("key__", chrome_key(F.col("plain")))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages__"))
    texts = keyed.filter((F.col("zone__") != "body") & F.length("key__").between(2, 420)).groupBy("doc_id", "zone__", "key__").agg(F.count_distinct("page").alias("on"))
    often = texts.join(pages, "doc_id").filter((F.col("pages__") >= 2) & (F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("pages__") * 0.6)))).select("doc_id", "zone__", "key__")
    number = (F.col("zone__") != "body") & lone_page_number(F.col("plain"))
    return keyed.filter(~number).join(often, ["doc_id", "zone__", "key__"], "left_anti").select(*lines.columns)


def clipped_tails(lines: DataFrame) -> DataFrame:
    """The last lines of pages that the next page's first line repeats or continues: doc_id, page, line. The last
    line stands below 86 % of the height and has 28 characters or more; a continuation is over 8 longer."""
    plain = squeeze(F.col("plain"))
    ends = lines.groupBy(*LINE_KEY).agg(F.max_by(F.struct("line", plain.alias("t"), "y", "height"), "line").alias("last"), F.min_by(plain, "line").alias("first"))
    follow = ends.withColumn("next", F.lead("first").over(Window.partitionBy("doc_id").orderBy("page")))
    t = F.col("last.t")
    same = (t == F.col("next")) | (F.col("next").startswith(t) & (F.length("next") > F.length(t) + 8))
    hit = (F.col("last.y") >= F.col("last.height") * 0.86) & (F.length(t) >= 28) & same
    return follow.filter(hit).select(*LINE_KEY, "last.line")


def line_metrics(glyphs: DataFrame) -> DataFrame:
    """glyphs(doc_id, page, line, x, y, width, size, bold) to x, mean y, width, size (by count) and bold ratio (by
    characters) of each line."""
    n = F.length("str")
    return glyphs.groupBy(*LINE_KEY, "line").agg(
        F.min("x").alias("x"), F.avg("y").alias("y"), F.greatest(F.lit(0.0), F.max_by(F.col("x") + F.col("width"), "x") - F.min("x")).alias("width"), F.max("size").alias("size"),
        (F.sum(F.when(F.col("bold"), n).otherwise(0)) / F.greatest(F.sum(n), F.lit(1))).alias("bold_ratio"),
    )


def glyph_gaps(glyphs: DataFrame) -> DataFrame:
    """Each glyph with what stands before it in its line: `gap` (space, cell or none), by the distance to the end of
    the glyph before: over 2.2 sizes and 16 a new cell, over 0.17 sizes and 1.1 a space."""
    order = Window.partitionBy(*LINE_KEY, "line").orderBy("x")
    distance = F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)
    cell, space = F.greatest(F.col("size") * 2.2, F.lit(16.0)), F.greatest(F.col("size") * 0.17, F.lit(1.1))
    return glyphs.withColumn("gap", F.when(distance > cell, "cell").when(distance > space, "space").otherwise("none"))


def cluster_lines(glyphs: DataFrame) -> DataFrame:
    """glyphs of a page with `line`, their line's number from 0. Glyphs come by y, then x; one joins the latest of
    the last three lines whose mean y is nearer than 0.45 sizes (the lesser of the line's first glyph and its
    own; 2 at least), else it begins a line. A fold over the glyphs of one page, in one task each."""

    def step(acc: Column, g: Column) -> Column:
        lines, n = acc["lines"], F.size(acc["lines"])
        fits = lambda b: F.get(F.filter(F.array(F.get(lines, b)), lambda x: x.isNotNull() & (F.abs(x["sum"] / x["n"] - g["y"]) <= F.greatest(F.lit(2.0), F.least(x["size"], g["size"]) * 0.45))), F.lit(0)).isNotNull()
        to = F.when(fits(n - 1), n - 1).when(fits(n - 2), n - 2).when(fits(n - 3), n - 3).otherwise(n)
        begun = F.struct(g["y"].alias("sum"), F.lit(1).alias("n"), g["size"].alias("size"))
        grown = F.transform(lines, lambda x, i: F.when(i == to, F.struct((x["sum"] + g["y"]).alias("sum"), (x["n"] + 1).alias("n"), x["size"].alias("size"))).otherwise(x))
        return F.struct(F.when(to == n, F.concat(lines, F.array(begun))).otherwise(grown).alias("lines"), F.concat(acc["at"], F.array(to)).alias("at"))

    seen = glyphs.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    rest = F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("size").cast("double").alias("size"), F.struct(*glyphs.columns).alias("g"))
    page = seen.groupBy(*LINE_KEY).agg(F.array_sort(F.collect_list(rest)).alias("gs"))
    start = F.expr("named_struct('lines', cast(array() as array<struct<sum:double,n:int,size:double>>), 'at', cast(array() as array<int>))")
    placed = page.select("gs", F.aggregate("gs", start, step, lambda a: a["at"]).alias("at"))
    return placed.select(F.explode(F.arrays_zip("gs", "at")).alias("z")).select("z.gs.g.*", F.col("z.at").alias("line"))


def annotated(lines: DataFrame, annotations: DataFrame) -> DataFrame:
    """Links of lines: lines(doc_id, page, line, x, y, width, size) and annotations(doc_id, page, url, ax, ay, aw, ah)
    whose boxes overlap, each url once a line. Joined by page, so that only the boxes of one page meet."""
    met = lines.join(annotations, LINE_KEY)
    high = (F.col("y") + F.col("size") * 0.35 >= F.col("ay")) & (F.col("y") - F.col("size") <= F.col("ay") + F.col("ah"))
    wide = (F.col("x") + F.col("width") >= F.col("ax")) & (F.col("x") <= F.col("ax") + F.col("aw"))
    return met.filter(high & wide).select(*LINE_KEY, "line", "url").distinct()


def safe_url(url: Column) -> Column:
    """The address if its scheme is http, https or mailto, else null."""
    scheme = F.lower(F.regexp_extract(trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme.isin("http", "https") & trim(url).rlike(r"^[A-Za-z]+:/*[^/\s]"), trim(url)).when(scheme == "mailto", trim(url))


def toc(slices: DataFrame) -> DataFrame:
    """Contents told by the first three pages: doc_id, label, target; the first line of a label counts."""
    first_pages = slices.filter("slice_ord < 3").select("doc_id", "slice_ord", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    pattern = r"^(.+?)\s*(?:\.{4,}|—)\s*(\d{1,9})\s*\z"
    line = trim(F.col("line"))
    rows = first_pages.select("doc_id", "slice_ord", "at", trim(F.replace(F.regexp_extract(line, pattern, 1), F.lit("\\"), F.lit(""))).alias("label"), F.regexp_extract(line, pattern, 2).try_cast("int").alias("target"))
    return rows.filter("label <> '' and target >= 1").groupBy("doc_id", "label").agg(F.min_by("target", F.struct("slice_ord", "at")).alias("target"))


def links(text: Column) -> Column:
    """Inline links of Markdown: array of label and url, in order, escapes of labels undone."""
    pattern = r"\[([^\]\n]+)\]\((https?://[^\s)]+|mailto:[^\s)]+)\)"
    label = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, r"\\([\\`*_{}\[\]#<>|])", "$1"))
    return F.arrays_zip(label.alias("label"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("url"))


def highlights(text: Column, query: str) -> Column:
    """Spans of the query in a text, case and accents aside: array of start (from 1) and length. Marks that stand
    as characters of their own after a letter belong to the span."""
    letters = [re.escape(c) for c in fold_text(query)]
    if not letters:
        return F.array().cast("array<struct<start:int,length:int>>")
    folded = F.lower(F.translate(text, *_latin()))
    pattern = "".join(c + r"\p{M}*" for c in letters)
    hits = F.regexp_extract_all(folded, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(folded, pattern), 1, F.size(hits)).alias("a"), hits.alias("h"))
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,length:int>>))")
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["a"]) + F.length(x["h"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["a"]) + 1).alias("start"), F.length(x["h"]).alias("length")))).alias("out"))
    return F.aggregate(pairs, start, step, lambda a: a["out"])


def md_blocks(text: Column) -> Column:
    """Kinds of the blocks of a Markdown text, in order: h, hr, table, ul, ol or p; front matter and comments are not
    among them."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", ""), r"(?s)<!--.*?-->", "")
    parts = F.filter(F.transform(F.split(body, r"\n{2,}"), trim), lambda x: x != "")
    kind = lambda x: F.when(x.rlike(r"^#{1,6}\s"), "h").when(x.rlike(r"^(?:-{3,}|\*{3,})\z"), "hr").when(x.startswith("|"), "table").when(x.rlike(r"^[-*]\s"), "ul").when(x.rlike(r"^\d+\.\s"), "ol").otherwise("p")
    return F.transform(parts, kind)
