"""Markdown as a reader shows it: blocks of texts, and the spans inside a line.

A text is cut at blank lines into chunks, a row for each; the lines of a chunk get a letter by their shape, and the
automaton that makes blocks of lines is a rule over each letter and the one before it. Nothing is shuffled: each row
is worked on where it is, in time that grows with its length, and repeated rows give their blocks twice.

Null, empty and blank texts have no blocks. A byte order mark, front matter (from a first line --- to the next line
that begins with ---) and comments are left out; without an end neither is taken for one. Columns other than the text
are kept, but those named like a column of the result give way to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import every, has, java, trim

# Shapes of lines and spans.
HEADING = r"^#{1,3}\s+"
BULLET = r"^-\s+"
NUMBER = r"^\d+\.\s+"
TABLE_RULE = r"^\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-{3,}:?\s*\|?\z"
SPAN = r"\[([^\]\n]+)\]\((https?:\/\/[^\s)]+|mailto:[^\s)]+)\)|\*\*([^*\n]+)\*\*"
ESCAPED = r"\\([\\`*_{}\[\]#<>])"

KINDS = {"H": "h", "R": "hr", "U": "ul", "O": "ol", "B": "table", "T": "p"}
MADE = ("chunk", "at", "kind", "level", "start", "text", "items", "rows")


def body(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"\A\x{FEFF}", ""), r"(?s)\A---(?=\n).*?\n---", "")
    return trim(F.regexp_replace(bare, r"(?s)<!--.*?-->", ""))


def _letter(line: Column) -> Column:
    first = F.when(line == "---", "R").when(has(line, HEADING, ""), "H").when(has(line, BULLET, ""), "U")
    return first.when(has(line, NUMBER, ""), "O").when(line.startswith("|"), "B").otherwise("T")


def _strip(line: Column, mark: str) -> Column:
    return F.regexp_replace(line, java(mark, ""), "")


def cells(line: Column) -> Column:
    """Cells of a table's line, trimmed; a bar at either end is no border of a cell of its own."""
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|\z", ""), r"\|", -1), trim)


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each block: chunk and at (its first line in the chunk) give the order, kind is h, p, ul, ol, table or
    hr; level of h; start of ol, as text, since a number may have any length; text of h and p; items of ul and ol;
    rows of cells of a table. What follows the items of an ol belongs to the last one until another shape comes."""
    kept = [c for c in docs.columns if c not in MADE and c != text]
    chunks = docs.select(*kept, F.posexplode(F.split(body(F.col(text)), r"\n{2,}")).alias("chunk", "_chunk"))
    lined = chunks.withColumn("_lines", F.filter(F.transform(F.split("_chunk", "\n"), trim), lambda x: x != "")).filter(F.size("_lines") > 0)
    letters = F.array_join(F.transform("_lines", _letter), "")
    # text behind an item, and text behind that, goes on with the item
    marked = lined.drop("_chunk").withColumn("_ks", F.regexp_extract_all(F.regexp_replace(letters, r"(?<=O)T|\G(?!\A)T", "t"), F.lit("."), F.lit(0)))

    def begins(k: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("_ks", i - 1)).otherwise("")
        goes_on = (k.isin("U", "B", "T") & (before == k)) | ((k == "O") & before.isin("O", "t")) | (k == "t")
        return F.when(~goes_on, i)

    begun = marked.withColumn("_starts", F.array_compact(F.transform("_ks", begins)))
    end = lambda j: F.coalesce(F.get("_starts", j + 1), F.size("_lines"))
    cut = lambda name, s, j: F.slice(name, s + 1, end(j) - s)
    each = F.transform("_starts", lambda s, j: F.struct(s.alias("at"), cut("_ks", s, j).alias("ks"), cut("_lines", s, j).alias("ls")))
    found = begun.select(*kept, "chunk", F.explode(each).alias("_b")).select(*kept, "chunk", "_b.at", F.col("_b.ks").alias("_ks"), F.col("_b.ls").alias("_ls"))
    k, line = F.get("_ks", F.lit(0)), F.get("_ls", F.lit(0))
    # an item with what follows it: its first line to the next item's; a column of its own, so that it is made once
    found = found.withColumn("_heads", F.array_compact(F.transform("_ks", lambda x, i: F.when(x == "O", i))))
    next_ = lambda j: F.coalesce(F.get("_heads", j + 1), F.size("_ls"))
    ordered = F.transform("_heads", lambda s, j: _strip(F.array_join(F.slice("_ls", s + 1, next_(j) - s), " "), NUMBER))
    table = F.transform(F.filter("_ls", lambda x: ~has(x, TABLE_RULE, "")), cells)
    out = found.select(
        *kept, "chunk", "at", F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[k].alias("kind"),
        F.when(k == "H", F.length(F.regexp_extract(line, "^#+", 0))).alias("level"), F.when(k == "O", F.regexp_extract(line, r"^\d+", 0)).alias("start"),
        F.when(k == "H", _strip(line, HEADING)).when(k == "T", F.array_join("_ls", " ")).alias("text"),
        F.when(k == "U", F.transform("_ls", lambda x: _strip(x, BULLET))).when(k == "O", ordered).alias("items"), F.when(k == "B", table).alias("rows"),
    )
    return out.filter("kind <> 'table' or size(rows) > 0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def spans(text: Column) -> Column:
    """Spans of a line in order: kind (text, link or strong), text without escapes, href of a link; null for null."""
    parts = [every(text, SPAN, g, "") for g in (1, 2, 3)]
    one = lambda kind, x, href: F.struct(F.lit(kind).alias("kind"), unescape(x).alias("text"), href.alias("href"))
    none = F.lit(None).cast("string")
    marked = F.zip_with(F.arrays_zip(parts[0].alias("a"), parts[1].alias("b")), parts[2], lambda link, bold: F.when(bold != "", one("strong", bold, none)).otherwise(one("link", link["a"], link["b"])))
    plain = F.transform(F.split(text, java(SPAN, ""), -1), lambda x: one("text", x, none))
    return F.filter(F.flatten(F.zip_with(plain, marked, lambda p, m: F.array(p, m))), lambda x: x.isNotNull() & (x["text"] != ""))
