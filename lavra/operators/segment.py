"""Pages, lines and acts of documents. Nothing here leaves the JVM; short documents are not shuffled at all, and no
long one becomes one row again, but for its acts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lavra.functions.text import BLANK, CNJ, every, has, java, let, trim

#: Line feeds of a document from which it is scanned in chunks.
CHUNK = 4096

# Page marks, openings of acts, sections that are none, citations, headers of a process.
PAGE = r"<!--\s*página\s+(\d+)([^>]*)-->"
START = (
    r"^(?:extrato(?:\s+de\s+\p{L}+)?|despacho|senten[çc]a|decis[ãa]o|certid[ãa]o|parecer|peti[çc][ãa]o|edital|portaria|intima[çc][ãa]o|ac[óo]rd[ãa]o"
    r"|minuta|modelo|representa[çc][ãa]o|presta[çc][ãa]o de contas(?:\s+\p{L}+)?|cumprimento de senten[çc]a)\b"
)
SECTION = r"^(?:ementa|relatorio|voto|dispositivo|fundamentacao|conclusao)\b"
CITATION = r"jurisprud|precedente|citad|Rel\.|originad"
PROCESS = r"(?:^|\b)(?:processo|autos|proc\.)\b"
UNTITLED = "Trecho sem título"
#: Characters of a process number.
CNJ_CHARS = 25


def _slices(text: Column) -> Column:
    """Array of page, note, text: one for each page mark (what stands before the first is dropped), or one without page.
    The text is searched once and split once, however many marks it has."""

    def marked(marks: Column) -> Column:
        # the part before the first mark is dropped, so that the i-th mark goes before part i + 1
        each = lambda parts: F.transform(marks, lambda m, i: F.struct(
            F.regexp_extract(m, java(PAGE, ""), 1).cast("int").alias("page"), F.regexp_extract(m, java(PAGE, ""), 2).alias("note"), trim(F.get(parts, i + 1)).alias("text")))
        return F.when(F.size(marks) > 0, let(F.split(text, f"(?:{java(PAGE, '')})"), each)).otherwise(whole)

    whole = F.array(F.struct(F.lit(None).cast("int").alias("page"), F.lit("").alias("note"), trim(F.coalesce(text, F.lit(""))).alias("text")))
    return let(every(text, PAGE, 0, ""), marked)


def page_slices(docs: DataFrame, text: str = "reading") -> DataFrame:
    """One row for each page mark (what stands before the first is dropped), or one without page:
    the other columns, slice_ord, page, note, text."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(_slices(F.col(text))).alias("slice_ord", "s")).select(*others, "slice_ord", "s.page", "s.note", "s.text")


def is_start(line: Column) -> Column:
    return _opens(trim(line))


def _opens(t: Column) -> Column:
    """is_start of a trimmed line, of four words at most; the cheapest condition goes first. No line that matches START is a
    mark of a page or, folded, a SECTION: their first three letters differ."""
    return (F.length(t) > 0) & (F.length(t) <= 80) & has(t, START) & ~t.rlike(r"^(?:\S*+\s++){4}")


def is_process(line: Column) -> Column:
    return ~has(line, CITATION) & has(line, PROCESS) & has(line, CNJ, "")


def lines(docs: DataFrame) -> DataFrame:
    """Every line of every page slice: doc_id, slice_ord, page, line_ord, line."""
    return page_slices(docs).select("doc_id", "filename", "slice_ord", "page", F.posexplode(F.split("text", "\n")).alias("line_ord", "line"))


#: A line feed before a line that may open an act or holds a number; any other line never begins an act.
_TURN = rf"\n(?=(?iu:[{BLANK}&&[^\n]]*{java(START, '').removeprefix('^')})|[^\n]*?{CNJ})"
_CUT = "\0"


def _runs(text: Column) -> Column:
    """The text as lines that may open an act or hold a number, each with the plain lines after it. The pattern is
    compiled once, unless the text holds the mark itself."""
    return F.when(text.contains(_CUT), F.split(text, _TURN)).otherwise(F.split(F.regexp_replace(text, _TURN, _CUT), _CUT))


def _head(run: Column) -> Column:
    return F.substring_index(run, "\n", 1)


def _flagged(lines_: Column) -> Column:
    """Lines, or runs that plain lines follow (array of page, line), with filled, and of their first lines start, cnj
    (numbers of lines that cite nothing) and process. Patterns are tried only on lines that are long enough to hold them."""
    none = F.array().cast("array<string>")
    numbers = lambda line: F.when(F.length(line) >= CNJ_CHARS, every(line, CNJ, 0, "")).otherwise(none)
    own = lambda line: let(numbers(line), lambda all_: F.when((F.size(all_) > 0) & ~has(line, CITATION), F.array_distinct(all_)).otherwise(none))
    heads = F.transform(lines_, lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), _head(x["line"]).alias("head")))
    found = F.transform(heads, lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), x["head"].alias("head"), trim(x["head"]).alias("bare"), own(x["head"]).alias("cnj")))
    return F.transform(found, lambda x: F.struct(
        x["page"].alias("page"), x["line"].alias("line"), ((x["bare"] != "") | (trim(x["line"]) != "")).alias("filled"), _opens(x["bare"]).alias("start"), x["cnj"].alias("cnj"),
        ((F.size(x["cnj"]) > 0) & has(x["head"], PROCESS)).alias("process")))


_MARK = "array<struct<pos:int,low:int,high:int,process:boolean>>"
_FAR = 2**31 - 1


def _marks(flagged: Column, base: Column, outer: Column, last: Column, full: Column) -> Column:
    """Places of a chunk where an act may begin: pos, low, high. One begins there if the act that is open began
    after low and not after high: an opening takes every act that is open, a process header those in which some of its
    numbers (last seen at low) does not stand yet, but some number (last at high) does.

    base: place of the chunk's first line. Of the chunks before: outer (map of number to last place), last (place of the
    last line with a number, -1 if none), full (whether a line is filled)."""
    seen = F.flatten(F.transform(flagged, lambda x, i: F.transform(x["cnj"], lambda c: F.struct(c.alias("cnj"), (base + i).alias("pos"), x["process"].alias("process")))))
    first_filled = F.array_position(F.transform(flagged, lambda x: x["filled"]), F.lit(True)).cast("int")

    def linked(sorted_: Column) -> Column:
        before = lambda o, k: F.when((k > 0) & (F.get(sorted_, k - 1)["cnj"] == o["cnj"]), F.get(sorted_, k - 1)["pos"])
        return F.transform(sorted_, lambda o, k: F.struct(o["pos"].alias("pos"), F.coalesce(before(o, k), F.element_at(outer, o["cnj"]), F.lit(-1)).alias("low"), o["process"].alias("process")))

    def one_each(by_pos: Column) -> Column:
        return F.filter(by_pos, lambda o, k: (k == 0) | (F.get(by_pos, k - 1)["pos"] != o["pos"]))

    def bounded(events: Column) -> Column:
        high = lambda k: F.coalesce(F.get(events, F.when(k > 0, k - 1))["pos"], last)
        return F.transform(events, lambda e, k: F.struct(e["pos"].alias("pos"), e["low"].alias("low"), high(k).alias("high"), e["process"].alias("process")))

    headers = let(F.array_sort(let(F.array_sort(seen), linked)), lambda xs: let(one_each(xs), bounded))
    headers = F.filter(headers, lambda e: e["process"])
    opens = let(first_filled, lambda at: F.filter(F.transform(flagged, lambda x, i: F.when(x["start"] & (full | (i + 1 > at)), (base + i).cast("int"))), lambda x: x.isNotNull()))
    opened = F.transform(opens, lambda p: F.struct(p.alias("pos"), F.lit(-2).alias("low"), F.lit(_FAR).alias("high"), F.lit(False).alias("process")))
    return F.array_sort(F.concat(opened, headers).cast(_MARK))


def _begins(acc: Column, mark: Column) -> Column:
    return (acc > mark["low"]) & (acc <= mark["high"])


def _boundaries(marks: Column, open_: Column) -> Column:
    """Places where acts begin in a chunk, after the one that is open at its start."""
    start = F.struct(open_.cast("int").alias("b"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, m: F.when(_begins(acc["b"], m), F.struct(m["pos"].alias("b"), F.concat(acc["out"], F.array(m["pos"])).alias("out"))).otherwise(acc)
    return F.aggregate(marks, start, step, lambda acc: acc["out"])


def _pieces(flagged: Column, base: Column, bounds: Column, n_before: Column) -> Column:
    """Parts of acts in a chunk: ord, begins, title, text, pages."""

    def piece(own: Column, k: Column) -> Column:
        head = F.get(own, F.lit(0))
        pages = F.array_sort(F.array_distinct(F.transform(F.filter(own, lambda x: x["filled"] & x["page"].isNotNull()), lambda x: x["page"])))
        title = F.when(head["start"], F.substring(trim(_head(head["line"])), 1, 80)).otherwise(UNTITLED)
        text = F.array_join(F.transform(own, lambda x: x["line"]), "\n")
        return F.struct((n_before + k + 1).cast("int").alias("ord"), ((k > 0) | (base == 0)).alias("begins"), title.alias("title"), text.alias("text"), pages.alias("pages"))

    def cut_(begins: Column) -> Column:
        spans = F.transform(begins, lambda b, k: F.struct(b.alias("from"), F.coalesce(F.get(begins, k + 1), base + F.size(flagged)).alias("to"), k.alias("k")))
        some = F.filter(spans, lambda s: s["to"] > s["from"])
        return F.transform(some, lambda s: let(F.slice(flagged, s["from"] - base + 1, s["to"] - s["from"]), lambda own: piece(own, s["k"])))

    return let(F.concat(F.array(base.cast("int")), bounds), cut_)


def _chunks(docs: DataFrame, size: int | None) -> DataFrame:
    """key, chunk, ls: lines (page, line) of each document, `size` to a row; all in one row, as runs, if size is None."""
    parts = _runs if size is None else lambda text: F.split(text, "\n")
    split = lambda s: F.transform(parts(s["text"]), lambda x: F.struct(s["page"].alias("page"), x.alias("line")))
    ls = F.flatten(F.transform(_slices(F.col("reading")), split))
    if size is None:
        return docs.select("key", F.lit(0).alias("chunk"), ls.alias("ls"))
    cut_ = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / size).cast("int")), lambda k: F.slice("ls", k * size + 1, F.lit(size)))
    return docs.select("key", ls.alias("ls")).select("key", F.posexplode(cut_).alias("chunk", "ls"))


def _build(pieces: DataFrame) -> DataFrame:
    return pieces.filter(F.col("text") != "").select(
        "key.doc_id", "key.filename", "ord", F.format_string("%s-%d", F.col("key.doc_id").cast("string"), F.col("ord")).alias("act_id"), "title", "text", "pages"
    )


def _whole(docs: DataFrame) -> DataFrame:
    """Acts of documents of a few lines: each is worked out in its row, nothing is shuffled."""
    nothing = F.lit(None).cast("map<string,int>")
    one = _chunks(docs, None).select("key", F.explode(F.array(_flagged(F.col("ls")))).alias("f"))
    zero = F.lit(0)
    acts_ = one.select("key", F.inline(_pieces(F.col("f"), zero, _boundaries(_marks(F.col("f"), zero, nothing, F.lit(-1), F.lit(False)), zero), zero)))
    return _build(acts_.withColumn("text", trim(F.col("text"))))


def _scanned(docs: DataFrame, size: int) -> DataFrame:
    """Acts of documents of any length by a scan in two levels. Chunks of lines are dealt over all tasks. What reaches into a chunk
    from before is, for each of its numbers, the last place of that number, by one window over (document, number,
    chunk); a chunk is then a function from the act that is open at its start (by its first line) to the act that is open at its
    end, stated by a few ranges of first lines; one short row of a document composes them. At last each chunk cuts
    its lines, and the parts of an act are joined."""
    dealt = _chunks(docs, size).repartition("key", "chunk")
    f = dealt.select("key", "chunk", (F.col("chunk") * size).alias("base"), F.explode(F.array(_flagged(F.col("ls")))).alias("f"))
    numbers = f.select("key", "chunk", F.posexplode(F.transform("f", lambda x: x["cnj"])).alias("i", "cnj")).select("key", "chunk", (F.col("chunk") * size + F.col("i")).cast("int").alias("pos"), F.explode("cnj").alias("cnj"))
    last = numbers.groupBy("key", "cnj", "chunk").agg(F.max("pos").alias("last"))
    lagged = last.withColumn("before", F.lag("last").over(Window.partitionBy("key", "cnj").orderBy("chunk")))
    outer = lagged.groupBy("key", "chunk").agg(F.map_from_entries(F.collect_list(F.when(F.col("before").isNotNull(), F.struct("cnj", "before")))).alias("outer"), F.max("last").alias("last"))
    filled = f.select("key", "chunk", F.exists("f", lambda x: x["filled"]).alias("filled"))
    ahead = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = filled.join(outer, ["key", "chunk"], "left").select(
        "key", "chunk", "outer", F.coalesce(F.max("last").over(ahead), F.lit(-1)).alias("last"), F.coalesce(F.max("filled").over(ahead), F.lit(False)).alias("full")
    )
    marked = f.join(carried, ["key", "chunk"]).select("key", "chunk", "base", "f", F.explode(F.array(_marks(F.col("f"), F.col("base"), F.col("outer"), F.col("last"), F.col("full")))).alias("marks"))
    entries = _compose(marked.select("key", "chunk", _ranges(F.col("marks"), F.col("base")).alias("ranges")))
    cut_ = marked.join(entries, ["key", "chunk"]).select("key", "chunk", F.inline(_pieces(F.col("f"), F.col("base"), _boundaries(F.col("marks"), F.col("open")), F.col("n"))))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "begins", "title", "text", "pages")))
    joined = cut_.groupBy("key", "ord").agg(parts.alias("p"))
    head = F.col("p")[0]
    return _build(joined.select(
        "key", "ord", head["title"].alias("title"), trim(F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: x["pages"])))).alias("pages"),
    ))


_RANGE = "array<struct<low:int,high:int,open:int,n:int>>"


def _ranges(marks: Column, base: Column) -> Column:
    """A chunk as a function: an act that is open at its start and began in (low, high] leaves the act that began at
    `open` at its end, the n-th that begins here; the first range that holds it counts, without any it stays open."""
    start = F.struct(F.array().cast(_RANGE).alias("rs"), F.lit(_FAR).alias("low"))

    def step(acc: Column, m: Column) -> Column:
        moved = F.transform(acc["rs"], lambda r: F.when(_begins(r["open"], m), F.struct(r["low"].alias("low"), r["high"].alias("high"), m["pos"].alias("open"), (r["n"] + 1).alias("n"))).otherwise(r))
        own = F.struct(m["low"].alias("low"), m["high"].alias("high"), m["pos"].alias("open"), F.lit(1).alias("n"))
        news = F.when(m["low"] < acc["low"], F.array(own)).otherwise(F.array()).cast(_RANGE)
        # a range without upper end takes all that its low end admits, so that only lower ones can be reached later
        return F.struct(F.concat(moved, news).cast(_RANGE).alias("rs"), F.when(m["high"] >= base, F.least(acc["low"], m["low"])).otherwise(acc["low"]).alias("low"))

    return F.aggregate(marks, start, step, lambda acc: acc["rs"])


def _compose(chunks: DataFrame) -> DataFrame:
    """key, chunk, ranges to key, chunk, open (first line of the act that is open at its start) and n (acts before
    that one): one short row for each document."""
    one = chunks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ranges"))).alias("cs"))
    out = "array<struct<chunk:int,open:int,n:int>>"
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("n"), F.array().cast(out).alias("out"))

    def step(acc: Column, c: Column) -> Column:
        hit = F.get(F.filter(c["ranges"], lambda r: _begins(acc["open"], r)), F.lit(0))
        entry = F.struct(c["chunk"].alias("chunk"), acc["open"].alias("open"), acc["n"].alias("n"))
        return let(hit, lambda h: F.struct(F.coalesce(h["open"], acc["open"]).alias("open"), (acc["n"] + F.coalesce(h["n"], F.lit(0))).alias("n"), F.concat(acc["out"], F.array(entry)).cast(out).alias("out")))

    return one.select("key", F.inline(F.aggregate("cs", start, step, lambda acc: acc["out"])))


def acts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """docs(doc_id, filename, reading) to doc_id, filename, ord, act_id, title, text, pages.

    A boundary is an opening, or a process header with a number that the act lacks while it has others, and only if
    something filled stands before it; an act's numbers come from lines that cite nothing. Documents of more than
    `chunk` line feeds are scanned in chunks of so many lines, others in their row; both give the same acts.

    Null and blank texts have no acts; a null doc_id is one like any other, and act_ids of its acts are 'null-1', ...; doc_id names one document
    (store.violations finds others): rows that repeat one each give their acts, and long ones that repeat doc_id,
    filename and text are one; other columns are left behind."""
    feeds = F.coalesce(F.length("reading") - F.length(F.replace("reading", F.lit("\n"), F.lit(""))), F.lit(0))
    keyed = docs.select(F.struct("doc_id", "filename", F.xxhash64("reading").alias("digest")).alias("key"), "reading", feeds.alias("feeds"))
    return _whole(keyed.filter(F.col("feeds") <= chunk)).unionByName(_scanned(keyed.filter(F.col("feeds") > chunk).dropDuplicates(["key"]), chunk))
