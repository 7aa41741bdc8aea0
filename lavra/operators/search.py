"""Search, inverted index, grouping and export of the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import CNJ, UNKNOWN, every, fold, unaccent
from lavra.operators.linking import act_rows, link_parts, variants_of, written

# Columns of the index, short names of classes.
INDEX = ["id", "titulo", "natureza", "classe", "rito", "fase", "tipo", "assunto", "exercicio", "eleicao", "revisao", "origem", "paginas", "arquivo", "duplicata_de", "variantes", "id_documento"]
SHORT = [("anual", "Contas anuais"), ("eleitorais", "Contas eleitorais")]


def plain(markdown: Column) -> Column:
    """Without heading marks and escapes."""
    return F.regexp_replace(F.regexp_replace(markdown, r"(^|\n)#{1,3}\s+", "$1"), r"\\([\\`*_{}\[\]#<>])", "$1")


def page_search(pages: DataFrame, query: str, most: int = 24) -> DataFrame:
    """pages(page, text) whose folded text holds the folded query of 3 characters or more, first pages first:
    a TakeOrdered, never a full sort."""
    if len(query.strip()) < 3:
        return pages.limit(0)
    return pages.filter(fold(plain(F.col("text"))).contains(fold(F.lit(query.strip())))).orderBy("page").limit(most)


def snippet(text: Column, query: str, before: int = 64, after: int = 96) -> Column:
    """The surroundings of the first match, accents and case aside; else the first 180 characters."""
    clean = F.trim(F.regexp_replace(plain(text), r"\s+", " "))
    at = F.instr(F.lower(unaccent(clean)), fold_text(query))
    start = F.greatest(F.lit(1), at - before)
    stop = F.least(F.length(clean) + 1, at + len(query) + after)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(clean, start, stop - start), F.when(stop <= F.length(clean), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(clean, 1, 180))


def fold_text(query: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", query.strip()) if not unicodedata.combining(c)).lower()


def inverted_index(pages: DataFrame) -> DataFrame:
    """pages(page, text) to cnj, pages (ascending)."""
    return pages.select("page", F.explode(F.array_distinct(every(F.col("text"), CNJ, 0, ""))).alias("cnj")).groupBy("cnj").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def slug(value: Column) -> Column:
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(value), r"[\[\]]", ""), "[^a-z0-9]+", "-"), r"^-|-\z", "")
    return F.when((folded == "") | (folded == "nao-identificado"), "a-classificar").otherwise(F.substring(folded, 1, 60))


def export_path(classe: Column, rito: Column, fase: Column, act_id: Column) -> Column:
    return F.concat(F.lit("modelos/"), F.concat_ws("/", slug(classe), slug(rito), slug(fase), slug(act_id)), F.lit(".md"))


def csv_cell(value: Column) -> Column:
    """Quoted if it holds a quote, a comma or a line feed; a carriage return alone does not count."""
    return F.when(value.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def short_class(value: Column) -> Column:
    out = F.when(value.contains(SHORT[0][0]), SHORT[0][1]).when(value.contains(SHORT[1][0]), SHORT[1][1])
    return out.when(value == "representação", "Representações").when(value == UNKNOWN, "A classificar").otherwise(value)


def pages_label(pages: Column) -> Column:
    one = F.concat(F.lit("Página "), F.get(pages, F.lit(0)).cast("string"))
    many = F.concat(F.lit("Páginas "), F.get(pages, F.lit(0)).cast("string"), F.lit("–"), F.element_at(pages, -1).cast("string"))
    return F.when(F.size(pages) == 0, "Página não marcada").when(F.size(pages) == 1, one).otherwise(many)


def linked(acts: DataFrame) -> DataFrame:
    """classified acts with duplicate_of and variants. The acts are read several times, hence written once; the long lists
    are made last, so that they are not shuffled."""
    kept = written(acts, "acts")
    parts, lists = link_parts(act_rows(kept), "key")
    told = kept.join(parts.select("key.doc_id", "key.ord", F.col("duplicate_of.act_id").alias("duplicate_of"), "rep", "bound", "more"), ["doc_id", "ord"])
    keys = variants_of(F.col("bound"), F.col("all"), F.col("more"))
    variants = F.coalesce(F.transform(keys, lambda x: x["act_id"]), F.array().cast("array<string>"))
    return told.join(lists, "rep", "left").select(*kept.columns, "duplicate_of", variants.alias("variants"))


def index_rows(acts: DataFrame) -> DataFrame:
    """linked acts as lines of the CSV index."""
    cells = [
        "act_id", "title", "nature", "classe", "rito", "fase", "tipo", "assunto", "exercicio", "eleicao", F.lit("pendente"), "filename",
        F.coalesce(F.nullif(F.array_join(F.transform("pages", lambda p: p.cast("string")), " "), F.lit("")), F.lit("sem-pagina")),
        export_path(F.col("classe"), F.col("rito"), F.col("fase"), F.col("act_id")), F.coalesce("duplicate_of", F.lit("")), F.array_join("variants", " "), "document_id",
    ]
    return acts.select("act_id", F.concat_ws(",", *[csv_cell(F.col(c) if isinstance(c, str) else c) for c in cells]).alias("line"))


def gaps(acts: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One line for each field without a value."""
    fields = F.array(*[F.struct(F.lit(label).alias("label"), F.col(k).alias("value")) for k, label in labels.items()])
    open_ = F.filter(fields, lambda x: x["value"] == UNKNOWN)
    return acts.select("act_id", F.explode(F.transform(open_, lambda x: x["label"])).alias("label"))


def weighted_median(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """The least value at which the running weight reaches half of the group's; values are summed first, so
    that a large group is sorted by its distinct values only."""
    from pyspark.sql import Window

    sums = rows.groupBy(by, value).agg(F.sum(weight).alias("w"))
    up = Window.partitionBy(by).orderBy(value)
    run = sums.select(by, value, F.sum("w").over(up).alias("run"), F.sum("w").over(Window.partitionBy(by)).alias("total"))
    return run.filter(F.col("run") >= F.col("total") / 2).groupBy(by).agg(F.min(value).alias("median"))


def list_filter(acts: DataFrame, query: str = "", classe: str = "", rito: str = "") -> DataFrame:
    """classified acts whose title and text hold the query (trimmed, case aside, accents not) and whose classe and
    rito are those named; what is empty asks for nothing."""
    needle = query.strip().lower()
    out = acts.filter(F.lower("blob").contains(needle)) if needle else acts
    for key, value in (("classe", classe), ("rito", rito)):
        out = out.filter(F.col(key) == value) if value else out
    return out


def by_class(acts: DataFrame) -> DataFrame:
    """classe, n and act_ids in the order of the archive. Ids only: of a classe with very many acts use `menu`."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "ord", "act_id"))), lambda x: x["act_id"])
    return acts.groupBy("classe").agg(F.count("*").cast("int").alias("n"), ids.alias("act_ids"))


def menus(acts: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of each column (menu) with their place in order of first occurrence, in one pass."""
    from pyspark.sql import Window

    each = acts.select("doc_id", "ord", F.explode(F.array(*[F.struct(F.lit(c).alias("menu"), F.col(c).alias("value")) for c in columns])).alias("m"))
    seen = each.groupBy("m.menu", "m.value").agg(F.min(F.struct("doc_id", "ord")).alias("at"))
    return seen.select("value", F.row_number().over(Window.partitionBy("menu").orderBy("at")).alias("place"), "menu")


def menu(acts: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column with their place in order of first occurrence."""
    return menus(acts, column).select("value", "place")


def process_search(index: DataFrame, query: str, most: int = 12) -> DataFrame:
    """The first process numbers of an index (cnj, pages) that hold the query, by first page, then number; none
    for a query of fewer than three characters."""
    needle = fold_text(query)
    rows = index.select("cnj", F.get("pages", F.lit(0)).alias("first_page"))
    return rows.filter(F.lower("cnj").contains(needle)).orderBy("first_page", "cnj").limit(most) if len(needle) >= 3 else rows.limit(0)


def focus(docs: DataFrame, text: str, number: str) -> DataFrame:
    """docs that hold the number, with what stands before its first occurrence, the match, and what follows."""
    at = F.instr(F.col(text), number)
    found = docs.drop("before", "match", "after").filter(F.col(text).contains(number))
    return found.select("*", F.substring(text, F.lit(1), at - 1).alias("before"), F.lit(number).alias("match"), F.substring(text, at + len(number), F.length(text)).alias("after"))


def convert_stats(slices: DataFrame) -> DataFrame:
    """page_slices to doc_id, pages, chars, headings and likely_scan (fewer than 20 characters a page)."""
    headings = F.sum(F.regexp_count("text", F.lit(r"(?m)^#{1,6} "))).alias("headings")
    counted = slices.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), headings)
    return counted.withColumn("likely_scan", F.col("chars") / F.col("pages") < 20)
