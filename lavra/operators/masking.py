"""Templates (masking of what belongs to one case), quality reports, kept metadata and editorial findings."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import CNJ, distinct_matches, every, has, let, replace, trim

# Citations and the ordered replacements of a paragraph (pattern, text, flags).
CITATION = r"jurisprud[êe]ncia|precedente|citad[oa]s?\b|Rel\.\s"
MASKS = [
    (CNJ, "[PROCESSO]", ""),
    (r"\b\d{1,2}/\d{1,2}/\d{4}\b", "[DATA]", ""),
    (r"R\$\s*[\d.]+,\d{2}", "[VALOR]", ""),
    (r"(elei[çc][õo]es\s+)\d{4}", "$1[ELEIÇÃO]", "iu"),
    (r"(exerc[íi]cio(?:\s+financeiro)?(?:\s+de)?\s*)\d{4}", "$1[EXERCÍCIO]", "iu"),
    (r"(munic[íi]pio(?:\s+de)?\s*:?\s*)([A-ZÁÉÍÓÚÂÊÔÃÕÇ][\p{L}\s]{2,40})", "$1[MUNICÍPIO]", "iu"),
    (r"(?:Ju[íi]zo da\s+)?\d+ª\s+Zona Eleitoral(?:\s+de\s+[A-ZÁÉÍÓÚÂÊÔÃÕÇ][\p{L}\s]{2,40})?", "[ÓRGÃO]", "iu"),
    (r"Tribunal Regional Eleitoral(?:\s+d[oe]\s+[\p{L}]+){0,3}", "[ÓRGÃO]", "iu"),
    (r"\bID(?:\s+do documento)?\s*[:nº°]*\s*[A-Z0-9-]{5,}", "[ID_DOCUMENTO]", "iu"),
    (r"((?:requerente|requerido|interessado(?:\(a\))?|candidato|partido|coliga[çc][ãa]o)\s*:\s*)[^\n\r]+", "$1[PARTE]", "iu"),
]
PLACEHOLDER = r"\[[A-ZÁÉÍÓÚ_]+\]"
PRESERVED = {
    "orgao": (r"(?:Tribunal Regional Eleitoral[^\n]{0,60}|\d+ª\s+Zona Eleitoral[^\n]{0,40}|Ju[íi]zo da[^\n]{0,60})", "iu"),
    "datas": (r"\b\d{1,2}/\d{1,2}/\d{4}\b", ""),
    "edicao": (r"(?:Ano\s+\d{4}[^\n]{0,40}|Diário da Justiça[^\n]{0,80}|n[ºo°]\s*\d{1,4})", "iu"),
    "processos": (CNJ, ""),
    "assinaturas": (r"(?:[Aa]ssinado[^\n]{0,80}|Documento assinado digitalmente[^\n]{0,40})", ""),
}
NO_MARK, RISK_COLUMNS, RISK_TABLE, RISK_ILLEGIBLE = "texto sem página", ": possível leitura em colunas", ": tabela com colunas irregulares", ": trecho com caracteres ilegíveis"
AMBIGUOUS = r"providencie-se o necess[áa]rio|tome-se as provid[êe]ncias cab[íi]veis"


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n{2,}")


#: What a match of some of MASKS and PRESERVED can begin with, where their text does not tell it plainly.
_BEGIN = {
    MASKS[1][0]: "0123456789", MASKS[3][0]: "Ee", MASKS[4][0]: "Ee", MASKS[5][0]: "Mm", MASKS[6][0]: "Jj0123456789", MASKS[9][0]: "RrIi\u0130\u0131CcPp",
    PRESERVED["orgao"][0]: "Tt0123456789Jj", PRESERVED["edicao"][0]: "AaDdNn",
}


#: Plain parts of every match, in lower case (`MASKS` in their order; ıd and i̇d match ID too) and of letters that no others match
#: when case is ignored. None of them comes up by a replacement of MASKS that went before.
_HOLDS = [["-"], ["/"], ["r$"], ["ele"], ["exerc"], ["mun"], ["zona ele"], ["bunal reg"], ["id", "\u0131d", "i\u0307d"], [":"]]
_CITES = ["jur", "precedente", "tad", "rel."]


def mask_paragraph(p: Column) -> Column:
    """A pattern is tried only on paragraphs that hold the plain parts of its matches."""
    sees = lambda low, parts: reduce(operator.or_, [low.contains(x) for x in parts])
    tried = lambda low, parts, mask_: lambda x: F.when(sees(low, parts), replace(x, *mask_, _BEGIN.get(mask_[0], ""))).otherwise(x)

    def masked(low: Column) -> Column:
        out = p
        for mask_, parts in zip(MASKS, _HOLDS, strict=True):
            out = let(out, tried(low, parts, mask_))
        return F.when(sees(low, _CITES) & has(p, CITATION), p).otherwise(out)

    return let(F.lower(p), masked)


def mask(text: Column) -> Column:
    return F.array_join(F.transform(paragraphs(text), mask_paragraph), "\n\n")


def placeholders(text: Column) -> Column:
    """[ELEIÇÃO] and [ÓRGÃO] are not among them: the pattern has neither Ã nor Ç."""
    return distinct_matches(text, PLACEHOLDER, 0, "")


def fill_from(templates: DataFrame, fills: DataFrame, key: str = "act_id") -> DataFrame:
    """templates(key, template) with the values of fills(key, token, value) put for their tokens, in order of the tokens.
    Blank and null values leave the token; of values of one token the least counts; acts without fills keep their
    template; fills of no act are passed over."""
    each = fills.filter(trim(F.col("value")) != "").groupBy(key, "token").agg(F.min("value").alias("value"))
    listed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token", "value"))).alias("fills__"))
    some = F.coalesce("fills__", F.array().cast("array<struct<token:string,value:string>>"))
    put = F.aggregate(some, F.col("template"), lambda acc, x: F.replace(acc, x["token"], x["value"]))
    return templates.join(listed, key, "left").withColumn("template", put).drop("fills__")


def fill(text: Column, fills: dict[str, str]) -> Column:
    """Put values for placeholders; blank values leave the token."""
    for token, value in fills.items():
        if value.strip():
            text = F.replace(text, F.lit(token), F.lit(value))
    return text


def illegible(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    bad = F.regexp_count(text, F.lit("[�¿]"))
    return (F.length(text) > 40) & ((bad > 4) | (letters / F.length(text) < 0.35))


def irregular_table(text: Column) -> Column:
    rows = F.filter(F.split(text, "\n"), lambda x: trim(x).startswith("|"))
    counts = F.transform(rows, lambda x: F.size(F.split(x, r"\|")))
    return (F.size(counts) >= 2) & (F.size(F.array_distinct(counts)) > 1)


def quality_pages(slices: DataFrame) -> DataFrame:
    """page_slices with empty, columns, damaged and illegible."""
    text = F.col("text")
    return slices.select(
        "*", (F.col("page").isNotNull() & (F.length(text) < 15)).alias("empty"), F.col("note").contains("2 colunas").alias("columns"), irregular_table(text).alias("damaged"), illegible(text).alias("illegible")
    )


def quality_docs(slices: DataFrame) -> DataFrame:
    """One report for each document: pages_processed (null without page marks), empty_pages, risks, damaged
    tables, illegible places, needs_ocr and integral. columns_detected and likely_scan may come with the
    slices; missing or null they are false. Slices without page mark are told as such."""
    for flag in ("columns_detected", "likely_scan"):
        slices = slices if flag in slices.columns else slices.withColumn(flag, F.lit(False))
    q = quality_pages(slices).withColumn("columns", F.col("columns") | F.coalesce("columns_detected", F.lit(False)))
    page = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("page"))))
    where = F.when(F.col("page").isNull(), NO_MARK).otherwise(F.concat(F.lit("página "), F.col("page").cast("string")))
    told = lambda flag, text: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("slice_ord", where.alias("w"))))), lambda x: F.concat(x["w"], F.lit(text))))
    marked, scan = F.bool_or(F.col("page").isNotNull()), F.bool_or(F.coalesce("likely_scan", F.lit(False)))
    return q.groupBy("doc_id").agg(
        F.when(marked, F.count("*")).alias("pages_processed"), page("empty").alias("empty_pages"), told("columns", RISK_COLUMNS).alias("risks"),
        told("damaged", RISK_TABLE).alias("damaged_tables"), told("illegible", RISK_ILLEGIBLE).alias("illegible_places"),
        F.when(scan, F.array_sort(F.collect_list("page"))).otherwise(page("empty")).alias("needs_ocr"),
        (marked & ~F.bool_or("empty") & ~F.bool_or("illegible") & ~scan).alias("integral"),
    )


def preserved(text: Column, key: str) -> Column:
    """All distinct matches, trimmed, in the order of the text."""
    pattern, flags = PRESERVED[key]
    return F.array_distinct(F.transform(every(text, pattern, 0, flags, _BEGIN.get(pattern, "")), trim))


def long_paragraph(text: Column) -> Column:
    """The first paragraph of more than 900 characters, null if none."""
    long = lambda ps: F.filter(ps, lambda p: F.length(p) > 900)
    return F.get(long(F.transform(long(paragraphs(text)), trim)), F.lit(0))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """The first line (trimmed, over 40 characters) that a text holds three times or more: doc_id, line, n."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", "at", trim(F.col("line")).alias("line")).filter(F.length("line") > 40)
    counted = rows.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.min("at").alias("at")).filter("n >= 3")
    return counted.groupBy("doc_id").agg(F.min_by(F.struct("line", "n"), "at").alias("x")).select("doc_id", "x.line", "x.n")
