"""Classification of acts by ordered rules with evidence.

The rules are data: a value, the patterns that must all match and those that must not. `case` turns a list
into a first-match-wins column, `case_sql` into the same SQL for another engine."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import CNJ, UNKNOWN, around, distinct_matches, every, first, has, labelled, let, openings, squeeze, trim

from .segment import CITATION, CNJ_CHARS


class Rule(NamedTuple):
    value: str
    match: str
    unless: str = ""
    flags: str = "iu"
    evidence: str = ""


# The rules of classification.
CLASSE = [
    Rule("cumprimento de sentença", r"cumprimento de senten[çc]a", evidence=r"cumprimento de senten[çc]a[^\n]{0,80}"),
    Rule("prestação de contas anual partidária", r"presta[çc][ãa]o de contas anual|contas do [óo]rg[ãa]o partid[áa]rio|\bPCA\b", r"contas eleitorais|contas de campanha", evidence=r"presta[çc][ãa]o de contas anual|PCA|órgão partidário"),
    Rule("prestação de contas eleitorais", r"presta[çc][ãa]o de contas eleitorais|contas de campanha"),
    Rule("AIJE", r"\bAIJE\b", r"originad", ""),
    Rule("AIME", r"\bAIME\b", "", ""),
    Rule("registro de candidatura", r"registro de candidatura|\bRRC\b|\bDRAP\b"),
    Rule("representação", r"representa[çc][ãa]o", evidence=r"representa[çc][ãa]o[^\n]{0,80}"),
    Rule("matéria criminal eleitoral", r"a[çc][ãa]o penal|crime eleitoral|art\.\s*299"),
]
FASE = [
    Rule("cumprimento", r"cumprimento de senten[çc]a"),
    Rule("execução", r"fase de execu[çc][ãa]o|\bem execu[çc][ãa]o\b", evidence=r"execu[çc][ãa]o"),
    Rule("conhecimento", r"\bconhecimento\b"),
    Rule("instrução", r"\binstru[çc][ãa]o\b"),
    Rule("julgamento", r"\bjulgamento\b"),
]
RESULTADO = [
    Rule("improcedente", r"julgo improcedente"),
    Rule("procedente", r"julgo procedente"),
    Rule("extinção", r"extin[çc][ãa]o do processo|extingo o processo"),
]
GRAU = [Rule("primeiro grau", r"1[ºo°]\s*grau|zona eleitoral|ju[íi]z eleitoral"), Rule("segundo grau", r"\bTRE\b|tribunal regional eleitoral")]
GRAU_EVIDENCE = r"1[ºo°]\s*grau|zona eleitoral|ju[íi]z eleitoral|Tribunal Regional Eleitoral"
AREA = [Rule("eleitoral", r"eleitoral|zona eleitoral|cand[ií]dat|presta[çc][ãa]o de contas|AIJE|AIME|sufr[áa]gio")]
AREA_EVIDENCE = r"eleitoral|zona eleitoral|AIJE|AIME|presta[çc][ãa]o de contas"
ASSUNTO = [
    r"capta[çc][ãa]o il[íi]cita(?:\s+de sufr[áa]gio)?",
    r"propaganda(?:\s+(?:irregular|antecipada|eleitoral)){1,3}",
    r"pesquisa eleitoral",
    r"doa[çc][ãa]o(?:\s+eleitoral)?",
]
ORIGIN = r"originad[oa]\s+d[aeo]\s+([^\n.]{3,80})"
RITO = r"rito\s+(ordin[áa]rio|sumar[íi]ssimo|especial|sum[áa]rio)"
TIPO_TITLE = (
    r"^(extrato(?:\s+de\s+\p{L}+)?|despacho|senten[çc]a|decis[ãa]o|certid[ãa]o|parecer|peti[çc][ãa]o|edital|modelo|representa[çc][ãa]o"
    r"|presta[çc][ãa]o de contas[^\n]{0,40}|cumprimento de senten[çc]a)"
)
TIPO_LINE = r"(?:^|\n)(extrato(?:\s+de\s+\p{L}+)?|despacho|senten[çc]a|decis[ãa]o|certid[ãa]o|parecer|peti[çc][ãa]o)"
ORGAO = r"((?:\d+ª\s+Zona Eleitoral|Ju[íi]zo da)[^\n]{0,50}|Tribunal Regional Eleitoral[^\n]{0,40})"
EXERCICIO = r"exerc[íi]cio(?:\s+financeiro)?(?:\s+de)?\s*(\d{4})"
ELEICAO = r"elei[çc][õo]es\s+(\d{4})"
NORMS = r"\b(?:Lei|LC|Resolu[çc][ãa]o(?:\s+TSE)?)\s+n[ºo°.]?\s*[\d.]+(?:/\d{2,4})?"
FINAL = [(r"intime-se", "intimar"), (r"julgo\b", "julgar")]
DOCUMENT_ID = r"\bID(?:\s+do documento)?\s*[:nº°]\s*([A-Z0-9-]{4,})"
PRINTED = r"\b(?:p[áa]gina|fls?\.?)\s+(\d{1,4})\b"
NATURE_MODEL = r"(?:^|\n)modelo\b"
NATURE_SUPPORT = r"material de apoio|nota de estudo|roteiro interno"
NATURE_EXTRACT = (r"(?:^|\n)extrato\b", r"\bextrato de\b")
NATURE_INCOMPLETE = r"\.\.\.\s*$|\[\s*trecho|continua na página|documento incompleto"
VOICE = [
    Rule("parecer", r"parecer"),
    Rule("parte", r"peti[çc][ãa]o|requerente pede|vem .* requerer"),
    Rule("juízo", r"despacho|senten[çc]a|decis[ãa]o|ac[óo]rd[ãa]o|certid[ãa]o|intime-se|julgo\b"),
]
LABELS = {
    "area": "Área", "classe": "Ação ou classe", "subtipo": "Subtipo", "assunto": "Assunto", "rito": "Rito", "fase": "Fase", "tipo": "Tipo de ato",
    "finalidade": "Finalidade", "resultado": "Resultado", "orgao": "Órgão", "grau": "Grau", "exercicio": "Exercício", "eleicao": "Eleição",
    "regime": "Regime citado no texto", "revisao": "Situação da revisão",
}
NO_EVIDENCE = "Sem trecho de apoio."


def case(text: Column, rules: list[Rule], default: str = "") -> Column:
    out = None
    for r in rules:
        hit = has(text, r.match, r.flags) & ((~has(text, r.unless)) if r.unless else F.lit(True))
        out = F.when(hit, r.value) if out is None else out.when(hit, r.value)
    return out.otherwise(default)


def case_sql(column: str, rules: list[Rule], default: str = "") -> str:
    parts = []
    for r in rules:
        flag = "(?i)" if "i" in r.flags else ""
        unless = f" AND NOT regexp_matches({column}, '(?i){r.unless}')" if r.unless else ""
        parts.append(f"WHEN regexp_matches({column}, '{flag}{r.match}'){unless} THEN '{r.value}'")
    return f"CASE {' '.join(parts)} ELSE '{default}' END"


def known(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN))


def _alternatives(pattern: str) -> list[str]:
    depth, out = 0, [""]
    for part in re.findall(r"\\.|.", pattern, re.S):
        depth += (part in "([") - (part in ")]")
        if part == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += part
    return out


def stems(pattern: str) -> list[str]:
    """What the alternatives of a pattern begin with, in lower case; none if one of them begins otherwise or
    has fewer than three plain characters there."""
    out = []
    for x in _alternatives(pattern):
        head = re.match(r"(?:\\b)?([A-Za-zÀ-ÿ ]*)([?*{]?)", x)
        stem = head[1][:-1] if head[2] else head[1]
        if len(stem) < 3:
            return []
        out.append(stem.lower())
    return out


def sees(low: Column, names: list[str]) -> Column:
    return reduce(operator.or_, [low.contains(n) for n in names])


def quick(low: Column, pattern: str) -> Column:
    """`has` for a pattern that ignores case, on the lower-case text: a plain search goes before the pattern, and is all for
    alternatives that are plain."""
    pattern = pattern.replace("AIJE", "aije").replace("AIME", "aime").replace("PCA", "pca").replace("RRC", "rrc").replace("DRAP", "drap").replace("TRE", "tre")
    every_ = _alternatives(pattern)
    plain = [x for x in every_ if re.fullmatch(r"[a-zà-ÿ -]+", x)]
    plain = [x for x in plain if not any(y != x and y in x for y in plain)]  # found by a shorter one
    rest = "|".join(x for x in every_ if not re.fullmatch(r"[a-zà-ÿ -]+", x))
    if not rest:
        return sees(low, plain)
    hit = has(low, rest, "", openings(rest))
    hit = sees(low, stems(rest)) & hit if stems(rest) else hit
    return sees(low, plain) | hit if plain else hit


def quick_case(text: Column, low: Column, rules: list[Rule], default: str = "") -> Column:
    """`case` with `quick` wherever case does not matter."""
    out = None
    for r in rules:
        hit = quick(low, r.match) if "i" in r.flags else sees(low, stems(r.match)) & has(text, r.match, r.flags)
        hit = hit & ~quick(low, r.unless) if r.unless else hit
        out = F.when(hit, r.value) if out is None else out.when(hit, r.value)
    return out.otherwise(default)


def classified(acts: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """acts with blob, nature, voice, the fifteen values (UNKNOWN where a rule finds none), cnj, document_id
    and printed_pages; or with `blob` and those of them that `only` names, which saves the patterns of the others.

    A null text or title counts as empty. Columns of the input that have the name of a value are replaced;
    repeated rows are classified each; an empty table gives an empty result. Each pattern is looked for once:
    the raw values go through an explode of one element, which keeps the optimiser from writing their
    expressions out again wherever a value is used."""
    new = ["blob", *LABELS, "nature", "voice", "cnj", "document_id", "printed_pages"]
    df = acts.drop(*new).withColumn("title", F.coalesce("title", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    kept = df.columns
    base = F.concat_ws("\n", "title", "text")
    df = df.select(*kept, F.explode(F.array(F.struct(base.alias("blob"), F.lower(base).alias("low")))).alias("b")).select(*kept, "b.blob", "b.low")
    blob, low, title, text = F.col("blob"), F.col("low"), F.col("title"), F.col("text")
    when_seen = lambda names, c: F.when(sees(low, names), c).otherwise("")
    label = lambda name: when_seen([name.lower()], labelled(blob, name))
    subject = F.coalesce(*[F.nullif(when_seen(stems(p), first(blob, p)), F.lit("")) for p in ASSUNTO], F.lit(""))
    final = F.when(quick(low, FINAL[0][0]), FINAL[0][1]).when(quick(low, FINAL[1][0]), FINAL[1][1]).when(has(title, r"publica-se|extrato"), "publicar extrato").otherwise("")
    norms = F.when(sees(low, ["lei", "lc", "resolu"]), F.slice(F.array_distinct(F.transform(every(blob, NORMS, ahead="LlRr"), squeeze)), 1, 8)).otherwise(F.array().cast("array<string>"))
    otherwise = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), d)
    origin = trim(when_seen(["originad"], first(blob, ORIGIN, 1)))
    raw = {
        "area": quick_case(blob, low, AREA),
        "classe": otherwise(label("Classe"), quick_case(blob, low, CLASSE)),
        "subtipo": F.coalesce(F.concat(F.lit("originado de "), F.nullif(origin, F.lit(""))), F.lit("")),
        "assunto": subject,
        "rito": otherwise(when_seen(["rito"], first(blob, RITO, 1)), label("Rito")),
        "fase": quick_case(blob, low, FASE),
        "tipo": trim(otherwise(first(trim(title), TIPO_TITLE), first(blob, TIPO_LINE, 1))),
        "finalidade": final,
        "resultado": quick_case(blob, low, RESULTADO),
        "orgao": trim(when_seen(["zona eleitoral", "juízo da", "juizo da", "tribunal regional eleitoral"], first(blob, ORGAO))),
        "grau": quick_case(blob, low, GRAU),
        "exercicio": when_seen(["exerc"], first(blob, EXERCICIO, 1)),
        "eleicao": when_seen(["elei"], first(blob, ELEICAO, 1)),
        "regime": F.array_join(norms, "; "),
        "document": when_seen(["id"], first(text, DOCUMENT_ID, 1)),
    }
    wanted = list(new if only is None else only)
    needs = {"document_id": ["document"], "revisao": ["classe", "tipo", "fase"]}
    asked = {k for w in wanted for k in needs.get(w, [w])}
    raw = {k: c for k, c in raw.items() if k in asked}
    if raw:
        df = df.select(*kept, "blob", "low", F.explode(F.array(F.struct(*[c.alias(k) for k, c in raw.items()]))).alias("raw"))
        df = df.select(*kept, "blob", "low", *[known(F.col("raw")[k]).alias(k) for k in raw])
    missing = (F.col("classe") == UNKNOWN) | (F.col("tipo") == UNKNOWN) | (F.col("fase") == UNKNOWN)
    # a line is long enough and holds a number before it is asked whether it cites
    numbered = F.filter(F.split("text", "\n"), lambda x: (F.length(x) >= CNJ_CHARS) & has(x, CNJ, "") & ~has(x, CITATION))
    rest = {
        "revisao": lambda: F.when(missing, "pendente").otherwise("aguardando confirmação humana"),
        "nature": lambda: nature(title, text, low),
        "voice": lambda: voice(title, text, low),
        "cnj": lambda: F.array_distinct(F.flatten(F.transform(numbered, lambda x: every(x, CNJ, 0, "")))),
        "document_id": lambda: F.col("document"),
        "printed_pages": lambda: distinct_matches(text, PRINTED, 1, ahead="PpFf"),
    }
    columns = [k for k in raw if k in wanted], [make().alias(k) for k, make in rest.items() if k in wanted]
    return df.select(*kept, "blob", *columns[0], *columns[1])


#: Plain parts of every match, of letters that no others match when case is ignored, for the patterns of nature and voice.
_MODEL_HAS, _SUPPORT_HAS, _EXTRACT_HAS, _INCOMPLETE_HAS = ["modelo"], ["mater", "nota de e", "rote"], ["extrato"], ["...", "trecho", "nua na p", "documento "]
_VOICE_HAS = {"parecer": ["parecer"], "parte": ["pet", "requere"]}


def nature(title: Column, text: Column, low: Column) -> Column:
    """low: title and text in lower case, searched before the patterns are tried."""
    head = F.concat(title, F.lit("\n"), F.substring(text, 1, 500))
    compact = ~text.rlike(r"^(?:\s*+\S){40}")  # fewer than 40 characters beside white space
    return (
        F.when(sees(low, _MODEL_HAS) & (has(title, NATURE_MODEL) | has(F.substring(text, 1, 200), NATURE_MODEL)), "modelo")
        .when(sees(low, _SUPPORT_HAS) & has(head, NATURE_SUPPORT), "apoio")
        .when(sees(low, _EXTRACT_HAS) & (has(title, NATURE_EXTRACT[0]) | has(head, NATURE_EXTRACT[1])), "extrato")
        .when(compact | (sees(low, _INCOMPLETE_HAS) & has(text, NATURE_INCOMPLETE, ahead=".[CcDd")), "incompleto")
        .otherwise("ato")
    )


def voice(title: Column, text: Column, low: Column) -> Column:
    """low: title and text in lower case, searched before the patterns are tried."""
    head, out = F.concat(title, F.lit("\n"), F.substring(text, 1, 240)), None
    for r in VOICE:
        hit = has(head, r.match, r.flags)
        hit = sees(low, _VOICE_HAS[r.value]) & hit if r.value in _VOICE_HAS else hit
        out = F.when(hit, r.value) if out is None else out.when(hit, r.value)
    return out.otherwise("não identificada")


# What a value of each field is called when found, how it was found, and its evidence.
FOUND, SUGGESTED, UNDECIDED, BY_RULE, BY_FIELD = "identificada", "sugerida", "indeterminada", "regra local", "campo expresso"
REVIEW_EVIDENCE = "Revisão humana ainda não registrada."
SUBJECT_EVIDENCE = r"originad[oa]\s+d[aeo]\s+[^\n.]{3,80}"
RITO_EVIDENCE = r"rito\s+[^\n]{0,40}"
FINAL_EVIDENCE = r"intime-se|julgo|publica-se"
CLASS_LINE = r"Classe\s*:[^\n]+"


def origin_of(filename: Column, pages: Column) -> Column:
    marked = F.concat(F.lit("página "), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "))
    return F.concat_ws(" · ", filename, F.when(F.size(pages) > 0, marked).otherwise("página não marcada"))


def _near(text: Column, low: Column, value: Column, before: int = 40, after: int = 80) -> Column:
    """`around` for a value in place of a pattern."""

    def cut(at: Column) -> Column:
        start = F.greatest(F.lit(1), at - before)
        return F.when(at > 0, squeeze(F.substring(text, start, at + F.length(value) + after - start))).otherwise("")

    return let(F.instr(low, F.lower(value)), cut)


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are worked out once, however often they are used after."""
    told = df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("once__"))
    return told.select(*df.columns, *[F.col("once__")[k].alias(k) for k in columns])


def evidence(df: DataFrame, only: Iterable[str] | None = None, quoted: bool = True) -> DataFrame:
    """classified acts with `fields`: key, label, value, status, method, evidence and origin of each of the
    fifteen values, in their order, or of those that `only` names. filename and pages name the origin. Unless quoted,
    the evidence is left out. A quotation is looked for once, and only of a value that is there."""
    blob, low, expressed = F.col("blob"), F.col("low__"), F.col("expressed__")
    none = lambda key: F.col(key) == UNKNOWN
    wanted = [k for k in LABELS if only is None or k in only]

    def of(rules: list[Rule], key: str) -> Column:
        out = F.lit("")
        for r in rules:
            out = F.when(F.col(key) == r.value, around(blob, r.evidence or r.match)).otherwise(out)
        return out

    rito_by_rule = F.col("rito") == first(blob, RITO, 1)
    quotes = {
        "area": lambda: around(blob, AREA_EVIDENCE),
        "classe": lambda: F.when(expressed, around(blob, CLASS_LINE)).otherwise(of(CLASSE, "classe")),
        "subtipo": lambda: around(blob, SUBJECT_EVIDENCE),
        "assunto": lambda: _near(blob, low, F.col("assunto")),
        "rito": lambda: around(blob, RITO_EVIDENCE),
        "fase": lambda: of(FASE, "fase"),
        "tipo": lambda: F.col("tipo"),
        "finalidade": lambda: around(blob, FINAL_EVIDENCE),
        "resultado": lambda: of(RESULTADO, "resultado"),
        "orgao": lambda: F.col("orgao"),
        "grau": lambda: around(blob, GRAU_EVIDENCE),
        "exercicio": lambda: first(blob, EXERCICIO),
        "eleicao": lambda: first(blob, ELEICAO),
        "regime": lambda: F.split_part("regime", F.lit("; "), F.lit(1)),
        "revisao": lambda: F.lit(REVIEW_EVIDENCE),
    }
    how = {
        "area": (FOUND, BY_RULE),
        "classe": (F.when(expressed, FOUND).otherwise(SUGGESTED), F.when(expressed, BY_FIELD).otherwise(BY_RULE)),
        "rito": (SUGGESTED, F.when(~none("rito") & ~rito_by_rule, BY_FIELD).otherwise(BY_RULE)),
        "tipo": (FOUND, BY_FIELD),
        "resultado": (FOUND, F.when(none("resultado"), BY_RULE).otherwise(BY_FIELD)),
        "orgao": (FOUND, BY_FIELD),
        "exercicio": (FOUND, BY_FIELD),
        "eleicao": (FOUND, BY_FIELD),
        "regime": (FOUND, BY_FIELD),
        "revisao": (F.when(F.col("revisao") == "pendente", UNDECIDED).otherwise(SUGGESTED), BY_RULE),
    }
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    df = df.drop("fields")
    kept = df.columns
    # what several quotations need, then the quotations, then the fields
    shared = {"origin__": origin_of(F.col("filename"), F.col("pages"))}
    shared |= {"expressed__": let(F.lower(blob), lambda x: x.contains("cla") & (labelled(blob, "Classe") != ""))} if "classe" in wanted else {}
    shared |= {"low__": F.lower(blob)} if quoted and "assunto" in wanted else {}
    told = _once(df, shared)
    if quoted:
        told = _once(told, {f"quote__{k}": F.when(none(k), NO_EVIDENCE).otherwise(quotes[k]()) for k in wanted})

    def field(key: str) -> Column:
        status, method = how.get(key, (SUGGESTED, BY_RULE))
        quote = [F.when(F.col(f"quote__{key}") != "", F.col(f"quote__{key}")).otherwise(NO_EVIDENCE).alias("evidence")] if quoted else []
        return F.struct(
            F.lit(key).alias("key"), F.lit(LABELS[key]).alias("label"), F.col(key).alias("value"), F.when(none(key), UNDECIDED).otherwise(column(status)).alias("status"),
            column(method).alias("method"), *quote, F.col("origin__").alias("origin"),
        )

    return told.select(*kept, F.explode(F.array(F.array(*map(field, wanted)))).alias("fields"))


def known_or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def field_value(fields: Column, key: str) -> Column:
    """The value of the first field of a key; UNKNOWN if there is none."""
    return F.coalesce(F.get(F.filter(fields, lambda x: x["key"] == key), F.lit(0))["value"], F.lit(UNKNOWN))
