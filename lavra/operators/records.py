"""Records built on classified acts: templates with limits and what is pending, findings with their texts,
changes of acts (split, merge, field update, undo).

Null texts count as empty; repeated acts get a record each; empty tables give empty results; columns named
template, limits, pending, fields or item are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lavra.functions.text import CNJ, UNKNOWN, first, has, let, trim
from lavra.operators import masking as M
from lavra.operators.classify import FOUND, LABELS, UNDECIDED, classified, evidence, origin_of

# Sentences of a template.
LIMIT_ALWAYS = "Não transpor órgão, município, exercício, eleição ou competência deste texto para outro caso."
LIMIT_NATURE = {
    "extrato": "Extrato de publicação. Não é a decisão integral e não deve ser usado como modelo completo.",
    "incompleto": "Documento incompleto. Não fechar modelo enquanto houver lacuna de texto.",
}
LIMIT_CLASS = {
    "prestação de contas anual partidária": "Não usar para prestação de contas eleitorais ou de campanha.",
    "prestação de contas eleitorais": "Não usar para prestação de contas anual de órgão partidário.",
    "cumprimento de sentença": "Não usar como peça da ação que originou a execução.",
}
PENDING_ALWAYS = "Verificação jurídica pendente: vigência normativa e jurisprudência não foram conferidas em fonte oficial."
PENDING_EXTRACT = "Não reconstruir a decisão a partir do extrato."
REQUIREMENTS = [
    "Conferir a classe e a fase no processo de destino.", "Preencher os campos entre colchetes.", "Não aproveitar fato de outro processo como afirmação geral.",
]
PURPOSE_EXTRACT = "Referência de publicação, não modelo de decisão."
NO_PAGE = "página não marcada no Markdown"
NO_FIELD = "Nenhum campo marcado."
# Proposal and reason of each finding.
FINDINGS = {
    "Parágrafo longo": ("editorial", "média", "Quebrar em blocos: relatório, fundamento, dispositivo.", "Trecho acima de 900 caracteres dificulta a releitura."),
    "Repetição": ("editorial", "baixa", "Manter uma ocorrência.", "A mesma frase aparece %d vezes."),
    "Comando ambíguo": ("editorial", "alta", "Nomear o ato, o destinatário e o prazo.", "O comando não diz o que deve ser feito."),
    "Dispositivo contraditório": ("editorial", "alta", "Deixar um único resultado, ou explicar os pedidos separados.", "Fundamentação e dispositivo apontam resultados opostos."),
    "Processo concreto ainda no modelo": ("editorial", "alta", "Trocar pelo campo [PROCESSO], salvo se for precedente citado.", "O modelo ainda carrega número de processo."),
    "Extrato tratado como decisão": ("jurídica", "alta", "Não promover este texto a modelo integral.", "Publicação resumida não contém a decisão completa."),
    "Classe sem apoio no texto": ("jurídica", "alta", "Classificar na revisão humana ou manter [NÃO IDENTIFICADO].", "Não há campo expresso nem regra local suficiente."),
    "Adequação normativa": (
        "jurídica", "alta", "Não atualizar o texto automaticamente. Conferir a norma em fonte oficial e, se for o caso, gravar uma proposta separada.",
        "Verificação jurídica pendente. Sem link oficial, data de consulta e período de vigência, o modelo histórico permanece como foi extraído.",
    ),
}
# What changes by hand leave behind.
SPLIT_TITLE, BY_REVIEW, REVIEWED, REVIEW_REMOVED = "Trecho dividido", "revisão humana", " Revisão humana.", "Revisão humana removeu o valor."
AMBIGUOUS_EXCERPT = "providencie-se o necessário / providências cabíveis"
RULING_EXCERPT = "julgo procedente / julgo improcedente"


def _texts(*columns: Column) -> Column:
    return F.array_compact(F.array(*columns))


def limits(nature: Column, classe: Column) -> Column:
    """What a template must not be used for."""
    when = lambda c, texts: [F.when(c == k, v) for k, v in texts.items()]
    return _texts(F.lit(LIMIT_ALWAYS), *when(nature, LIMIT_NATURE), *when(classe, LIMIT_CLASS))


def pending(acts: DataFrame) -> Column:
    """What is to be looked up before a template of classified acts is used."""
    open_ = [F.when(F.col(k) == UNKNOWN, f"{label}: {UNKNOWN}") for k, label in LABELS.items() if k in acts.columns]
    return _texts(*open_, F.lit(PENDING_ALWAYS), F.when(F.col("nature") == "extrato", PENDING_EXTRACT))


def templates(acts: DataFrame) -> DataFrame:
    """classified acts (with filename and pages) with `template`: title, purpose, when, fields, text, limits,
    origin, pages, pending, voice."""
    open_tipo, open_classe = F.col("tipo") == UNKNOWN, F.col("classe") == UNKNOWN
    acts = acts.drop("template", "masked").select("*", F.explode(F.array(M.mask(F.col("text")))).alias("masked"))
    kind = F.when(open_tipo, "ato").otherwise(F.lower("tipo"))
    page = F.when(F.size("pages") > 0, F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ")).otherwise(NO_PAGE)
    use = F.concat(F.lit("Somente se a classe for “"), "classe", F.lit("”, a fase for “"), "fase", F.lit("” e o tipo de ato for “"), "tipo", F.lit("”. Conferir fatos e competência antes de reutilizar."))
    purpose = F.concat(F.lit("Referência de "), kind, F.lit(" para caso da mesma classe e fase, depois de revisão."))
    return acts.select(
        *[c for c in acts.columns if c != "masked"],
        F.struct(
            F.concat_ws(" — ", F.when(open_tipo, F.col("title")).otherwise(F.col("tipo")), F.when(open_classe, "a classificar").otherwise(F.col("classe"))).alias("title"),
            F.when(F.col("nature") == "extrato", PURPOSE_EXTRACT).otherwise(purpose).alias("purpose"), use.alias("when"), M.placeholders(F.col("masked")).alias("fields"),
            F.col("masked").alias("text"), limits(F.col("nature"), F.col("classe")).alias("limits"), F.col("filename").alias("origin"), page.alias("pages"),
            pending(acts).alias("pending"), F.col("voice").alias("voice"),
        ).alias("template"),
    )


def template_markdown(acts: DataFrame) -> DataFrame:
    """acts of `templates` with `markdown`: a head of quoted values and the sections."""
    t = lambda k: F.col("template")[k]
    quoted = lambda c: let(F.to_json(F.struct(c.alias("x"))), lambda x: F.substring(x, F.lit(6), F.length(x) - 6))
    bullets = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n")
    head = {"titulo": quoted(t("title")), "natureza": F.col("nature"), "voz": t("voice"), "origem": quoted(t("origin")), "paginas": quoted(t("pages")), "versao": F.lit("1"), "id_documento": quoted(F.col("document_id"))}
    sections = {
        "Quando pode ser usado": t("when"), "Requisitos": bullets(F.array(*map(F.lit, REQUIREMENTS))), "Limites": bullets(t("limits")),
        "Campos": F.when(F.size(t("fields")) > 0, bullets(t("fields"))).otherwise(F.lit(f"- {NO_FIELD}")), "Pendências": bullets(t("pending")), "Texto reutilizável": trim(t("text")),
    }
    lines = [F.lit("---"), *[F.concat(F.lit(f"{k}: "), v) for k, v in head.items()], F.lit("---\n"), F.concat(F.lit("# "), t("title"), F.lit("\n")), F.concat(t("purpose"), F.lit("\n"))]
    lines += [F.concat(F.lit(f"## {k}\n\n"), v, F.lit("\n")) for k, v in sections.items()]
    return acts.drop("markdown").select("*", F.concat_ws("\n", *lines).alias("markdown"))


def repeated_line(text: Column) -> Column:
    """The first trimmed line over 40 characters that occurs three times or more, with its count; null if none.
    Lines are sorted once, and equal ones counted by the places where a run of them begins."""
    long = lambda xs: F.filter(xs, lambda x: F.length(x) > 40)
    run = lambda ordered: F.filter(ordered, lambda x, i: (i >= 2) & (F.get(ordered, i - 2) == x))
    told = lambda lines, line: F.when(line.isNotNull(), F.struct(line.alias("line"), F.size(F.filter(lines, lambda x: x == line)).alias("n")))
    some = lambda lines: let(F.get(F.array_intersect(lines, let(F.array_sort(lines), run)), F.lit(0)), lambda line: told(lines, line))
    return let(long(F.transform(long(F.split(text, "\n")), trim)), lambda lines: F.when(F.size(lines) >= 3, some(lines)))


def findings(acts: DataFrame) -> DataFrame:
    """classified acts (with filename and pages) to act_id, item (m1, m2, ...), kind, problem, excerpt (280
    characters at most), origin, proposal, reason and priority, in order."""
    text, origin = F.col("text"), origin_of(F.col("filename"), F.col("pages"))
    df = acts.select("*", F.explode(F.array(F.struct(M.mask(text).alias("masked"), M.long_paragraph(text).alias("long"), repeated_line(text).alias("rep")))).alias("x_"))
    masked, long, rep = F.col("x_.masked"), F.col("x_.long"), F.col("x_.rep")

    def item(problem: str, hit: Column, excerpt: Column, *args: Column) -> Column:
        kind, priority, proposal, reason = FINDINGS[problem]
        why = F.format_string(reason, *args) if args else F.lit(reason)
        values = {"kind": F.lit(kind), "problem": F.lit(problem), "excerpt": F.substring(excerpt, 1, 280), "origin": origin, "proposal": F.lit(proposal), "reason": why, "priority": F.lit(priority)}
        return F.when(hit, F.struct(*[v.alias(k) for k, v in values.items()]))

    found = F.array(
        item("Parágrafo longo", long.isNotNull(), F.substring(long, 1, 180)),
        item("Repetição", rep.isNotNull(), rep["line"], rep["n"]),
        item("Comando ambíguo", has(text, M.AMBIGUOUS), F.lit(AMBIGUOUS_EXCERPT)),
        item("Dispositivo contraditório", has(text, "julgo procedente") & has(text, "julgo improcedente"), F.lit(RULING_EXCERPT)),
        item("Processo concreto ainda no modelo", has(masked, CNJ, ""), first(masked, CNJ, 0, "")),
        item("Extrato tratado como decisão", F.col("nature") == "extrato", F.substring(text, 1, 160)),
        item("Classe sem apoio no texto", F.col("classe") == UNKNOWN, F.lit("")),
        item("Adequação normativa", F.lit(True), F.col("regime")),
    )
    rows = df.select("act_id", F.posexplode(F.array_compact(found)).alias("at", "x"))
    return rows.select("act_id", F.format_string("m%d", F.col("at") + 1).alias("item"), "x.*")


# ---- changes


def split_acts(acts: DataFrame, at: DataFrame) -> DataFrame:
    """Acts cut before paragraph `k` where at(act_id, k) names one with 0 < k < number of paragraphs, both
    halves classified anew; all other acts as they are. The right half gets the id `<act_id>-b<n + 1>` (n: states
    in `history_n`, 0 if the column is missing) and its first non-blank line, 80 characters at most, as title;
    both halves keep the pages. at: one row for each act."""
    base = acts if "history_n" in acts.columns else acts.withColumn("history_n", F.lit(0))
    parts = M.paragraphs(F.coalesce("text", F.lit("")))
    cut = base.join(at.select("act_id", F.col("k").alias("k__")), "act_id", "left").withColumn("parts__", parts)
    fits = F.coalesce((F.col("k__") > 0) & (F.col("k__") < F.size("parts__")), F.lit(False))
    left = F.array_join(F.slice("parts__", 1, F.greatest(F.col("k__"), F.lit(1))), "\n\n")
    right = F.array_join(F.slice("parts__", F.col("k__") + 1, F.greatest(F.size("parts__") - F.col("k__"), F.lit(0))), "\n\n")
    heading = F.get(F.filter(F.transform(F.split(right, "\n"), trim), lambda x: x != ""), F.lit(0))
    title = F.coalesce(F.substring(heading, 1, 80), F.lit(SPLIT_TITLE))
    half = lambda i, t, h, n: F.struct(i.alias("act_id"), t.alias("title"), h.alias("text"), F.lit(n).alias("half"))
    name = F.concat("act_id", F.lit("-b"), (F.col("history_n") + 1).cast("string"))
    halves = F.when(fits, F.array(half(F.col("act_id"), F.col("title"), left, 1), half(name, title, right, 2))).otherwise(F.array(half(F.col("act_id"), F.col("title"), F.col("text"), 0)))
    rest = [c for c in base.columns if c not in ("act_id", "title", "text", "history_n")]
    rows = cut.select(*rest, (F.col("history_n") + fits.cast("int")).alias("history_n"), F.explode(halves).alias("h__"))
    return classified(rows.select(*rest, "history_n", "h__.*"))


def merge_acts(acts: DataFrame, ids: DataFrame) -> DataFrame:
    """Acts named by ids(act_id) joined with the next of their document (by ord), which goes: text, sorted
    pages, classified anew, and `warning` where both hold process numbers and one of the first's is missing in
    the second. An unknown id, or that of a last act, changes nothing."""
    nxt = Window.partitionBy("doc_id").orderBy("ord")
    named = acts.drop("warning").join(ids.select("act_id", F.lit(True).alias("named__")).distinct(), "act_id", "left")
    follow = named.select("*", *[F.lead(c).over(nxt).alias(f"{c}__") for c in ("text", "pages", "cnj")], F.lag("named__").over(nxt).alias("gone__"))
    joins = F.coalesce(F.col("named__") & F.col("text__").isNotNull(), F.lit(False))
    warn = joins & (F.size("cnj") > 0) & (F.size("cnj__") > 0) & (F.size(F.array_except("cnj", "cnj__")) > 0)
    rest = [c for c in acts.columns if c not in ("text", "pages", "warning")]
    rows = follow.filter(F.col("gone__").isNull()).select(
        *rest, F.when(joins, F.concat_ws("\n\n", trim(F.col("text")), trim(F.col("text__")))).otherwise(F.col("text")).alias("text"),
        F.when(joins, F.array_sort(F.array_union("pages", "pages__"))).otherwise(F.col("pages")).alias("pages"), warn.alias("warning"),
    )
    return classified(rows)


def update_fields(acts: DataFrame, changes: DataFrame) -> DataFrame:
    """acts of `classify.evidence` with the values of changes(act_id, key, value) put in: the method becomes the
    human review's, the evidence says so, and `review` becomes "revisada". A blank value takes the value away.
    Of several changes of one act and key the greatest value stands; an unknown act or key changes nothing."""
    one = changes.groupBy("act_id", "key").agg(F.max(trim(F.coalesce("value", F.lit("")))).alias("value"))
    asked = one.groupBy("act_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("asked__"))
    new = F.col("asked__")

    def put(f: Column) -> Column:
        value = F.try_element_at(new, f["key"])
        given = value != ""
        changed = F.struct(
            f["key"].alias("key"), f["label"].alias("label"), F.when(given, value).otherwise(UNKNOWN).alias("value"), F.when(given, FOUND).otherwise(UNDECIDED).alias("status"),
            F.lit(BY_REVIEW).alias("method"), F.when(given, F.concat(f["evidence"], F.lit(REVIEWED))).otherwise(REVIEW_REMOVED).alias("evidence"), f["origin"].alias("origin"),
        )
        return F.when(value.isNull(), f).otherwise(changed)

    joined = acts.drop("review").join(asked, "act_id", "left")
    fields = F.when(new.isNull(), F.col("fields")).otherwise(F.transform("fields", put))
    review = F.when(new.isNull(), "pendente").otherwise("revisada")
    return joined.select(*[c for c in acts.columns if c not in ("fields", "review")], fields.alias("fields"), review.alias("review"))


def undo(history: DataFrame) -> DataFrame:
    """history(doc_id, at, ...) without the last state of each document; that state with `back` true instead,
    which is what the document becomes."""
    last = Window.partitionBy("doc_id").orderBy(F.desc("at"))
    return history.withColumn("back", F.row_number().over(last) == 1)


def refreshed(acts: DataFrame) -> DataFrame:
    """acts with all derived columns computed anew, links and review reset."""
    return evidence(classified(acts.drop("duplicate_of", "variants", "review"))).withColumn("review", F.lit("pendente"))


def active_text(undone: str, faithful: str, reading: str) -> Column:
    """The text in force: the faithful one once the cleaning is undone."""
    return F.when(F.coalesce(F.col(undone), F.lit(False)), F.col(faithful)).otherwise(F.col(reading))
