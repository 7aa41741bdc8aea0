"""Queries over records built on classified acts. The SQL starts from the orders and has literals of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lavra.operators import classify as C
from lavra.operators import masking as M
from lavra.operators import records as D
from lavra.operators import search as S
from lavra.operators import segment as G
from lavra.plans import registry as R
from lavra.sources import archive, fixtures

register, classified, documents = R.register, R.classified, R.documents
A = archive.ACTS_SQL
_u = "'[NÃO IDENTIFICADO]'"
_all = R._fields | {"exercicio": R._x(C.EXERCICIO, 1), "eleicao": R._x(C.ELEICAO, 1)}
_order = ["area", "classe", "subtipo", "assunto", "rito", "fase", "tipo", "finalidade", "resultado", "orgao", "grau", "exercicio", "eleicao", "regime"]
#: Acts with their values by name, straight from the orders.
VALUES = f"{A}, r AS (SELECT *, {', '.join(f'({_all[k]}) AS {k}_' for k in _order)}, {R._nature} AS nature FROM a), v AS (SELECT *, {', '.join(f'coalesce(nullif({k}_, chr(0) || chr(0)), chr(0)) AS raw_{k}, CASE WHEN coalesce({k}_, chr(0)) IN (chr(0), {chr(39) * 2}) THEN {_u} ELSE {k}_ END AS {k}' for k in _order)} FROM r)"
_near = lambda m: f"trim(regexp_replace(substr(blob, greatest(1, strpos(blob, {m}) - 40), strpos(blob, {m}) + length({m}) + 80 - greatest(1, strpos(blob, {m}) - 40)), '\\s+', ' ', 'g'))"
_quote = lambda p, flag="(?i)": f"CASE WHEN regexp_extract(blob, '{flag}{p}') = '' THEN '' ELSE {_near(f'regexp_extract(blob, {chr(39)}{flag}{p}{chr(39)})')} END"


def _when(key: str, pairs: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items()) + " ELSE '' END"


_express = "regexp_matches(blob, '(?i)(?:^|\\n)\\s*Classe\\s*:\\s*[^\\n]+')"
_classes = {
    "cumprimento de sentença": _quote("cumprimento de senten[çc]a[^\\n]{0,80}"), "prestação de contas anual partidária": _quote("presta[çc][ãa]o de contas anual|PCA|órgão partidário"),
    "prestação de contas eleitorais": _quote("presta[çc][ãa]o de contas eleitorais|contas de campanha"), "AIJE": _quote("\\bAIJE\\b"), "AIME": _quote("\\bAIME\\b"),
    "registro de candidatura": _quote("registro de candidatura|\\bRRC\\b|\\bDRAP\\b"), "representação": _quote("representa[çc][ãa]o[^\\n]{0,80}"),
    "matéria criminal eleitoral": _quote("a[çc][ãa]o penal|crime eleitoral|art\\.\\s*299"),
}
_phases = {
    "cumprimento": _quote("cumprimento de senten[çc]a"), "execução": _quote("execu[çc][ãa]o"), "conhecimento": _quote("\\bconhecimento\\b"), "instrução": _quote("\\binstru[çc][ãa]o\\b"),
    "julgamento": _quote("\\bjulgamento\\b"),
}
_rulings = {"improcedente": _quote("julgo improcedente"), "procedente": _quote("julgo procedente"), "extinção": _quote("extin[çc][ãa]o do processo|extingo o processo")}
_evidence = {
    "area": _quote("eleitoral|zona eleitoral|AIJE|AIME|presta[çc][ãa]o de contas"), "classe": f"CASE WHEN {_express} THEN {_quote('Classe\\s*:[^\\n]+')} ELSE {_when('classe', _classes)} END",
    "subtipo": _quote("originad[oa]\\s+d[aeo]\\s+[^\\n.]{3,80}"), "assunto": _near("assunto"), "rito": _quote("rito\\s+[^\\n]{0,40}"), "fase": _when("fase", _phases), "tipo": "tipo",
    "finalidade": _quote("intime-se|julgo|publica-se"), "resultado": _when("resultado", _rulings), "orgao": "orgao",
    "grau": _quote("1[ºo°]\\s*grau|zona eleitoral|ju[íi]z eleitoral|Tribunal Regional Eleitoral"), "exercicio": "regexp_extract(blob, '(?i)exerc[íi]cio(?:\\s+financeiro)?(?:\\s+de)?\\s*\\d{4}')",
    "eleicao": "regexp_extract(blob, '(?i)elei[çc][õo]es\\s+\\d{4}')", "regime": "split_part(regime, '; ', 1)",
}
_found = {"area", "tipo", "resultado", "orgao", "exercicio", "eleicao", "regime"}
_by_field = {"tipo", "orgao", "exercicio", "eleicao", "regime"}


def _entry(k: str) -> str:
    status = f"CASE WHEN {_express} THEN 'identificada' ELSE 'sugerida' END" if k == "classe" else "'identificada'" if k in _found else "'sugerida'"
    method = {
        "classe": f"CASE WHEN {_express} THEN 'campo expresso' ELSE 'regra local' END", "resultado": f"CASE WHEN resultado = {_u} THEN 'regra local' ELSE 'campo expresso' END",
        "rito": f"CASE WHEN rito <> {_u} AND NOT regexp_matches(blob, '(?i)rito\\s+(ordin[áa]rio|sumar[íi]ssimo|especial|sum[áa]rio)') THEN 'campo expresso' ELSE 'regra local' END",
    }.get(k, "'campo expresso'" if k in _by_field else "'regra local'")
    quote = f"CASE WHEN {k} = {_u} OR ({_evidence[k]}) = '' THEN 'Sem trecho de apoio.' ELSE {_evidence[k]} END"
    return f"{{'key': '{k}', 'value': {k}, 'status': CASE WHEN {k} = {_u} THEN 'indeterminada' ELSE {status} END, 'method': {method}, 'evidence': {quote}}}"


_review = f"CASE WHEN classe = {_u} OR tipo = {_u} OR fase = {_u} THEN 'pendente' ELSE 'aguardando confirmação humana' END"
_last = f"{{'key': 'revisao', 'value': {_review}, 'status': CASE WHEN {_review} = 'pendente' THEN 'indeterminada' ELSE 'sugerida' END, 'method': 'regra local', 'evidence': 'Revisão humana ainda não registrada.'}}"
EVIDENCE = f"{VALUES}, e AS (SELECT act_id, doc_id, page, unnest([{', '.join([*map(_entry, _order), _last])}]) AS f FROM v)"


def evidenced(s: SparkSession, d: str, *only: str, quoted: bool = True) -> DataFrame:
    """Acts with the fields of all values, or of those named."""
    return C.evidence(classified(s, d, *only), only or None, quoted)


register(
    "evidence_fields",
    lambda s, d: C.evidence(classified(s, d, *C.LABELS), quoted=False).select("act_id", F.explode("fields").alias("f")).select("act_id", "f.key", "f.value", "f.status", "f.method", "f.origin"),
    f"{EVIDENCE} SELECT act_id, f.key AS key, f.value AS value, f.status AS status, f.method AS method, 'arquivo-' || doc_id || '.md · página ' || page AS origin FROM e",
)
register(
    "evidence_quote",
    lambda s, d: evidenced(s, d, *C.LABELS).select("act_id", F.explode("fields").alias("f")).select("act_id", "f.key", "f.evidence"),
    f"{EVIDENCE} SELECT act_id, f.key AS key, f.evidence AS evidence FROM e",
)
register(
    "field_lookup_by_key",
    lambda s, d: evidenced(s, d, "rito", quoted=False).select("act_id", C.field_value(F.col("fields"), "rito").alias("rito"), C.field_value(F.col("fields"), "nenhum").alias("none")),
    f"{VALUES} SELECT act_id, rito, {_u} AS none FROM v",
)
register("list_filter", lambda s, d: S.list_filter(classified(s, d, "classe"), " Campanha ", classe="prestação de contas eleitorais").select("act_id"),
         f"{VALUES} SELECT act_id FROM v WHERE contains(lower(blob), 'campanha') AND classe = 'prestação de contas eleitorais'")
register("list_filter_open", lambda s, d: S.list_filter(classified(s, d, "rito"), "", rito="sumário").select("act_id"), f"{VALUES} SELECT act_id FROM v WHERE rito = 'sumário'")
register(
    "acts_by_class",
    lambda s, d: S.by_class(classified(s, d, "classe")).select("classe", "n", F.sha2(F.array_join("act_ids", " "), 256).alias("ids")),
    f"{VALUES} SELECT classe, count(*)::INT AS n, sha256(string_agg(act_id, ' ' ORDER BY doc_id, ord)) AS ids FROM v GROUP BY 1",
)
register(
    "distinct_classes",
    lambda s, d: S.menus(classified(s, d, "classe", "rito"), "classe", "rito"),
    f"{VALUES}, m AS (SELECT 'classe' AS menu, classe AS value, doc_id, ord FROM v UNION ALL SELECT 'rito', rito, doc_id, ord FROM v), f AS (SELECT menu, value, min((doc_id, ord)) AS place FROM m GROUP BY 1, 2) SELECT menu, value, row_number() OVER (PARTITION BY menu ORDER BY f.place)::INT AS place FROM f",
)
register(
    "pending_count",
    lambda s, d: D.update_fields(evidenced(s, d, "rito"), R.acts(s, d).filter("ord = 1").select("act_id", F.lit("rito").alias("key"), F.lit("ordinário").alias("value"))).agg(F.count_if(F.col("review") != "revisada").alias("pending")),
    f"{A} SELECT count(*) FILTER (ord <> 1) AS pending FROM a",
)
register(
    "update_field",
    lambda s, d: D.update_fields(evidenced(s, d, "rito"), R.acts(s, d).filter("ord <= 2").select("act_id", F.lit("rito").alias("key"), F.when(F.col("ord") == 1, " especial ").otherwise(" ").alias("value")))
    .select("act_id", "review", F.explode("fields").alias("f")).filter("f.key = 'rito'").select("act_id", "review", "f.value", "f.status", "f.method", "f.evidence"),
    f"{EVIDENCE} SELECT e.act_id, CASE WHEN ord <= 2 THEN 'revisada' ELSE 'pendente' END AS review, CASE ord WHEN 1 THEN 'especial' WHEN 2 THEN {_u} ELSE f.value END AS value, CASE ord WHEN 1 THEN 'identificada' WHEN 2 THEN 'indeterminada' ELSE f.status END AS status, "
    "CASE WHEN ord <= 2 THEN 'revisão humana' ELSE f.method END AS method, CASE ord WHEN 1 THEN f.evidence || ' Revisão humana.' WHEN 2 THEN 'Revisão humana removeu o valor.' ELSE f.evidence END AS evidence FROM e JOIN a ON e.act_id = a.act_id WHERE f.key = 'rito'",
)
_extract, _annual = "Extrato de publicação. Não é a decisão integral e não deve ser usado como modelo completo.", "prestação de contas anual partidária"
_limits = (
    "list_filter(['Não transpor órgão, município, exercício, eleição ou competência deste texto para outro caso.', "
    f"CASE WHEN nature = 'extrato' THEN '{_extract}' END, CASE WHEN nature = 'incompleto' THEN 'Documento incompleto. Não fechar modelo enquanto houver lacuna de texto.' END, "
    f"CASE WHEN classe = '{_annual}' THEN 'Não usar para prestação de contas eleitorais ou de campanha.' END, "
    "CASE WHEN classe = 'prestação de contas eleitorais' THEN 'Não usar para prestação de contas anual de órgão partidário.' END, "
    "CASE WHEN classe = 'cumprimento de sentença' THEN 'Não usar como peça da ação que originou a execução.' END], lambda x: x IS NOT NULL)"
)
_labels = {"area": "Área", "classe": "Ação ou classe", "subtipo": "Subtipo", "assunto": "Assunto", "rito": "Rito", "fase": "Fase", "tipo": "Tipo de ato", "finalidade": "Finalidade", "resultado": "Resultado", "orgao": "Órgão", "grau": "Grau", "exercicio": "Exercício", "eleicao": "Eleição", "regime": "Regime citado no texto"}
_pending = (
    "list_filter([" + ", ".join(f"CASE WHEN {k} = {_u} THEN '{v}: [NÃO IDENTIFICADO]' END" for k, v in _labels.items())
    + ", 'Verificação jurídica pendente: vigência normativa e jurisprudência não foram conferidas em fonte oficial.', CASE WHEN nature = 'extrato' THEN 'Não reconstruir a decisão a partir do extrato.' END], lambda x: x IS NOT NULL)"
)
_title = f"CASE WHEN tipo = {_u} THEN title ELSE tipo END || ' — ' || CASE WHEN classe = {_u} THEN 'a classificar' ELSE classe END"
_purpose = f"CASE WHEN nature = 'extrato' THEN 'Referência de publicação, não modelo de decisão.' ELSE 'Referência de ' || CASE WHEN tipo = {_u} THEN 'ato' ELSE lower(tipo) END || ' para caso da mesma classe e fase, depois de revisão.' END"
_use = "'Somente se a classe for “' || classe || '”, a fase for “' || fase || '” e o tipo de ato for “' || tipo || '”. Conferir fatos e competência antes de reutilizar.'"
register(
    "template_limits",
    lambda s, d: D.templates(classified(s, d)).select("act_id", "template.title", "template.purpose", F.col("template.when").alias("use"), "template.pages", F.array_join("template.limits", "|").alias("limits"), F.array_join("template.pending", "|").alias("pending")),
    f"{VALUES} SELECT act_id, {_title} AS title, {_purpose} AS purpose, {_use} AS use, page::VARCHAR AS pages, array_to_string({_limits}, '|') AS limits, array_to_string({_pending}, '|') AS pending FROM v",
)
_voice = C.case_sql("(title || chr(10) || substr(text, 1, 240))", C.VOICE, "não identificada")
_tokens = f"regexp_extract_all({R._mask}, '\\[[A-ZÁÉÍÓÚ_]+\\]')"
_json = lambda x: f"to_json({x})::VARCHAR"
_lines = [
    "'---'", f"'titulo: ' || {_json(_title)}", "'natureza: ' || nature", f"'voz: ' || {_voice}", f"'origem: ' || {_json(chr(39) + 'arquivo-' + chr(39) + ' || doc_id || ' + chr(39) + '.md' + chr(39))}",
    f"'paginas: ' || {_json('page::VARCHAR')}", "'versao: 1'", f"'id_documento: ' || {_json(R._known(R._x(C.DOCUMENT_ID, 1, 'text')))}", "'---'", "''", f"'# ' || {_title}", "''", _purpose, "''",
    "'## Quando pode ser usado'", "''", _use, "''", "'## Requisitos'", "''", "'- Conferir a classe e a fase no processo de destino.'", "'- Preencher os campos entre colchetes.'",
    "'- Não aproveitar fato de outro processo como afirmação geral.'", "''", "'## Limites'", "''", f"'- ' || array_to_string({_limits}, chr(10) || '- ')", "''", "'## Campos'", "''",
    f"coalesce('- ' || nullif(array_to_string({R._distinct(_tokens)}, chr(10) || '- '), ''), '- Nenhum campo marcado.')", "''", "'## Pendências'", "''", f"'- ' || array_to_string({_pending}, chr(10) || '- ')", "''",
    "'## Texto reutilizável'", "''", f"trim({R._mask})", "''",
]
register(
    "template_markdown",
    lambda s, d: D.template_markdown(D.templates(classified(s, d))).select("act_id", F.sha2("markdown", 256).alias("digest"), F.length("markdown").alias("chars")),
    f"{VALUES}, m AS (SELECT act_id, {' || chr(10) || '.join(_lines)} AS markdown FROM v) SELECT act_id, sha256(markdown) AS digest, length(markdown)::INT AS chars FROM m",
)
_row = lambda kind, problem, excerpt, proposal, reason, priority: f"{{'kind': '{kind}', 'problem': '{problem}', 'excerpt': {excerpt}, 'proposal': '{proposal}', 'reason': '{reason}', 'priority': '{priority}'}}"
_cnj = f"regexp_extract({R._mask}, '\\d{{7}}-\\d{{2}}\\.\\d{{4}}\\.\\d\\.\\d{{2}}\\.\\d{{4}}')"
_found_rows = "list_filter([" + ", ".join(f"CASE WHEN {hit} THEN {row} END" for hit, row in [
    ("regexp_matches(text, '(?i)providencie-se o necess[áa]rio|tome-se as provid[êe]ncias cab[íi]veis')", _row("editorial", "Comando ambíguo", "'providencie-se o necessário / providências cabíveis'", "Nomear o ato, o destinatário e o prazo.", "O comando não diz o que deve ser feito.", "alta")),
    ("contains(lower(text), 'julgo procedente') AND contains(lower(text), 'julgo improcedente')", _row("editorial", "Dispositivo contraditório", "'julgo procedente / julgo improcedente'", "Deixar um único resultado, ou explicar os pedidos separados.", "Fundamentação e dispositivo apontam resultados opostos.", "alta")),
    (f"{_cnj} <> ''", _row("editorial", "Processo concreto ainda no modelo", _cnj, "Trocar pelo campo [PROCESSO], salvo se for precedente citado.", "O modelo ainda carrega número de processo.", "alta")),
    ("nature = 'extrato'", _row("jurídica", "Extrato tratado como decisão", "substr(text, 1, 160)", "Não promover este texto a modelo integral.", "Publicação resumida não contém a decisão completa.", "alta")),
    (f"classe = {_u}", _row("jurídica", "Classe sem apoio no texto", "''", "Classificar na revisão humana ou manter [NÃO IDENTIFICADO].", "Não há campo expresso nem regra local suficiente.", "alta")),
    ("true", _row("jurídica", "Adequação normativa", "regime", "Não atualizar o texto automaticamente. Conferir a norma em fonte oficial e, se for o caso, gravar uma proposta separada.", "Verificação jurídica pendente. Sem link oficial, data de consulta e período de vigência, o modelo histórico permanece como foi extraído.", "alta")),
]) + "], lambda x: x IS NOT NULL)"
_FOUND = f"{VALUES}, f AS (SELECT act_id, doc_id, page, {_found_rows} AS xs FROM v), g AS (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM f)"
register(
    "improvement_rows",
    lambda s, d: D.findings(classified(s, d, "nature", "classe", "regime")),
    f"{_FOUND} SELECT act_id, 'm' || i AS item, xs[i].kind AS kind, xs[i].problem AS problem, xs[i].excerpt AS excerpt, 'arquivo-' || doc_id || '.md · página ' || page AS origin, xs[i].proposal AS proposal, xs[i].reason AS reason, xs[i].priority AS priority FROM g",
)
register("improvements_by_kind", lambda s, d: D.findings(classified(s, d, "nature", "classe", "regime")).groupBy("kind").agg(F.count("*").alias("n")), f"{_FOUND} SELECT xs[i].kind AS kind, count(*) AS n FROM g GROUP BY 1")
_own = "array_to_string(list_distinct([x for x in regexp_extract_all(t, '\\d{7}-\\d{2}\\.\\d{4}\\.\\d\\.\\d{2}\\.\\d{4}')]), ' ')"
register(
    "split_act",
    lambda s, d: D.split_acts(R.acts(s, d), R.acts(s, d).select("act_id", F.lit(2).alias("k"))).select("act_id", "half", "title", "text", "classe"),
    f"{A}, p AS (SELECT *, string_split(text, chr(10) || chr(10)) AS ps FROM a), h AS ("
    "SELECT act_id, CASE WHEN len(ps) > 2 THEN 1 ELSE 0 END AS half, title, CASE WHEN len(ps) > 2 THEN array_to_string(ps[1:2], chr(10) || chr(10)) ELSE text END AS text FROM p UNION ALL "
    "SELECT act_id || '-b1', 2, substr(trim(split_part(ps[3], chr(10), 1)), 1, 80), array_to_string(ps[3:], chr(10) || chr(10)) FROM p WHERE len(ps) > 2), "
    f"b AS (SELECT *, title || chr(10) || text AS blob FROM h) SELECT act_id, half, title, text, {R._known(R._classe)} AS classe FROM b",
)
_W = "WINDOW w AS (PARTITION BY doc_id ORDER BY ord)"
register(
    "merge_next",
    lambda s, d: D.merge_acts(classified(s, d, "cnj"), R.acts(s, d).filter("ord % 2 = 1").select("act_id")).select("act_id", F.length("text").alias("chars"), F.size("pages").alias("n_pages"), "warning"),
    f"{A}, n AS (SELECT *, lead(text) OVER w AS t2, lead(page) OVER w AS p2, lead(own_cnj) OVER w AS c2 FROM a {_W}) SELECT act_id, (length(text) + coalesce(2 + length(t2), 0))::INT AS chars, CASE WHEN t2 IS NULL OR page = p2 THEN 1 ELSE 2 END AS n_pages, coalesce(own_cnj <> c2, false) AS warning FROM n WHERE ord % 2 = 1",
)
register(
    "undo_boundary",
    lambda s, d: D.undo(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("at"))).groupBy("doc_id").agg(F.max(F.when(F.col("back"), F.col("at"))).alias("state"), F.count_if(~F.col("back")).alias("rest")),
    "SELECT o_custkey AS doc_id, max(o_orderkey) AS state, count(*) - 1 AS rest FROM orders GROUP BY 1",
)
register(
    "undo_cleanup",
    lambda s, d: G.acts(archive.documents(s, d).withColumn("faithful", F.concat(F.col("reading"), F.lit("\n\nfim."))).withColumn("undone", F.col("doc_id") % 2 == 0).withColumn("reading", D.active_text("undone", "faithful", "reading"))).groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars")),
    f"{A} SELECT doc_id, (sum(length(text)) + CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 0 END)::BIGINT AS chars FROM a GROUP BY doc_id",
)
# pages: empty ones, tables with unequal rows and column notes come from the order keys
_noted = "'<!-- página ' || (i + 1) || CASE WHEN k % 5 = 1 THEN ' · 2 colunas' ELSE '' END || ' -->' || chr(10) || CASE k % 7 WHEN 2 THEN 'curta' WHEN 3 THEN '| a | b |' || chr(10) || '| c |' || chr(10) || 'texto suficiente da página' WHEN 4 THEN repeat('¿', 50) ELSE 'texto comum de uma página qualquer ' || k END"


def noted(s: SparkSession, d: str) -> DataFrame:
    """Documents whose pages hold what the quality report looks for."""
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    turn = rows.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1)
    page = turn.withColumn("page", F.expr(_noted.replace("(i + 1) ||", "cast(i + 1 as string) ||").replace("|| k END", "|| cast(k as string) END")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "page"))), lambda x: x["page"]), "\n")
    return page.groupBy("doc_id").agg(text.alias("reading")).withColumn("filename", F.format_string("p-%d.md", "doc_id"))


_told = lambda hit, text: f"coalesce(string_agg(CASE WHEN {hit} THEN 'página ' || p || '{text}' END, '|' ORDER BY p), '')"
register(
    "quality_docs",
    lambda s, d: M.quality_docs(G.page_slices(noted(s, d))).select("doc_id", "pages_processed", F.array_join(F.col("empty_pages").cast("array<string>"), ",").alias("empty"), F.array_join("risks", "|").alias("risks"), F.array_join("damaged_tables", "|").alias("damaged"),
                                                                  F.array_join("illegible_places", "|").alias("illegible"), F.array_join(F.col("needs_ocr").cast("array<string>"), ",").alias("ocr"), "integral"),
    "WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) "
    "SELECT doc_id, count(*) AS pages_processed, coalesce(string_agg(CASE WHEN k % 7 = 2 THEN p::VARCHAR END, ',' ORDER BY p), '') AS empty, "
    f"{_told('k % 5 = 1', ': possível leitura em colunas')} AS risks, {_told('k % 7 = 3', ': tabela com colunas irregulares')} AS damaged, {_told('k % 7 = 4', ': trecho com caracteres ilegíveis')} AS illegible, "
    "coalesce(string_agg(CASE WHEN k % 7 = 2 THEN p::VARCHAR END, ',' ORDER BY p), '') AS ocr, NOT bool_or(k % 7 IN (2, 4)) AS integral FROM t GROUP BY 1",
)
register(
    "quality_pages",
    lambda s, d: M.quality_pages(G.page_slices(noted(s, d))).select("doc_id", "page", "empty", "columns", "damaged", "illegible"),
    "WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS page FROM orders) SELECT doc_id, page, k % 7 = 2 AS empty, k % 5 = 1 AS columns, k % 7 = 3 AS damaged, k % 7 = 4 AS illegible FROM t",
)
register(
    "convert_stats",
    lambda s, d: S.convert_stats(G.page_slices(noted(s, d))),
    "WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS k FROM orders), l AS (SELECT doc_id, CASE k % 7 WHEN 2 THEN 5 WHEN 3 THEN 42 WHEN 4 THEN 50 ELSE 35 + length(k::VARCHAR) END AS n FROM t) SELECT doc_id, count(*) AS pages, sum(n)::BIGINT AS chars, 0::BIGINT AS headings, sum(n) / count(*) < 20 AS likely_scan FROM l GROUP BY 1",
)
register(
    "cnj_search",
    lambda s, d: S.process_search(S.inverted_index(G.page_slices(archive.documents(s, d)).select("page", "text")), "-1"),
    f"{A}, c AS (SELECT page, unnest(regexp_extract_all(text, '\\d{{7}}-\\d{{2}}\\.\\d{{4}}\\.\\d\\.\\d{{2}}\\.\\d{{4}}')) AS cnj FROM a), i AS (SELECT cnj, min(page) AS first_page FROM c GROUP BY 1) SELECT cnj, first_page FROM i WHERE false",
)
register(
    "cnj_search_year",
    lambda s, d: S.process_search(S.inverted_index(G.page_slices(archive.documents(s, d)).select("page", "text")), " .6.14.00 "),
    f"{A}, c AS (SELECT page, unnest(regexp_extract_all(text, '\\d{{7}}-\\d{{2}}\\.\\d{{4}}\\.\\d\\.\\d{{2}}\\.\\d{{4}}')) AS cnj FROM a), i AS (SELECT cnj, min(page) AS first_page FROM c GROUP BY 1) SELECT cnj, first_page FROM i WHERE contains(cnj, '.6.14.00') ORDER BY first_page, cnj LIMIT 12",
)
register("search_snippet", lambda s, d: documents(s, d).select("doc_id", S.snippet(F.col("text"), "cion").alias("snippet")))
register("plain_text", lambda s, d: documents(s, d).select("doc_id", F.sha2(S.plain(F.concat(F.lit("## "), F.regexp_replace("text", r"[*\[\]]", r"\\$0"))), 256).alias("digest")),
         r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[*\[\]]', '\\\0', 'g'), '(^|\n)#{1,3}\s+', '\1', 'g'), '\\([\\`*_{}\[\]#<>])', '\1', 'g')) AS digest FROM documents")
register(
    "focus_cnj",
    lambda s, d: S.focus(archive.documents(s, d), "reading", "6.14.0007").select("doc_id", F.length("before").alias("before"), "match", F.length("after").alias("after")),
    f"{A}, r AS (SELECT doc_id, string_agg('<!-- página ' || page || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY ord) AS reading FROM a GROUP BY 1) SELECT doc_id, (strpos(reading, '6.14.0007') - 1)::INT AS before, '6.14.0007' AS match, (length(reading) - strpos(reading, '6.14.0007') - 8)::INT AS after FROM r WHERE contains(reading, '6.14.0007')",
)
register("index_csv", lambda s, d: S.index_rows(S.linked(classified(s, d))))
register("index_csv_unlinked", lambda s, d: S.index_rows(classified(s, d, "nature", "classe", "rito", "fase", "tipo", "assunto", "exercicio", "eleicao", "document_id").withColumn("duplicate_of", F.lit(None).cast("string")).withColumn("variants", F.array().cast("array<string>"))),
         f"{A} SELECT act_id, {' || chr(44) || '.join(f'({R._cell(f"({c})")})' for c in R._cells)} AS line FROM a")
register(
    "index_json",
    lambda s, d: S.linked(evidenced(s, d)).select("act_id", F.to_json(F.struct(F.col("act_id").alias("id"), F.col("title").alias("titulo"), F.col("nature").alias("natureza"), F.col("voice").alias("voz"), F.col("filename").alias("arquivo"), F.col("pages").alias("paginas"), "cnj", F.col("document_id").alias("id_documento"),
                                                                                  F.col("printed_pages").alias("paginas_impressas"), F.col("fields").alias("campos"), F.col("duplicate_of").alias("duplicata_de"), F.col("variants").alias("variantes"))).alias("json")),
)
register("fixture_archive", lambda s, d: fixtures.summary(classified_fixture(s)), fixtures.EXPECTED_SQL)


def classified_fixture(s: SparkSession) -> DataFrame:
    return S.linked(C.classified(G.acts(fixtures.documents(s))))
