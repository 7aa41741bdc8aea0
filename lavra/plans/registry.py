"""The library's registered queries and their SQL.

Queries named after a rule run on the synthetic archive: the archive's text is sliced, segmented and
classified, while the SQL side starts from the orders. Rules of lines run over all documents set in lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions import text as T
from lavra.operators import classify as C
from lavra.operators import incremental as I
from lavra.operators import layout as L
from lavra.operators import linking as K
from lavra.operators import masking as M
from lavra.operators import records as R
from lavra.operators import search as S
from lavra.operators import segment as G
from lavra.sources import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.acts(archive.documents(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """Acts with all values, or with those named; `blob` alone stands for none of them."""
    return C.classified(acts(spark, sf_dir), only or None)


def on_acts(name: str, columns: Callable[[], dict[str, Column]], sql_columns: str, *uses: str) -> None:
    """A column or more for each act; made when the query runs, as columns need a session. uses: the values that they
    are made of, if not those of their names."""
    register(name, lambda s, d: classified(s, d, *(uses or columns())).select("act_id", *[c.alias(k) for k, c in columns().items()]), f"{archive.ACTS_SQL} SELECT act_id, {sql_columns} FROM a")


U = T.UNKNOWN
_known = lambda sql: f"CASE WHEN coalesce({sql}, '') = '' THEN '{U}' ELSE {sql} END"
_x = lambda p, g=0, col="blob": f"regexp_extract({col}, '(?i){p}', {g})"
_m = lambda p, col="blob": f"regexp_matches({col}, '(?i){p}')"
_label = lambda label: f"substr(trim({_x(rf'(?:^|\n)\s*{label}\s*:\s*([^\n]+)', 1)}), 1, 180)"
_norm = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"

# ---- scans, slices, lines
register("scan_documents", lambda s, d: documents(s, d).select("doc_id", F.char_length("text").alias("chars")), "SELECT doc_id, length(text) AS chars FROM documents")
register(
    "page_slices",
    lambda s, d: G.page_slices(archive.documents(s, d)).select("doc_id", "slice_ord", "page", F.md5(F.col("text").cast("binary")).alias("digest")),
    f"{archive.ACTS_SQL} SELECT doc_id, ord - 1 AS slice_ord, page, md5(text) AS digest FROM a",
)
register("segment_acts", lambda s, d: acts(s, d).select("doc_id", "act_id", "title", "text"), f"{archive.ACTS_SQL} SELECT doc_id, act_id, title, text FROM a")
register("segment_pages", lambda s, d: acts(s, d).select("act_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages")), f"{archive.ACTS_SQL} SELECT act_id, page::VARCHAR AS pages FROM a")
register("acts_flat", lambda s, d: acts(s, d).select("doc_id", "ord", "act_id", F.length("text").alias("chars")), f"{archive.ACTS_SQL} SELECT doc_id, ord, act_id, length(text)::INT AS chars FROM a")
register(
    "paragraphs",
    lambda s, d: acts(s, d).select("act_id", F.posexplode(M.paragraphs(F.col("text"))).alias("at", "p")).select("act_id", "at", F.length("p").alias("chars")),
    rf"{archive.ACTS_SQL}, p AS (SELECT act_id, regexp_split_to_array(text, '\n{{2,}}') AS ps FROM a) SELECT act_id, (i - 1)::INT AS at, length(ps[i])::INT AS chars FROM (SELECT act_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)",
)
_LINES = f"{archive.ACTS_SQL}, l AS (SELECT doc_id, ord - 1 AS slice_ord, unnest(string_split(text, chr(10))) AS line FROM a)"


def on_lines(name: str, flag: Callable[[Column], Column], sql_flag: str) -> None:
    register(
        name,
        lambda s, d: G.lines(archive.documents(s, d)).filter(flag(F.col("line"))).groupBy("doc_id", "line").agg(F.count("*").alias("n")),
        f"{_LINES} SELECT doc_id, line, count(*) AS n FROM l WHERE {sql_flag} GROUP BY ALL",
    )


_start = f"length(trim(line)) BETWEEN 1 AND 80 AND len(regexp_split_to_array(trim(line), '\\s+')) <= 4 AND NOT {_m(G.SECTION, 'strip_accents(trim(line))')} AND {_m(G.START, 'trim(line)')}"
on_lines("doc_start_lines", G.is_start, _start)
on_lines("process_header_lines", G.is_process, f"NOT {_m(G.CITATION, 'line')} AND {_m(G.PROCESS, 'line')} AND regexp_matches(line, '{T.CNJ}')")
on_lines("citation_lines", lambda c: T.has(c, G.CITATION), _m(G.CITATION, "line"))

# ---- classification
_classe = f"CASE WHEN {_label('Classe')} <> '' THEN {_label('Classe')} ELSE {C.case_sql('blob', C.CLASSE)} END"
_tipo = f"trim(CASE WHEN {_x(C.TIPO_TITLE, 0, 'trim(title)')} <> '' THEN {_x(C.TIPO_TITLE, 0, 'trim(title)')} ELSE {_x(C.TIPO_LINE, 1)} END)"
_fase = C.case_sql("blob", C.FASE)
_subject = "coalesce(" + ", ".join(f"nullif({_x(p)}, '')" for p in C.ASSUNTO) + ", '')"
_final = f"CASE WHEN {_m(C.FINAL[0][0])} THEN '{C.FINAL[0][1]}' WHEN {_m(C.FINAL[1][0])} THEN '{C.FINAL[1][1]}' WHEN {_m('publica-se|extrato', 'title')} THEN 'publicar extrato' ELSE '' END"
_rito = f"CASE WHEN {_x(C.RITO, 1)} <> '' THEN {_x(C.RITO, 1)} ELSE {_label('Rito')} END"
_origin = f"CASE WHEN {_x(C.ORIGIN, 1)} <> '' THEN 'originado de ' || trim({_x(C.ORIGIN, 1)}) ELSE '' END"
_norms = f"list_transform(regexp_extract_all(blob, '(?i){C.NORMS}'), lambda x: {_norm('x')})"
_distinct = lambda xs: f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"
_fields = {
    "area": C.case_sql("blob", C.AREA), "classe": _classe, "subtipo": _origin, "assunto": _subject, "rito": _rito, "fase": _fase, "tipo": _tipo, "finalidade": _final,
    "resultado": C.case_sql("blob", C.RESULTADO), "orgao": f"trim({_x(C.ORGAO)})", "grau": C.case_sql("blob", C.GRAU), "regime": f"array_to_string(({_distinct(_norms)})[:8], '; ')",
}
for _k, _v in _fields.items():
    on_acts(f"classify_{_k}", lambda k=_k: {k: F.col(k)}, f"{_known(_v)} AS {_k}")
on_acts("classify_dates", lambda: {"exercicio": F.col("exercicio"), "eleicao": F.col("eleicao")}, f"{_known(_x(C.EXERCICIO, 1))} AS exercicio, {_known(_x(C.ELEICAO, 1))} AS eleicao")
_missing = " OR ".join(f"coalesce({v}, '') = ''" for v in (_classe, _tipo, _fase))
on_acts("classify_revisao", lambda: {"revisao": F.col("revisao")}, f"CASE WHEN {_missing} THEN 'pendente' ELSE 'aguardando confirmação humana' END AS revisao")
_head = "(title || chr(10) || substr(text, 1, 500))"
_nature = (
    f"CASE WHEN {_m(C.NATURE_MODEL, 'title')} OR {_m(C.NATURE_MODEL, 'substr(text, 1, 200)')} THEN 'modelo' WHEN {_m(C.NATURE_SUPPORT, _head)} THEN 'apoio' "
    f"WHEN {_m(C.NATURE_EXTRACT[0], 'title')} OR {_m(C.NATURE_EXTRACT[1], _head)} THEN 'extrato' "
    f"WHEN length(regexp_replace(text, '\\s', '', 'g')) < 40 OR {_m(C.NATURE_INCOMPLETE, 'text')} THEN 'incompleto' ELSE 'ato' END"
)
on_acts("infer_nature", lambda: {"nature": F.col("nature")}, f"{_nature} AS nature")
on_acts("infer_voice", lambda: {"voice": F.col("voice")}, f"{C.case_sql('(title || chr(10) || substr(text, 1, 240))', C.VOICE, 'não identificada')} AS voice")
on_acts("field_lookup", lambda: {"classe": F.col("classe"), "rito": F.col("rito")}, f"{_known(_classe)} AS classe, {_known(_rito)} AS rito")
on_acts("own_cnjs", lambda: {"cnj": F.array_join("cnj", " ")}, "own_cnj AS cnj")
on_acts("document_id", lambda: {"document_id": F.col("document_id")}, f"{_known(_x(C.DOCUMENT_ID, 1, 'text'))} AS document_id")
_printed = f"regexp_extract_all(text, '(?i){C.PRINTED}', 1)"
on_acts("printed_pages", lambda: {"printed": F.array_join("printed_pages", " ")}, f"array_to_string({_distinct(_printed)}, ' ') AS printed", "printed_pages")
on_acts("labels_short", lambda: {"short": S.short_class(F.col("classe")), "label": S.pages_label(F.col("pages"))},
        f"CASE WHEN contains({_known(_classe)}, 'anual') THEN 'Contas anuais' WHEN contains({_known(_classe)}, 'eleitorais') THEN 'Contas eleitorais' WHEN {_classe} = 'representação' THEN 'Representações' WHEN coalesce({_classe}, '') = '' THEN 'A classificar' ELSE {_classe} END AS short, 'Página ' || page AS label", "classe")
register(
    "class_phase_counts",
    lambda s, d: classified(s, d, "classe", "fase").groupBy("classe", "fase").agg(F.count("*").alias("n")),
    f"{archive.ACTS_SQL} SELECT {_known(_classe)} AS classe, {_known(_fase)} AS fase, count(*) AS n FROM a GROUP BY 1, 2",
)

# ---- masking, quality, findings
_par = "x"
for _p, _by, _fl in M.MASKS:
    _par = f"regexp_replace({_par}, '{'(?i)' if _fl else ''}{_p}', '{_by.replace('$1', chr(92) + '1')}', 'g')"
_mask = rf"array_to_string(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda x: CASE WHEN {_m(M.CITATION, 'x')} THEN x ELSE {_par} END), chr(10) || chr(10))"
on_acts("mask_text", lambda: {"template": M.mask(F.col("text"))}, f"{_mask} AS template", "blob")
register(
    "placeholders",
    lambda s, d: acts(s, d).select("act_id", F.array_join(M.placeholders(M.mask(F.col("text"))), " ").alias("tokens")),
    f"{archive.ACTS_SQL}, t AS (SELECT act_id, regexp_extract_all({_mask}, '{M.PLACEHOLDER}') AS xs FROM a) SELECT act_id, array_to_string({_distinct('xs')}, ' ') AS tokens FROM t",
)
register(
    "illegible_ratio",
    lambda s, d: documents(s, d).select("doc_id", M.illegible(F.col("text")).alias("illegible"), F.length(F.regexp_replace("text", r"[^\p{L}]", "")).alias("letters")),
    r"SELECT doc_id, length(text) > 40 AND (len(regexp_extract_all(text, '[�¿]')) > 4 OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) < 0.35) AS illegible, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::INT AS letters FROM documents",
)
_kept = {k: f"regexp_extract_all(text, '{'(?i)' if fl else ''}{p}')" for k, (p, fl) in M.PRESERVED.items()}
on_acts("preserve_meta", lambda: {k: F.array_join(M.preserved(F.col("text"), k), "; ") for k in ("orgao", "datas", "edicao", "processos")},
        ", ".join(f"array_to_string({_distinct(f'list_transform({_kept[k]}, lambda x: trim(x))')}, '; ') AS {k}" for k in ("orgao", "datas", "edicao", "processos")), "blob")
register(
    "long_paragraph",
    lambda s, d: documents(s, d).select("doc_id", F.md5(M.long_paragraph(F.col("text")).cast("binary")).alias("digest")).filter("digest is not null"),
    r"SELECT doc_id, md5(p) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{2,}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 900)[1] AS p FROM documents) WHERE p IS NOT NULL",
)
register(
    "repeated_line",
    lambda s, d: M.repeated_lines(documents(s, d)).select("doc_id", F.md5(F.col("line").cast("binary")).alias("digest"), "n"),
    r"WITH l AS (SELECT doc_id, i, regexp_replace(xs[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents))), c AS (SELECT doc_id, line, count(*) AS n, min(i) AS i FROM l WHERE length(line) > 40 GROUP BY 1, 2 HAVING count(*) >= 3) SELECT doc_id, md5(arg_min(line, i)) AS digest, arg_min(n, i) AS n FROM c GROUP BY 1",
)

# ---- linking
_tokens = r"list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: length(x) > 4))"
register(
    "link_duplicates",
    lambda s, d: K.duplicates(documents(s, d)).filter("duplicate_of is not null"),
    f"WITH n AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_norm('text')}) AS duplicate_of FROM documents) SELECT doc_id, duplicate_of FROM n WHERE duplicate_of < doc_id",
)
register(
    "token_sets",
    lambda s, d: documents(s, d).select("doc_id", F.size(K.tokens(F.col("text"))).alias("n"), F.md5(F.array_join(F.array_sort(K.tokens(F.col("text"))), " ").cast("binary")).alias("digest")),
    f"SELECT doc_id, len({_tokens})::INT AS n, md5(array_to_string(list_sort({_tokens}), ' ')) AS digest FROM documents",
)
_PAIRS = f"""
WITH t AS (SELECT doc_id, lang, {_tokens} AS ts, min(doc_id) OVER (PARTITION BY {_norm('text')}) AS first FROM documents),
e AS (SELECT doc_id, lang, len(ts) AS n, first, unnest(ts) AS token FROM t),
p AS (SELECT a.doc_id, b.doc_id AS other, any_value(a.first) AS first, count(*) AS i, any_value(a.n + b.n) - count(*) AS total
  FROM e a JOIN e b ON a.token = b.token AND a.lang = b.lang AND b.doc_id < a.doc_id GROUP BY 1, 2)
"""
_rows = lambda s, d: documents(s, d).select("doc_id", F.col("lang").alias("block"), "text")
register(
    "jaccard_pairs",
    lambda s, d: K.similar_pairs(_rows(s, d)).select("doc_id", "other", F.col("inter").cast("bigint").alias("inter"), F.col("total").cast("bigint").alias("total")),
    f"{_PAIRS} SELECT doc_id, other, i AS inter, total FROM p WHERE i * 100 >= total * 72",
)
register("link_variants", lambda s, d: K.variants(_rows(s, d)), f"{_PAIRS} SELECT doc_id, other AS variant_of FROM p WHERE i * 100 >= total * 72 AND (first = doc_id OR other < first)")


def links_in_batches(s: SparkSession, d: str) -> DataFrame:
    """Links of all documents that came in three batches, later ones with lesser ids among them."""
    rows = documents(s, d).select("doc_id", F.lit(1).alias("ord"), F.col("doc_id").cast("string").alias("act_id"), F.col("lang").alias("classe"), F.lit("").alias("tipo"), "text")
    parts = [rows.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) == k) for k in (2, 0, 1)]
    order, stored = K.written(I.ranks(parts[0]), "ranks"), None
    for part in parts:  # each batch is written once, as in the store
        added = {t: K.written(x, t) for t, x in I.add(part, order, stored).items()}
        stored = {t: stored[t].unionByName(x) for t, x in added.items()} if stored else added
    return I.link_counts(stored["members"], stored["pairs"]).select("doc_id", "duplicate_of", "variants")


register(
    "links_in_batches", links_in_batches,
    f"{_PAIRS}, v AS (SELECT doc_id, count(*) AS n FROM p WHERE i * 100 >= total * 72 AND (first = doc_id OR other < first) GROUP BY 1) "
    "SELECT t.doc_id, CASE WHEN first < t.doc_id THEN first::VARCHAR END AS duplicate_of, coalesce(n, 0) AS variants FROM t LEFT JOIN v ON t.doc_id = v.doc_id",
)

# ---- search, index, export
register(
    "fold_text",
    lambda s, d: documents(s, d).select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("digest")),
    "SELECT doc_id, md5(lower(strip_accents(text))) AS digest FROM documents",
)
register(
    "page_search",
    lambda s, d: S.page_search(documents(s, d).select(F.col("doc_id").alias("page"), "text"), "Ción").select("page"),
    "SELECT doc_id AS page FROM documents WHERE contains(lower(strip_accents(text)), 'cion') ORDER BY doc_id LIMIT 24",
)
register(
    "cnj_inverted_index",
    lambda s, d: S.inverted_index(G.page_slices(archive.documents(s, d)).select("page", "text")).select("cnj", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages")),
    f"{archive.ACTS_SQL}, c AS (SELECT page, unnest(regexp_extract_all(text, '{T.CNJ}')) AS cnj FROM a) SELECT cnj, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM c GROUP BY 1",
)
register(
    "cnj_first_page",
    lambda s, d: S.inverted_index(G.page_slices(archive.documents(s, d)).select("page", "text")).select("cnj", F.get("pages", F.lit(0)).alias("page")),
    f"{archive.ACTS_SQL}, c AS (SELECT page, unnest(regexp_extract_all(text, '{T.CNJ}')) AS cnj FROM a) SELECT cnj, min(page) AS page FROM c GROUP BY 1",
)
_fold1 = lambda x: f"regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '[\\[\\]]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_slug = lambda x: f"CASE WHEN {_fold1(x)} IN ('', 'nao-identificado') THEN 'a-classificar' ELSE substr({_fold1(x)}, 1, 60) END"
on_acts("slug", lambda: {"slug": S.slug(F.col("classe"))}, f"{_slug(_known(_classe))} AS slug", "classe")
_path = f"'modelos/' || ({_slug(_known(_classe))}) || '/' || ({_slug(_known(_rito))}) || '/' || ({_slug(_known(_fase))}) || '/' || ({_slug('act_id')}) || '.md'"
on_acts("export_paths", lambda: {"path": S.export_path(F.col("classe"), F.col("rito"), F.col("fase"), F.col("act_id"))}, f"{_path} AS path", "classe", "rito", "fase")
_cell = lambda x: f"CASE WHEN regexp_matches({x}, '[\",\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"
_cells = ["act_id", "title", _nature, _known(_classe), _known(_rito), _known(_fase), _known(_tipo), _known(_subject), _known(_x(C.EXERCICIO, 1)), _known(_x(C.ELEICAO, 1)), "'pendente'",
          "'arquivo-' || doc_id || '.md'", "page::VARCHAR", _path, "''", "''", _known(_x(C.DOCUMENT_ID, 1, "text"))]
_gap = "list_filter([" + ", ".join(f"CASE WHEN coalesce({v}, '') = '' THEN '{C.LABELS[k]}' END" for k, v in {**_fields, "exercicio": _x(C.EXERCICIO, 1), "eleicao": _x(C.ELEICAO, 1)}.items()) + "], lambda x: x IS NOT NULL)"
register("gap_rows", lambda s, d: S.gaps(classified(s, d), {k: v for k, v in C.LABELS.items() if k != "revisao"}), f"{archive.ACTS_SQL} SELECT act_id, unnest({_gap}) AS label FROM a")
register("crc32_text", lambda s, d: documents(s, d).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32")))
register(
    "backup_manifest",
    lambda s, d: archive.documents(s, d).select("doc_id", F.sha2("reading", 256).alias("sha256"), F.length("reading").alias("chars")),
    f"{archive.ACTS_SQL}, r AS (SELECT doc_id, string_agg('<!-- página ' || page || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY ord) AS reading FROM a GROUP BY 1) SELECT doc_id, sha256(reading) AS sha256, length(reading)::INT AS chars FROM r",
)
register(
    "weighted_median",
    lambda s, d: S.weighted_median(s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_linenumber"), "l_suppkey", "l_partkey", "l_linenumber"),
    "WITH s AS (SELECT l_suppkey, l_partkey, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS run, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM s) SELECT l_suppkey, min(l_partkey) AS median FROM r WHERE run >= total / 2 GROUP BY 1",
)
register(
    "md_escape",
    lambda s, d: documents(s, d).select("doc_id", F.md5(L.escape_inline(F.col("text")).cast("binary")).alias("digest")),
    r"SELECT doc_id, md5(regexp_replace(text, '([\\`*_{}\[\]#<>])', '\\\1', 'g')) AS digest FROM documents",
)
on_acts("legal_unit", lambda: {"unit": F.exists(F.split("text", "\n"), L.legal_unit)},
        f"len(list_filter(string_split(text, chr(10)), lambda x: (regexp_matches(trim(x), '{T.CNJ}') AND length(trim(x)) < 140) OR (regexp_matches(trim(x), '{L.HEADER}') AND length(trim(x)) < 180) OR (regexp_matches(trim(x), '{L.UNIT}') AND length(trim(x)) < 100))) > 0 AS unit", "blob")
register(
    "history_tail",
    lambda s, d: K.last_states(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("at"))).select("doc_id", "at"),
    "SELECT o_custkey AS doc_id, o_orderkey AS at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 12",
)

def filled(s: SparkSession, d: str) -> DataFrame:
    """Templates of all acts; two thirds of the documents give their number, none gives a date."""
    own = classified(s, d, "cnj").select("doc_id", "act_id", M.mask(F.col("text")).alias("template"), F.get("cnj", F.lit(0)).alias("number"))
    number = own.filter("doc_id % 3 <> 0").select("act_id", F.lit("[PROCESSO]").alias("token"), F.col("number").alias("value"))
    date = own.select("act_id", F.lit("[DATA]").alias("token"), F.lit(" ").alias("value"))
    return M.fill_from(own.select("act_id", "template"), number.unionByName(date))


register("fill_template", filled, f"{archive.ACTS_SQL} SELECT act_id, CASE WHEN doc_id % 3 = 0 THEN {_mask} ELSE replace({_mask}, '[PROCESSO]', own_cnj) END AS template FROM a")
_undone = lambda s, d: archive.documents(s, d).select("doc_id", "reading", F.concat(F.lit("fiel "), "reading").alias("faithful"), (F.col("doc_id") % 2 == 0).alias("undone"))
register(
    "active_text",
    lambda s, d: _undone(s, d).select("doc_id", F.sha2(R.active_text("undone", "faithful", "reading"), 256).alias("digest")),
    f"{archive.ACTS_SQL}, r AS (SELECT doc_id, string_agg('<!-- página ' || page || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY ord) AS reading FROM a GROUP BY 1) SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN 'fiel ' ELSE '' END || reading) AS digest FROM r",
)

# ---- names of links


def remapped(s: SparkSession, d: str) -> DataFrame:
    """Links of customers to fifty names: a third has a name of its own, twenty are ambiguous and ten unknown elsewhere."""
    links = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey as doc_id", "concat('k', o_orderkey % 50) as old").distinct()
    local = links.filter("doc_id % 3 = 0").selectExpr("doc_id", "old", "concat(doc_id, '/', old) as new")
    anywhere = s.read.parquet(f"{d}/part.parquet").selectExpr("concat('k', p_partkey % 40) as old", "concat('n', p_partkey % 40, '-', if(p_partkey % 40 < 20, p_partkey div 40 % 2, 0)) as new").distinct()
    return K.remap(links, local, anywhere)


register(
    "remap_links", remapped,
    "SELECT doc_id, 'k' || k AS old, CASE WHEN doc_id % 3 = 0 THEN doc_id || '/k' || k WHEN k < 20 THEN NULL WHEN k < 40 THEN 'n' || k || '-0' ELSE 'k' || k END AS new FROM (SELECT DISTINCT o_custkey AS doc_id, o_orderkey % 50 AS k FROM orders)",
)

from lavra.plans import layout_queries, record_queries, search_queries, store_queries, view_queries  # noqa: E402, F401  they register theirs
