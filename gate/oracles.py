"""Plain SQL for each registered query, written independently of the library.

Matching is done by brute force over token positions, proximity by pairing all
instances, similarity by scoring every pair, snippets by trying every window.
"""

from __future__ import annotations

from lexspark.functions.text import ACCENTED, PLAIN, STOP_WORDS
from lexspark.sources.derived import TESIS_SELECT

ORACLES: dict[str, str] = {}

SCJN = "'Suprema Corte de Justicia de la Nación'"


def fold(c: str) -> str:
    return f"translate(regexp_replace(lower({c}), '\\p{{Mn}}', '', 'g'), '{ACCENTED}', '{PLAIN}')"


def tok(c: str) -> str:
    return f"regexp_extract_all({fold(f'coalesce({c}, {chr(39)}{chr(39)})')}, '[\\p{{L}}\\p{{N}}]+')"


def words(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return (
        f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: length(w) >= 4 and w not in ({stop}))"
    )


TESIS = "tesis as materialized (" + TESIS_SELECT.format(
    S="varchar", MINUTES="to_minutes(doc_id)", DOCUMENTS="documents") + ")"

IS_BINDING = "contains(lower(tipo_tesis), 'jurisprudencia')"
BUCKET = f"""case when instancia = {SCJN} and lower(organo_juris) like 'pleno%' then 0
  when instancia = {SCJN} and lower(organo_juris) like '%sala%' then 1
  when lower(instancia) like '%plenos regionales%' then 2
  when lower(instancia) like '%plenos de circuito%' then 3
  when lower(instancia) like '%tribunales colegiados%' then 4 else 5 end"""
LEVEL = f"""case when {IS_BINDING} then substr('SABCDD', 1 + {BUCKET}, 1)
  when instancia = {SCJN} then 'E' else 'F' end"""
FORCE = f"(case when {IS_BINDING} then 0 else 1 end), ({BUCKET})"

UNITS = ["primer", "segundo", "tercer", "cuarto", "quinto", "sexto", "septimo", "octavo", "noveno"]
TENS = ["decimo", "vigesimo", "trigesimo"]
ROMANS = ("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx xxi xxii xxiii "
          "xxiv xxv xxvi xxvii xxviii xxix xxx xxxi xxxii").split()
_ORDINALS = {u: n for n, u in enumerate(UNITS, 1)}
for _i, _t in enumerate(TENS, 1):
    _ORDINALS[_t] = 10 * _i
    _ORDINALS.update({_t + u: 10 * _i + n for n, u in enumerate(UNITS, 1) if 10 * _i + n <= 32})
_ORD_RE = f"(?:(?:{'|'.join(TENS)}) ?)?(?:{'|'.join(UNITS)})|{'|'.join(TENS)}"


def _case(c: str, values: dict) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


def circuit_of_court(c: str) -> str:
    ordinal = f"replace(regexp_extract({fold(c)}, '\\b({_ORD_RE}) circuito', 1), ' ', '')"
    roman = f"regexp_extract({fold(c)}, '\\b([ivx]+)[.]? circuito', 1)"
    return f"coalesce({_case(ordinal, _ORDINALS)}, {_case(roman, {r: n for n, r in enumerate(ROMANS, 1)})})"


POST = f"""fields as (
  select id_tesis, 'rubro' as col, {tok('rubro')} as tk from tesis
  union all select id_tesis, 'texto', {tok('texto')} from tesis
  union all select id_tesis, 'precedentes', {tok('precedentes')} from tesis
  union all select id_tesis, 'materias', {tok('materias')} from tesis),
post as materialized (select id_tesis, col, unnest(tk) as tok, unnest(range(len(tk))) as pos from fields),
dl as materialized (select id_tesis, cast(sum(len(tk)) as bigint) as d from fields group by 1),
cs as (select count(*) as n, sum(d)::double / count(*) as avgd from dl)"""


def phrases(concepts: list[list[str]], scope: str = "todo", near: int | None = None) -> str:
    """Table of query phrases (qid, concept, ph, txt, scope, near, nc) of one query."""
    rows = [
        f"('0', {c}, {p}, '{t}', '{scope}', {near if near is not None else 'cast(null as int)'}, {len(concepts)})"
        for c, concept in enumerate(concepts) for p, t in enumerate(concept)
    ]
    return f"qp as (select * from (values {', '.join(rows)}) as t(qid, concept, ph, txt, scope, near, nc))"


HITS = f"""qk as (select *, {tok('txt')} as tk from qp),
qt as materialized (select qid, concept, ph, scope, near, nc, len(tk) as plen, unnest(tk) as tok,
  unnest(range(len(tk))) as off from qk where len(tk) > 0),
inst as materialized (select q.qid, q.concept, q.ph, q.near, q.nc, q.plen, p.id_tesis, p.col, p.pos - q.off as start
  from post p join qt q on p.tok = q.tok and (q.scope = 'todo' or q.scope = p.col)
  group by q.qid, q.concept, q.ph, q.near, q.nc, q.plen, p.id_tesis, p.col, p.pos - q.off
  having count(*) = q.plen),
inst2 as materialized (select * from inst where near is null
  union all
  select distinct a.* from inst a join inst b
    on a.qid = b.qid and a.id_tesis = b.id_tesis and a.col = b.col and a.concept <> b.concept
   and case when b.start >= a.start then b.start - (a.start + a.plen)
            else a.start - (b.start + b.plen) end <= a.near)"""
MATCHED = "matched as (select qid, id_tesis from inst2 group by 1, 2, nc having count(distinct concept) = nc)"
SCORED = f"""tf as (select qid, concept, ph, nc, id_tesis, count(*)::double as f from inst2 group by all),
df as (select qid, concept, ph, count(distinct id_tesis) as n from inst group by all),
scored as materialized (select tf.qid, tf.id_tesis,
  sum(cast(floor(greatest(ln((cs.n - df.n + 0.5::double) / (df.n + 0.5::double)), 1e-6::double)
    * (tf.f * 2.2::double / (tf.f + 1.2::double * (0.25::double + 0.75::double * dl.d / cs.avgd)))
    * 1e12::double + 0.5::double) as bigint)) as units
  from tf join df using (qid, concept, ph) join dl using (id_tesis) cross join cs
  group by tf.qid, tf.id_tesis, tf.nc having count(distinct tf.concept) = tf.nc)"""
BM25 = "round(-(units::double) / 1e12::double, 6)"

BY = {
    "vinculancia": f"{FORCE}, units desc, anio desc nulls last, id_tesis",
    "relevancia": "units desc, anio desc nulls last, id_tesis",
    "reciente": "anio desc nulls last, id_tesis desc",
    "cronologico": f"anio asc nulls first, {FORCE}, id_tesis",
    "similitud": f"units desc, {FORCE}, id_tesis",
}


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def search(concepts, columns: str, *, scope="todo", near=None, where="true", order="vinculancia",
           limit=25, tail: str = "", extra: tuple[str, ...] = ()) -> str:
    ranked = f"""ranked as materialized (select * from (
  select qid, cast(row_number() over (partition by qid order by {BY[order]}) as int) as rank, {LEVEL} as nivel,
    {BM25} as bm25, t.*
  from scored join tesis t using (id_tesis) where {where}) where rank <= {limit})"""
    return with_(TESIS, POST, phrases(concepts, scope, near), HITS, SCORED, ranked, *extra) + (
        tail or f"select {columns} from ranked")


# Snippets of the ranked criteria: every window that starts at a hit or at the
# sentence of a hit is scored; see the rules in the library's snippet module.
SNIPPET = """pieces as materialized (select id_tesis,
    regexp_extract_all(texto, '([^\\p{L}\\p{N}]*)([\\p{L}\\p{N}][\\p{L}\\p{N}\\p{Mn}]*)', 1) as gaps,
    regexp_extract_all(texto, '([^\\p{L}\\p{N}]*)([\\p{L}\\p{N}][\\p{L}\\p{N}\\p{Mn}]*)', 2) as ws,
    regexp_extract(texto, '[^\\p{L}\\p{N}]*$') as tail from ranked),
hit as materialized (select i.id_tesis, i.start as pos, i.plen, i.concept, i.ph, i.concept * 1000 + i.ph as k
  from inst2 i join ranked r using (id_tesis) where i.col = 'texto'),
sent as (select id_tesis, pos from (select id_tesis, unnest(gaps) as g, unnest(range(len(gaps))) as pos
    from pieces where len(ws) > 15) where pos = 0 or regexp_matches(g, '[.:][ \\t\\n\\r]+\\z')),
start_at as (select id_tesis, pos from hit union select id_tesis, pos from sent),
wins as materialized (select s.id_tesis, s.pos, count(*) + 999 * count(distinct h.k) as score,
    max(h.pos) as lastpos, arg_max(h.pos + h.plen, h.pos * 1000000 + h.k) as lastend
  from start_at s join hit h on h.id_tesis = s.id_tesis and h.pos between s.pos and s.pos + 14
  group by 1, 2),
mine as (select h.id_tesis, h.pos, h.k, 0 as kind, w.score,
    greatest(least(h.pos - trunc((15 - (w.lastend - h.pos)) / 2.0), len(p.ws) - 15), 0) as start
  from hit h join wins w on w.id_tesis = h.id_tesis and w.pos = h.pos join pieces p on p.id_tesis = h.id_tesis),
begun as (select h.id_tesis, h.pos, h.k, max(s.pos) as spos from hit h join sent s
  on s.id_tesis = h.id_tesis and s.pos <= h.pos group by 1, 2, 3),
theirs as (select b.id_tesis, b.pos, b.k, 1 as kind,
    coalesce(w.score, 0) + case when b.spos = 0 then 120 else 100 end as score, b.spos as start
  from begun b left join wins w on w.id_tesis = b.id_tesis and w.pos = b.spos where b.spos < b.pos),
best as (select id_tesis, cast(start as bigint) as start from (select *, row_number() over (partition by id_tesis
    order by score desc, pos, k, kind) as r from (select * from mine union all select * from theirs)) where r = 1),
chain as (select *, max(pos + plen - 1) over (partition by id_tesis order by pos, k
    rows between unbounded preceding and 1 preceding) as reached from hit),
runs as (select *, sum(case when reached is null or pos > reached then 1 else 0 end)
    over (partition by id_tesis order by pos, k rows unbounded preceding) as run from chain),
spans as (select id_tesis, run, min(pos) as a, max(pos + plen - 1) as z from runs group by 1, 2),
win as (select p.*, coalesce(b.start, 0) as start from pieces p left join best b using (id_tesis)),
toks as (select w.id_tesis, w.start, i, w.gaps[i + 1] as g, w.ws[i + 1] as t
  from win w, unnest(range(w.start, least(w.start + 15, len(w.ws)))) as u(i)),
marked as (select k.id_tesis, k.i,
    (case when k.i > k.start or k.i = 0 then k.g else '' end)
    || (case when exists (select 1 from spans s where s.id_tesis = k.id_tesis and s.a = k.i) then '«' else '' end)
    || k.t
    || (case when exists (select 1 from spans s where s.id_tesis = k.id_tesis and s.a between k.start and k.start + 14
          and least(s.z, k.start + 14) = k.i) then '»' else '' end) as piece
  from toks k),
frag as (select w.id_tesis, (case when w.start > 0 then ' … ' else '' end)
    || coalesce((select string_agg(m.piece, '' order by m.i) from marked m where m.id_tesis = w.id_tesis), '')
    || (case when w.start + 14 >= len(w.ws) - 1 then w.tail else ' … ' end) as fragmento from win w)"""

LISTED = "rubro, tipo_tesis, instancia, organo_juris, epoca, anio, materias, tesis_codigo, fuente"
TITLED = "rank, id_tesis, nivel, bm25, rubro, anio, organo_juris"
SYNONYMS = ["mente", "constitucional civil", "nicht"]
A, B, C = ["mente", "nicht"], ["the that", "la"], ["de", "die"]


def simple(sql: str) -> str:
    return with_(TESIS) + sql


def indexed(sql: str) -> str:
    return with_(TESIS, POST) + sql


def hits(concepts, sql: str, scope="todo", near=None) -> str:
    return with_(TESIS, POST, phrases(concepts, scope, near), HITS, MATCHED) + sql


# -- sources, ingest, sinks -------------------------------------------------

ORACLES["corpus_scan"] = simple(
    "select id_tesis, rubro, epoca, instancia, organo_juris, fuente, tipo_tesis, anio, mes, materias, "
    "tesis_codigo, huella_digital, md5(texto) as texto_md5, precedentes, "
    "strftime(fecha_descarga, '%Y-%m-%d %H:%M:%S') as fecha_descarga from tesis")

INCOMING = """incoming as materialized (
  select id_tesis, rubro || ' (revisada)' as rubro, epoca, instancia, organo_juris, fuente, tipo_tesis, anio, mes,
    materias, tesis_codigo, huella_digital, texto, precedentes
  from tesis where id_tesis in (select cast(doc_id as varchar) from labels)
  union all
  select 'p' || cast(page_id as varchar), url, '', '', '', '', 'Tesis Aislada', 2024, '', 'Común', '', '', html, ''
  from pages)"""
UPSERTED = INCOMING + """,
upserted as materialized (select * exclude (fecha_descarga) from tesis where id_tesis not in (select id_tesis from incoming)
  union all by name select * from incoming)"""
_LOADED = "select id_tesis, rubro, anio, md5(texto) as texto_md5 from "
ORACLES["ingest_normalize"] = with_(TESIS, INCOMING) + (
    "select id_tesis, rubro, epoca, instancia, organo_juris, fuente, tipo_tesis, anio, mes, materias, "
    "tesis_codigo, huella_digital, md5(texto) as texto_md5, precedentes from incoming")
ORACLES["ingest_ids"] = "select cast(doc_id as varchar) as id_tesis from documents where (doc_id // 100) % 7 <> 6"
ORACLES["ingest_new_ids"] = (
    "select 'p' || cast(page_id as varchar) as id_tesis from pages "
    "union select 'b' || cast(item_id as varchar) from benchmark")
ORACLES["ingest_upsert"] = with_(TESIS, UPSERTED) + (
    "select id_tesis, rubro, anio, materias, tipo_tesis, md5(texto) as texto_md5 from upserted")
ORACLES["ingest_rejects"] = (
    "select 'b' || cast(item_id as varchar) as requested_id, text as payload from benchmark")
ORACLES["ingest_run_log"] = """select p.n as nuevas, b.n as errores, d.n + p.n as total,
  'Completado con ' || b.n || ' error(es) - ' || p.n || ' nuevas' as estado
from (select count(*) as n from pages) p, (select count(*) as n from benchmark) b, (select count(*) as n from documents) d"""
ORACLES["ingest_reconcile"] = """select l.n + p.n + b.n as reportado, d.n as antes, d.n + p.n as despues, p.n as delta,
  l.n + b.n - d.n as faltan
from (select count(*) as n from pages) p, (select count(*) as n from benchmark) b, (select count(*) as n from documents) d,
  (select count(*) as n from labels where doc_id in (select doc_id from documents)) l"""
ORACLES["ingest_incremental"] = with_(TESIS, INCOMING) + _LOADED + "incoming"
ORACLES["ingest_stream"] = ORACLES["ingest_incremental"]
ORACLES["ingest_streams"] = ORACLES["ingest_incremental"]
ORACLES["corpus_layout"] = simple(
    f"select {fold('epoca')} as epoca_part, epoca, count(*) as total, min(anio) as anio_min, max(anio) as anio_max "
    "from tesis group by 1, 2")
_TEXTS = ("id_tesis rubro epoca instancia organo_juris fuente tipo_tesis mes materias tesis_codigo "
          "huella_digital texto precedentes").split()
ORACLES["column_weights"] = simple(" union all ".join(
    f"select '{c}' as columna, cast(sum(length({c})) as bigint) as caracteres from tesis" for c in _TEXTS))

# -- text index -------------------------------------------------------------

_COLS = ("rubro", "texto", "precedentes", "materias")
ORACLES["tokenize"] = simple(
    "select id_tesis, cast(" + " + ".join(f"len({c}_t)" for c in _COLS) + " as int) as dl, "
    + ", ".join(f"md5(array_to_string({c}_t, ' ')) as {c}_md5" for c in _COLS)
    + " from (select id_tesis, " + ", ".join(f"{tok(c)} as {c}_t" for c in _COLS) + " from tesis)")
ORACLES["postings_build"] = indexed(
    "select tok, count(distinct id_tesis) as documentos, count(*) as veces, cast(sum(pos) as bigint) as posiciones "
    "from post group by 1")
ORACLES["doc_stats"] = indexed("select id_tesis, cast(d as int) as dl from dl")
ORACLES["term_stats"] = indexed(
    "select tok, count(distinct id_tesis) as df, count(distinct case when col = 'rubro' then id_tesis end) as df_rubro, "
    "count(distinct case when col = 'texto' then id_tesis end) as df_texto from post group by 1")
_UP_FIELDS = " union all ".join(f"select id_tesis, {tok(c)} as tk from upserted" for c in _COLS)
ORACLES["postings_refresh"] = with_(TESIS, UPSERTED) + (
    f"select id_tesis, count(*) as veces, count(distinct tok) as distintos from "
    f"(select id_tesis, unnest(tk) as tok from ({_UP_FIELDS})) group by 1")
ORACLES["postings_removed"] = indexed(
    "select id_tesis, count(*) as veces, count(distinct tok) as distintos from post "
    "where id_tesis not in (select cast(doc_id as varchar) from labels) group by 1")
_UP_COLS = " union all ".join(f"select id_tesis, '{c}' as col, {tok(c)} as tk from upserted" for c in _COLS)
ORACLES["refreshed_terms"] = with_(TESIS, UPSERTED) + (
    "select tok, count(distinct id_tesis) as df, count(distinct case when col = 'rubro' then id_tesis end) as df_rubro, "
    "count(distinct case when col = 'texto' then id_tesis end) as df_texto "
    f"from (select id_tesis, col, unnest(tk) as tok from ({_UP_COLS})) group by 1")
_BUCKET16 = "cast(cast('0x' || substr(md5(id_tesis), 1, 7) as bigint) % 16 as int)"
ORACLES["refresh_segments"] = with_(TESIS, UPSERTED) + f"""
select u.bucket, i.listed, u.docs, u.tokens from
  (select {_BUCKET16} as bucket, count(*) as docs,
     cast(sum({" + ".join(f"len({tok(c)})" for c in _COLS)}) as bigint) as tokens from upserted group by 1) u
  join (select {_BUCKET16} as bucket, count(*) as listed from incoming group by 1) i on i.bucket = u.bucket"""


def _tokens_of(rows: str) -> str:
    """Criteria of a table with the number of their tokens, counted from their texts."""
    lengths = " + ".join(f"len({tok(c)})" for c in _COLS)
    return f"select id_tesis, rubro, anio, md5(texto) as texto_md5, nullif({lengths}, 0)::bigint as tokens from {rows}"


_FIRST_LOAD = "(select * from incoming where id_tesis like 'p%')"
ORACLES["ingest_interrupted"] = with_(TESIS, INCOMING) + _tokens_of(_FIRST_LOAD)
ORACLES["ingest_version"] = ORACLES["ingest_interrupted"]
ORACLES["ingest_retried"] = with_(TESIS, INCOMING) + _tokens_of("incoming")

_SENTENCES = """qp as materialized (select cast(item_id as varchar) as qid, 0 as concept, ph, txt, 'todo' as scope,
  cast(null as int) as near, 1 as nc, item_id
  from (select item_id, unnest(s) as txt, unnest(range(len(s))) as ph
        from (select item_id, regexp_split_to_array(text, '[.\\n]+') as s from benchmark)))"""
ORACLES["query_terms"] = with_(_SENTENCES) + f"""
select qid as query_id, tok, count(*) as veces, cast(max(plen) as int) as plen, cast(sum(off) as bigint) as off
from (select qid, len(tk) as plen, unnest(tk) as tok, unnest(range(len(tk))) as off
      from (select qid, {tok('txt')} as tk from qp) where len(tk) > 0) group by 1, 2"""

# -- matching ---------------------------------------------------------------

ORACLES["match_term"] = hits([["mente"]], "select id_tesis, col, cast(count(*) as int) as veces from inst group by 1, 2")
ORACLES["match_phrase"] = hits([["the that"]], "select id_tesis, col, cast(start as int) as inicio from inst")
ORACLES["match_or"] = hits([SYNONYMS], "select id_tesis from matched")
ORACLES["match_and_many"] = hits(
    [["the", "de"] if n % 2 else ["the", "de", "und"] for n in range(70)], "select id_tesis from matched")
ORACLES["match_and"] = hits([A, B], "select id_tesis from matched")
ORACLES["match_near"] = hits(
    [["the that"], ["and"]], "select id_tesis, col, concept, cast(start as int) as inicio from inst2", near=3)
ORACLES["match_rubro"] = hits([["mente", "the that"]], "select id_tesis from matched", "rubro")
ORACLES["match_texto"] = hits([["mente", "contradiccion de tesis"]], "select id_tesis from matched", "texto")
ORACLES["match_bag"] = hits([["mente", "nicht", "aning", "the", "or", "the"]], "select id_tesis from matched")


def _like(terms: list[str]) -> str:
    return "(" + " or ".join(
        f"contains({fold('texto')}, '{t}') or contains({fold('rubro')}, '{t}')" for t in terms) + ")"


ORACLES["scan_or"] = simple(f"select id_tesis from tesis where {_like(['cion de', 'nicht'])}")
ORACLES["scan_and"] = simple(
    f"select id_tesis from tesis where {_like(['mente', 'nicht'])} and {_like(['die', 'la'])}")
ORACLES["scan_contradiction"] = simple(
    "select id_tesis from tesis where " + " or ".join(
        f"{fold(c)} like '%contradicci%de tesis%' or {fold(c)} like '%contradicci%de criterios%'" for c in _COLS[:3]))

# -- filters ----------------------------------------------------------------


def _filter(name: str, column: str, where: str) -> None:
    ORACLES[name] = simple(f"select id_tesis, {column} from tesis where {where}")


_filter("filter_binding", "tipo_tesis", "lower(tipo_tesis) like '%jurisprudencia%'")
_filter("filter_subject", "materias", f"{fold('materias')} like '%comun%'")
_filter("filter_organ", "organo_juris", f"{fold('organo_juris')} like '%decimo septimo%'")
_filter("filter_years", "anio", "anio between 2003 and 2012")
_filter("filter_epochs", "epoca", "epoca in ('Décima Época', 'Undécima Época')")
CIRCUIT17 = f"""{IS_BINDING} and (instancia = {SCJN} or lower(instancia) like '%plenos regionales%'
  or ((lower(instancia) like '%plenos de circuito%' or lower(instancia) like '%tribunales colegiados%')
      and {circuit_of_court('organo_juris')} = 17))"""
_filter("filter_circuit", "organo_juris", CIRCUIT17)
for _name, _where in {
    "scjn": f"instancia = {SCJN}",
    "pleno_scjn": f"instancia = {SCJN} and lower(organo_juris) like 'pleno%'",
    "salas_scjn": f"instancia = {SCJN} and lower(organo_juris) like '%sala%'",
    "primera_sala": f"instancia = {SCJN} and lower(organo_juris) like 'primera sala%'",
    "segunda_sala": f"instancia = {SCJN} and lower(organo_juris) like 'segunda sala%'",
    "plenos_regionales": "lower(instancia) like '%plenos regionales%'",
    "plenos_circuito": "lower(instancia) like '%plenos de circuito%'",
    "tcc": "lower(instancia) like '%tribunales colegiados%'",
}.items():
    _filter(f"filter_preset_{_name}", "organo_juris", _where)


def _cut(c: str, n: int) -> str:
    return f"case when length({c}) > {n} then substr({c}, 1, {n}) || '... [truncado]' else {c} end"


_FULL = f"{LEVEL} as nivel, {LISTED}, {_cut('texto', 8000)} as texto, {_cut('precedentes', 2000)} as precedentes"


def _read(where: str, limit: int) -> str:
    return simple(
        f"select cast(row_number() over (order by id_tesis) as int) as rank, id_tesis, {_FULL} from "
        f"(select * from tesis where {where} order by id_tesis limit {limit})")


ORACLES["read_one"] = _read("id_tesis = '77'", 1)
ORACLES["read_by_code"] = _read("contains(tesis_codigo, '7/2')", 5)
ORACLES["read_by_title"] = _read(f"contains({fold('rubro')}, 'cai')", 5)
_KEYS = ", ".join(f"'{n}'" for n in list(range(3, 200, 13))[:15])
_LABELLED = "(select cast(doc_id as varchar) from labels)"
ORACLES["read_keys"] = simple(f"select id_tesis, rubro, md5(texto) as texto_md5 from tesis where id_tesis in {_LABELLED}")
_CODES = ", ".join(f"'T. {n}/{1995 + n % 31}'" for n in range(5, 200, 14))
ORACLES["read_many_by_code"] = simple(f"select id_tesis, {_FULL} from tesis where tesis_codigo in ({_CODES})")
ORACLES["read_many"] = simple(f"select id_tesis, {_FULL} from tesis where id_tesis in ({_KEYS})")

# -- scalar functions -------------------------------------------------------

ORACLES["binding_level"] = simple(f"select id_tesis, {LEVEL} as nivel from tesis")
ORACLES["binding_bucket"] = simple(
    f"select id_tesis, case when {IS_BINDING} then 0 else 1 end as aislada, {BUCKET} as cubo from tesis")
_EPOCHS = ["Primera", "Segunda", "Tercera", "Cuarta", "Quinta", "Sexta", "Séptima", "Octava", "Novena",
           "Décima", "Undécima", "Duodécima"]
_EPOCH_CASE = "case " + " ".join(
    f"when k in ('{e.lower().replace('é', 'e')}', '{n}', '{ROMANS[n - 1]}') then '{e} Época'"
    for n, e in enumerate(_EPOCHS, 1)) + " end"
ORACLES["normalize_epoch"] = simple(f"""select id_tesis, n, {_EPOCH_CASE} as epoca from (
  select id_tesis, n, trim(replace({fold('s')}, 'epoca', '')) as k from (
    select id_tesis, unnest([0, 1, 2, 3]) as n,
      unnest([upper(epoca), split_part(epoca, ' ', 1), cast(anio - 1994 as varchar), materias]) as s from tesis))""")
_DEL = fold("regexp_extract(organo_juris, 'del (.*) Circuito', 1)")
ORACLES["parse_circuit"] = simple(f"""select id_tesis,
  case when anio - 1990 between 1 and 32 then anio - 1990 end as de_numero,
  {_case(f"replace(regexp_extract({_DEL}, '^(?:{_ORD_RE})'), ' ', '')", _ORDINALS)} as de_ordinal,
  {circuit_of_court('organo_juris')} as de_organo from tesis""")
_CITE = ("tipo_tesis || ', ' || tesis_codigo || ', ' || fuente || ', ' || epoca || ', ' || mes || ' de ' || anio "
         "|| ', registro digital: ' || id_tesis || '.'")
ORACLES["cite"] = simple(
    f"select id_tesis, {_CITE} as cita, md5('Cita oficial:' || chr(10) || '  ' || {_CITE} || chr(10) || chr(10) "
    "|| 'Rubro:' || chr(10) || '  ' || rubro || chr(10) || chr(10) || 'Órgano emisor: ' || instancia || ' — ' "
    "|| organo_juris) as ficha from tesis")
ORACLES["cite_by_code"] = simple(f"select id_tesis, {_CITE} as cita, rubro from tesis where tesis_codigo = 'T. 77/2010'")
ORACLES["extract"] = simple(
    f"select id_tesis, substr(texto, 1, 500) as extracto, md5({_cut('texto', 8000)}) as texto_md5, "
    f"cast(length({_cut('texto', 8000)}) as int) as largo from tesis")
ORACLES["title_keywords"] = simple(
    f"select id_tesis, array_to_string(({words('rubro')})[1:8], ' ') as palabras from tesis")

_WITH_FRAG = "select {} from ranked join frag using (id_tesis)"
ORACLES["snippet"] = search(
    [SYNONYMS + ["the that"]], "", limit=100, extra=(SNIPPET,),
    tail=_WITH_FRAG.format("rank, id_tesis, fragmento"))
_CARD = """'--- Resultado ' || rank || ' (Nivel ' || nivel || ') ---' || chr(10) || 'ID: ' || id_tesis || chr(10)
  || 'Rubro: ' || rubro || chr(10) || 'Codigo: ' || tesis_codigo || chr(10) || 'Tipo: ' || tipo_tesis || chr(10)
  || 'Instancia: ' || instancia || chr(10) || 'Organo: ' || organo_juris || chr(10) || 'Epoca: ' || epoca || chr(10)
  || 'Anio: ' || anio || chr(10) || 'Materia: ' || materias || chr(10) || 'Fuente: ' || fuente || chr(10)"""
ORACLES["render"] = search(
    [SYNONYMS], "", limit=40, extra=(SNIPPET,),
    tail=_WITH_FRAG.format(f"rank, {_CARD} || 'Fragmento relevante: ' || fragmento as ficha"))
ORACLES["render_full"] = simple(
    f"select rank, {_CARD} || 'Texto completo:' || chr(10) || {_cut('texto', 8000)} "
    f"|| case when precedentes <> '' then chr(10) || 'Precedentes: ' || {_cut('precedentes', 2000)} else '' end as ficha "
    f"from (select cast(row_number() over (order by id_tesis) as int) as rank, *, {LEVEL} as nivel from "
    "(select * from tesis where contains(lower(tesis_codigo), 't. 1') order by id_tesis limit 5))")

# -- aggregates, scores, orders ---------------------------------------------


def _bm25(concepts, scope="todo", near=None) -> str:
    return with_(TESIS, POST, phrases(concepts, scope, near), HITS, SCORED) + (
        f"select id_tesis, {BM25} as bm25 from scored")


ORACLES["bm25"] = _bm25([SYNONYMS + ["the"]])
ORACLES["bm25_title"] = _bm25([["mente", "the that"]], "rubro")
ORACLES["bm25_near"] = _bm25([["the that"], ["and"]], near=3)
_FACETS = ("tipo_tesis", "epoca", "instancia", "materias", "organo_juris", "fuente")
for _c in _FACETS:
    ORACLES[f"facet_{_c}"] = simple(
        f"select {_c} as valor, count(*) as total from tesis where {_c} is not null and {_c} <> '' "
        "group by 1 order by 2 desc, 1 limit 30")
ORACLES["facet_all"] = simple(
    "select * from (select campo, valor, count(*) as total, "
    "cast(row_number() over (partition by campo order by count(*) desc, valor) as int) as lugar from ("
    + " union all ".join(f"select '{c}' as campo, {c} as valor from tesis" for c in _FACETS)
    + ") where valor <> '' group by 1, 2) where lugar <= 30")
ORACLES["corpus_summary"] = simple(
    "select count(*) as total, min(anio) as anio_min, max(anio) as anio_max, "
    "strftime(max(fecha_descarga), '%Y-%m-%d %H:%M:%S') as ultima_descarga from tesis")
ORACLES["kept_facets"] = with_(TESIS, UPSERTED) + (
    "select * from (select campo, valor, count(*) as total, "
    "cast(row_number() over (partition by campo order by count(*) desc, valor) as int) as lugar from ("
    + " union all ".join(f"select '{c}' as campo, {c} as valor from upserted" for c in _FACETS)
    + ") where valor <> '' group by 1, 2) where lugar <= 30")
ORACLES["kept_summary"] = with_(TESIS, UPSERTED) + (
    "select count(*) as total, min(anio) as anio_min, max(anio) as anio_max from upserted")
ORACLES["kept_breakdown"] = with_(TESIS, UPSERTED) + (
    "select dimension, valor, total, cast(row_number() over (partition by dimension order by total desc, valor) as int) "
    "as lugar from (" + " union all ".join(
        f"select '{c}' as dimension, {c} as valor, count(*) as total from upserted {w} group by 2"
        for c, w in (("tipo_tesis", ""), ("instancia", "where instancia <> ''"), ("epoca", "where epoca <> ''"))) + ")")
ORACLES["describe_last_load"] = with_(TESIS, INCOMING) + (
    "select 0::bigint + (select count(*) from incoming where id_tesis not like 'p%') as nuevas, (select count(*) from benchmark) as errores, "
    "(select count(*) from incoming) as total, 'Completado con ' || (select count(*) from benchmark) || ' error(es) - ' "
    "|| (select count(*) from incoming where id_tesis not like 'p%') || ' nuevas' as estado")
ORACLES["corpus_breakdown"] = simple(
    "select dimension, valor, total, cast(row_number() over (partition by dimension order by total desc, valor) as int) "
    "as lugar from (" + " union all ".join(
        f"select '{c}' as dimension, {c} as valor, count(*) as total from tesis group by 2"
        for c in ("tipo_tesis", "instancia", "epoca")) + ")")


def _order(order: str) -> str:
    return search([SYNONYMS], TITLED, order=order, limit=100)


ORACLES["order_binding"] = _order("vinculancia")
ORACLES["order_relevance"] = _order("relevancia")
ORACLES["order_recent"] = _order("reciente")

_PASSAGE_RANK = f"""params as (select cast(item_id as varchar) as qid, item_id % 2 = 1 as solo, item_id % 5 = 1 as corte,
    case when item_id % 7 = 1 then 2000 else 0 end as desde, item_id % 3 as modo, item_id % 20 + 1 as lim from benchmark),
found as (select s.qid, s.units, t.*, p.modo, p.lim from scored s join tesis t using (id_tesis) join params p using (qid)
  where (not solo or {IS_BINDING}) and (not corte or instancia = {SCJN}) and anio >= desde),
ranked as (select * from (
    select *, cast(row_number() over (partition by qid order by {BY['vinculancia']}) as int) as rank from found where modo = 0
    union all
    select *, cast(row_number() over (partition by qid order by {BY['relevancia']}) as int) as rank from found where modo = 1
    union all
    select *, cast(row_number() over (partition by qid order by {BY['reciente']}) as int) as rank from found where modo = 2)
  where rank <= lim)"""
_BATCH = f"select qid as query_id, rank, id_tesis, {LEVEL} as nivel, {BM25} as bm25 from ranked"
ORACLES["search_batch"] = with_(TESIS, POST, _SENTENCES, HITS, SCORED, _PASSAGE_RANK) + _BATCH
ORACLES["result_summary"] = with_(TESIS, POST, _SENTENCES, HITS, SCORED, _PASSAGE_RANK) + (
    "select query_id, count(*) as total, count(*) filter (nivel in ('S', 'A', 'B', 'C', 'D')) as jurisprudencias, "
    "count(*) filter (nivel in ('E', 'F')) as aisladas, "
    + ", ".join(f"count(*) filter (nivel = '{x}') as nivel_{x.lower()}" for x in "SABCDEF")
    + f" from ({_BATCH}) group by 1")
_WORDS = f"""qp as materialized (select cast(item_id as varchar) as qid, 0 as concept, ph, txt, 'todo' as scope,
  cast(null as int) as near, 1 as nc
  from (select item_id, unnest(s) as txt, unnest(range(len(s))) as ph
        from (select item_id, list_distinct({words('text')}) as s from benchmark)))"""
ORACLES["topk_per_query"] = with_(TESIS, POST, _WORDS, HITS, SCORED) + (
    f"select * from (select qid as query_id, cast(row_number() over (partition by qid order by {BY['relevancia']}) as int) as rank, "
    f"id_tesis, {LEVEL} as nivel, {BM25} as bm25 from scored join tesis using (id_tesis)) where rank <= 10")


def _pair_order(order: str) -> str:
    return f"""select id_tesis, nivel from (select id_tesis, {LEVEL} as nivel, row_number() over (order by {BY[order]}) as r
  from scored join tesis using (id_tesis)) where r <= 50"""


ORACLES["result_diff"] = with_(TESIS, POST, phrases([SYNONYMS]), HITS, SCORED,
                               f"a as ({_pair_order('vinculancia')})", f"b as ({_pair_order('relevancia')})") + (
    "select *, 'antes' as lado from (select * from a except all select * from b) union all "
    "select *, 'despues' as lado from (select * from b except all select * from a)")

# -- composite queries ------------------------------------------------------

ORACLES["search_concept"] = search(
    [SYNONYMS], "", where=f"{fold('materias')} like '%civil%' and anio >= 2000", limit=50, extra=(SNIPPET,),
    tail=_WITH_FRAG.format(f"rank, id_tesis, nivel, bm25, {LISTED}, fragmento, substr(texto, 1, 500) as extracto"))
ORACLES["search_concept_scan"] = simple(
    f"select * from (select cast(row_number() over (order by {FORCE}, anio desc, id_tesis) as int) as rank, id_tesis, {LEVEL} as nivel, "
    f"rubro, substr(texto, 1, 500) as extracto from tesis where {_like(['mente', 'nicht'])} and {IS_BINDING}) where rank <= 50")
_MENTION = " or ".join(f"{fold(c)} like '%contradicci%de {w}%'" for c in _COLS[:3] for w in ("tesis", "criterios"))


def _scan(where: str, limit: int) -> str:
    return simple(
        f"select * from (select cast(row_number() over (order by {FORCE}, anio desc, id_tesis) as int) as rank, id_tesis, "
        f"{LEVEL} as nivel, rubro from tesis where {where}) where rank <= {limit}")


ORACLES["search_title_scan"] = _scan(
    f"contains({fold('rubro')}, 'mente') or contains({fold('rubro')}, 'the that')", 50)
ORACLES["search_intersection_scan"] = _scan(f"{_like(A)} and {_like(B)} and anio >= 2001", 50)
ORACLES["search_contradiction_scan"] = _scan(f"{_like(['la', 'the'])} and {IS_BINDING} and ({_MENTION})", 60)
ORACLES["search_circuit_scan"] = _scan(f"{_like(['mente', 'the', 'la'])} and {CIRCUIT17}", 100)
ORACLES["search_intersection"] = search(
    [A, B], TITLED, where="epoca in ('Décima Época', 'Undécima Época')", limit=50)
ORACLES["search_intersection3"] = search([A, B, C], TITLED, order="relevancia", limit=50)
_FRAGGED = _WITH_FRAG.format("rank, id_tesis, nivel, bm25, rubro, fragmento")
ORACLES["search_near"] = search(
    [["the that"], ["and"]], "", near=3, where=f"instancia = {SCJN}", limit=50, extra=(SNIPPET,), tail=_FRAGGED)
ORACLES["search_title"] = search(
    [["mente", "the that"]], "", scope="rubro", limit=50, extra=(SNIPPET,), tail=_FRAGGED)
ORACLES["search_contradiction"] = search(
    [["la", "the"], ["contradiccion de tesis", "contradiccion de criterios"]], TITLED,
    where=f"{IS_BINDING} and anio >= 2001", limit=60)
_REF_WORDS = f"""qp as (select '0' as qid, 0 as concept, ph, txt, 'todo' as scope, cast(null as int) as near, 1 as nc
  from (select unnest(s) as txt, unnest(range(len(s))) as ph
        from (select ({words('rubro')})[1:8] as s from tesis where id_tesis = '138')))"""
ORACLES["search_similar"] = with_(TESIS, POST, _REF_WORDS, HITS, SCORED) + (
    f"select * from (select cast(row_number() over (order by {BY['similitud']}) as int) as rank, id_tesis, {LEVEL} as nivel, "
    f"{BM25} as bm25, rubro, anio, organo_juris from scored join tesis using (id_tesis) where id_tesis <> '138') "
    "where rank <= 40")
ORACLES["search_circuit"] = search([["mente", "the", "la"]], TITLED, where=CIRCUIT17, limit=100)
ORACLES["timeline"] = search(
    [["mente", "the"]], "", where=f"{IS_BINDING} and anio >= 2010", order="cronologico", limit=80,
    tail="""select rank, cast(sum(opens) over (order by rank) as int) as etapa, opens = 1 as abre_etapa, epoca, anio,
  tesis_codigo, substr(rubro, 1, 140) as rubro, id_tesis, nivel
from (select *, case when lag(epoca) over (order by rank) = epoca then 0 else 1 end as opens from ranked)""")

ORACLES["timeline_scan"] = simple(
    "select rank, cast(sum(opens) over (order by rank) as int) as etapa, opens = 1 as abre_etapa, epoca, anio, tesis_codigo, "
    "substr(rubro, 1, 140) as rubro, id_tesis, nivel from (select *, case when lag(epoca) over (order by rank) = epoca "
    f"then 0 else 1 end as opens from (select *, cast(row_number() over (order by anio asc nulls first, {FORCE}, id_tesis) as int) "
    f"as rank, {LEVEL} as nivel from tesis where {_like(['mente', 'the'])} and {IS_BINDING} and anio >= 2010) where rank <= 80)")

_TURNS = f"""turns as materialized (select conv_id, turn, role, list_distinct({words('text')}) as w from conversations),
said as materialized (select *, row_number() over (partition by conv_id order by turn) - 1 as n,
  count(*) over (partition by conv_id) as users from turns where role = 'user'),
answer as (select conv_id, w from (select conv_id, list_distinct(flatten(list(w))) as w
  from turns where role = 'assistant' group by 1) where len(w) > 0),
everyone as (select conv_id from turns group by 1),
flat as (select conv_id, list_distinct(flatten(list(w))) as w from said group by 1),
q as (
  select conv_id || '|1 concepto|' || n as qid, 0 as concept, 1 as nc, w from said
  union all select conv_id || '|2 cruce|0', n, users, w from said where users >= 2
  union all select e.conv_id || '|4 contradiccion|0', 0, 2, coalesce(w, []) from everyone e left join flat using (conv_id)
  union all select conv_id || '|4 contradiccion|0', 1, 2, ['contradiccion de tesis', 'contradiccion de criterios'] from everyone
  union all select conv_id || '|5 contraparte|0', 0, 1, w from answer),
qp as materialized (select qid, concept, unnest(range(len(w))) as ph, unnest(w) as txt, 'todo' as scope,
  cast(null as int) as near, nc from q)"""
ORACLES["dossier"] = with_(TESIS, POST, _TURNS, HITS, SCORED) + f"""
select case_id, id_tesis, nivel, array_to_string(list_sort(list_distinct(list(ronda))), ', ') as rondas, min(rank) as mejor,
  min(bm25) as bm25, cast(row_number() over (partition by case_id order by nivel, min(rank), id_tesis) as int) as lugar,
  row_number() over (partition by case_id order by nivel, min(rank), id_tesis) <= 10 as leer
from (select split_part(qid, '|', 1) as case_id, split_part(qid, '|', 2) as ronda, id_tesis, {LEVEL} as nivel, {BM25} as bm25,
    cast(row_number() over (partition by qid order by {BY['vinculancia']}) as int) as rank
  from scored join tesis using (id_tesis)
  where not contains(qid, '4 contradiccion') or {IS_BINDING}) where rank <= 15
group by case_id, id_tesis, nivel"""
ORACLES["dossier_read"] = (
    "select case_id, lugar, id_tesis, nivel, rondas, rubro, md5(texto) as texto_md5, "
    "md5(precedentes) as precedentes_md5 from (" + ORACLES["dossier"]
    + ") join (" + simple("select id_tesis, rubro, texto, precedentes from tesis") + ") using (id_tesis) where leer")
_RELATED = {
    "Administrativa": ("Constitucional", "Común"), "Civil": ("Constitucional", "Común", "Mercantil"),
    "Laboral": ("Administrativa", "Constitucional"), "Penal": ("Constitucional", "Común"),
    "Amparo": ("Común", "Constitucional"),
}
_PAIRS = ", ".join(f"('{m}', '{x}')" for m, r in _RELATED.items() for x in (m, *r))
ORACLES["expand_subjects"] = simple(
    f"select m as materia, x as buscada, count(*) as total from (values {_PAIRS}) as p(m, x) "
    f"join tesis on contains({fold('materias')}, {fold('x')}) group by 1, 2")
_EVERY = f"""qp as materialized (select id_tesis as qid, 0 as concept, ph, txt, 'todo' as scope, cast(null as int) as near, 1 as nc
  from (select id_tesis, unnest(s) as txt, unnest(range(len(s))) as ph
        from (select id_tesis, ({words('rubro')})[1:8] as s from tesis
              where id_tesis in (select cast(doc_id as varchar) from labels))))"""
ORACLES["similar_batch"] = with_(TESIS, POST, _EVERY, HITS, SCORED) + (
    f"select * from (select qid as query_id, cast(row_number() over (partition by qid order by {BY['similitud']}) as int) as rank, "
    f"id_tesis, {BM25} as bm25 from scored join tesis using (id_tesis) where qid <> id_tesis) where rank <= 15")

# -- health -----------------------------------------------------------------

ORACLES["health"] = hits([["mente"]], """
select 'tabla con registros' as revision, 'ok' as estado, count(*) || ' registros' as detalle from tesis
union all select 'esquema minimo', 'ok', ''
union all select 'claves', 'ok', '0 con problemas'
union all select 'corpus e indice iguales', 'ok', '0 documentos distintos'
union all select 'busqueda de prueba', 'ok', count(*) || ' documentos para ''mente''' from matched""")
ORACLES["health_verdict"] = hits(
    [["mente"]], "select count(*) > 0 as ok, case when count(*) > 0 then 0 else 1 end::bigint as fallos from matched")
ORACLES["health_drift"] = with_(TESIS, INCOMING) + (
    "select id_tesis, case when id_tesis like 'p%' then 'sin indexar' else 'cambiado' end as desfase from incoming")
ORACLES["health_keys"] = (
    "select cast(doc_id as varchar) as id_tesis, 2::bigint as filas, 'clave repetida' as problema from labels "
    "where doc_id in (select doc_id from documents)")

# The same answers from a library with score bounds.
for _plain, _bounded in (("order_relevance", "order_relevance_bounded"), ("topk_per_query", "topk_bounded"), ("search_similar", "search_similar_bounded")):
    ORACLES[_bounded] = ORACLES[_plain]
