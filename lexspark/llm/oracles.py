"""SQL of the queries that SQL can express, written from their definitions; it runs
over the whole tables. Token ids, XXH64, quantile cells and trained models have none."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = ("all rights reserved|licensed under|released under|terms of use|terms of service|privacy policy|"
           "cookie policy|use of cookies|uses cookies|enable javascript|lorem ipsum|click here|sign up for|"
           "subscribe to our|skip to content|powered by")

ORACLES: dict[str, str] = {}

ORACLES["op5_balltree"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

ORACLES["op8_linefirst"] = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, regexp_extract_all(text, '{WORD}') as w from d),
win as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k
  from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
hit as (
  select r, i from (select r, i, count(*) over (partition by r, k) as n from win) where n > 1),
rep as (
  select r, count(*) as n from (
    select r, i from hit union select r, i + 1 from hit union select r, i + 2 from hit) group by r),
l as (
  select r, line, len(regexp_extract_all(line, '{WORD}')) as n,
    length(line) - length(replace(line, '|', '')) as bars,
    length(regexp_replace(line, '[^!-/:-@\\[-`{{-~]', '', 'g')) as marks
  from (select r, unnest(string_split(text, chr(10))) as line from d)),
f as (
  select r, line, n, case
    when bars >= 2 and 4 * bars >= n then 'nav'
    when 4 * marks > 5 * n or (n >= 20 and not regexp_matches(line, '[.!?,;:]')) then 'mark'
    when n <= 30 and regexp_matches(translate(line, '{UPPER}', '{LOWER}'), '{PHRASES}') then 'boiler'
    else 'good' end as fault
  from l where n > 0),
a as (
  select r, count(*) - count(distinct line) as dup,
    coalesce(sum(n) filter (where fault = 'good'), 0)::bigint as kept_words,
    count(*) filter (where fault = 'nav') as nav, count(*) filter (where fault = 'mark') as mark,
    count(*) filter (where fault = 'boiler') as boiler
  from f group by r),
t as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(dup, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(kept_words, 0) as kept_words,
    coalesce(nav, 0) as n_navigation, coalesce(mark, 0) as n_punctuation, coalesce(boiler, 0) as n_boilerplate
  from d join w using (r) left join a using (r) left join rep using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from t)
select *, not base_failed and 2 * kept_words >= n_words as kept from b
"""

ORACLES["op9_linededup"] = f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (
  select r, doc_id, i, lines[i] as line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as key
  from (select *, unnest(range(1, len(lines) + 1)) as i from d)),
hot as (
  select key, true as hot from (select distinct r, key from l where length(key) >= 1) group by key having count(*) >= 10)
select doc_id, count(*) as n_lines, count(hot) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where hot is null), '')) as kept_sha256
from l left join hot using (key) group by r, doc_id
"""

ORACLES["op10_chat"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t as (
  select *, row_number() over o as i,
    4 + len(regexp_extract_all(role, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]'))
      + len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')) as tokens,
    length('<|im_start|>') + 1 + length('<|im_end|>') + 1
      + length(replace(regexp_replace(role, '<(\|+)', '<\1|', 'g'), chr(10), '<|n|>'))
      + length(regexp_replace(text, '<(\|+)', '<\1|', 'g')) as size
  from c window o as (partition by conv_id order by turn, role)),
b as (
  select *, coalesce(sum(tokens) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) as before
  from t),
s as (
  select *, 2 * floor(before / 768) + (floor((before + tokens - 1) / 768) > floor(before / 768))::int as span from b),
opens as (select conv_id, span, min(i) as i, min(before) as before from s group by conv_id, span),
history as (
  select o.conv_id, sum(s.size) as size from opens o join s
    on s.conv_id = o.conv_id and s.i between o.i - 4 and o.i - 1 and s.before >= o.before - 256
      and not (s.before = 0 and s.role = 'system')
  group by o.conv_id),
heads as (
  select o.conv_id, sum(s.size) as size from opens o join s
    on s.conv_id = o.conv_id and s.before = 0 and s.role = 'system' and o.before > 0
  group by o.conv_id),
w as (
  select conv_id, count(*) as n_turns, sum(size) as size,
    string_agg(role || chr(10) || text || chr(10), '' order by i) as said,
    coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '') as loss
  from s group by conv_id)
select w.conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  (w.size + coalesce(history.size, 0) + coalesce(heads.size, 0))::bigint as formatted_chars
from w left join history using (conv_id) left join heads using (conv_id)
"""

ORACLES["op12_variants"] = rf"""
with recursive
tab as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
runs as (
  select coalesce(doc_id::varchar, '') as id,
    unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
once as (select id, run, count(*) as n from runs where length(run) >= 5 group by id, run),
hashed as (
  select run, n, xor(4294967295, list_reduce(
      flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
        case when ord(c) < 128 then [ord(c)] else [195, ord(c) - 64] end)),
      lambda s, b: xor(s >> 8, t[1 + (xor(s, b::bigint) & 255)]), 4294967295::bigint)) as h
  from once, tab),
words as (
  select word, sum(n)::bigint as n from (
    select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n
    from hashed)
  where length(word) >= 5 group by word having sum(n) >= 3),
cut as (
  select word, i, substr(word, 1, (i - 1)::int) || substr(word, (i + 1)::int) as rest
  from (select word, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select x.word as a, y.word as b from cut x join cut y on x.rest = y.rest and x.i = y.i and x.word <> y.word
  union select word, rest from cut where rest in (select word from words)
  union select rest, word from cut where rest in (select word from words)),
about as (
  select a, count(*) as n_near, first(b order by n desc, b) as b, max(n) as m
  from near join words on b = word group by a),
formed as (
  select word, n, coalesce(n_near, 0) as n_near, case when m >= 2 * n then b end as form, case when m >= 2 * n then m end as form_n
  from words left join about on word = a),
chain as (
  select word, word as root, form from formed
  union all select chain.word, chain.form, f.form from chain join formed f on f.word = chain.form)
select word, formed.form, root, n, n_near, form_n from formed join chain using (word) where chain.form is null
"""
