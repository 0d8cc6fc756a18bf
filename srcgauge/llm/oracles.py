"""DuckDB twins of the queries that SQL can express over the given tables."""

from __future__ import annotations

from srcgauge.llm.licenses import (
    LICENSING, LOWER, RULES, SENTENCES, SPDX, TRIGGER, UPPER,
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: The given pages hold their text in one article without classes.
MAIN_TEXT = r"""
with articles as (
  select page_id, url,
         regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as body
  from pages
), parts as (
  select page_id, url, list_transform(
    regexp_split_to_array(body, '</?(?:p|h1|h2|h3|ul|ol|li|div|section|blockquote)(?: [^>]*)?>'),
    lambda x: trim(regexp_replace(
      replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(x, '<br */?>', ' ', 'g'), '</?[a-z]+[^>]*>', '', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'),
      '\s+', ' ', 'g'))) as blocks
  from articles
), texts as (
  select page_id, url,
         array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as text from parts
)
select page_id, url, text, length(text) as n_chars from texts
"""


def _license_scan() -> str:
    cases = "\n".join(
        f"when regexp_matches(s, {_text(pattern)}) then {_text(name)}" for name, pattern in SENTENCES
    )
    rules = ",\n".join(
        f"{{'name': {_text(name)}, 'rule': {_text(pattern)}, 'found': ''}}" for name, pattern in RULES
    )
    return rf"""
with cut as (
  select doc_id, row_number() over () as r, list_transform(
    string_split(regexp_replace(regexp_replace(regexp_replace(
      translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '([^a-z0-9])v\.[ \t\n\r\f]+([0-9])', '\1v \2', 'g'),
      '([.!?][ \t\n\r\f]+|\n[ \t\r]*\n[ \t\n\r\f]*)', '\1' || chr(30), 'g'),
      '(:[ \t\r]*\n[ \t\n\r\f]*)((?:[*+•-]|\(?[0-9a-z]{{1,3}}[.)])[ \t])', '\1' || chr(30) || '\2', 'g'),
      chr(30)),
    lambda s: trim(regexp_replace(s, '[^a-z0-9.,:+/-]+', ' ', 'g'))) as parts
  from documents
), asked as (
  select doc_id, r, list_filter(parts, lambda s: regexp_matches(s, {_text(TRIGGER)})) as parts from cut
), marked as (
  select doc_id, r, list_transform(parts, lambda s: case
    when regexp_matches(s, {_text(SPDX)})
      then 'Spdx:' || rtrim(regexp_extract(s, {_text(SPDX)}, 1), '.')
    {cases}
    when regexp_matches(s, {_text(LICENSING)}) then '?' end) as ids from asked
), known as (
  select doc_id, r, list_filter(ids, lambda i: i <> '?') as known,
         len(list_filter(ids, lambda i: i = '?')) as n from marked
), steps as (
  select r, list_reduce(
    list_prepend({{'name': '', 'rule': ' ' || array_to_string(known, '  ') || ' ', 'found': ''}},
      [{rules}]),
    lambda state, x: {{'name': '',
      'rule': regexp_replace(state.rule, x.rule, '', 'g'),
      'found': state.found || case when regexp_matches(state.rule, x.rule)
                               then x.name || ',' else '' end}}) as state
  from known where len(known) > 0
), named as (
  select known.doc_id, known.known, known.n, list_sort(list_distinct(list_concat(
    list_filter(string_split(coalesce(state.found, ''), ','), lambda x: x <> ''),
    list_transform(list_filter(known.known, lambda i: starts_with(i, 'Spdx:')), lambda i: substr(i, 6))
  ))) as found
  from known left join steps using (r)
)
select doc_id, array_to_string(found, ',') as licenses,
       array_to_string(known, ' ') as sentence_ids,
       cast(len(known) as bigint) as n_known, cast(n as bigint) as n_unknown
from named
"""


#: Whole numbers as doubles: sums stay exact below 2^53.
TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as w
  from embeddings
  where len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.w, c.w) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.w) = len(c.w)
)
select query_id, cast(row_number() over (
  partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 20
"""

#: Every document is scored for every item that shares a term with it.
RANKED = r"""
with d as (
  select row_number() over () as doc, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), i as (
  select item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), item_terms as (
  select item_id, term, count(*) as times from i group by all
), whole as (
  select count(*) as n_docs, cast(sum(len(terms)) as bigint) as length from d where len(terms) > 0
), frequencies as (
  select doc, term, count(*) as tf from (select doc, unnest(terms) as term from d) group by all
), weights as (
  select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w
  from frequencies, whole group by term
), lengths as (
  select doc, doc_id, 100 - 75 + ((75 * len(terms) * n_docs) // length) as m
  from d, whole where len(terms) > 0
), scored as (
  select item_id, doc_id, doc,
         cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from item_terms join frequencies using (term) join weights using (term) join lengths using (doc)
  group by all
)
select item_id, cast(row_number() over (
  partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""

#: crc32 byte by byte over its table, near words by the places of deleted code points.
VARIANTS = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as steps
), runs as (
  select doc_id, run, count(*) as times
  from (
    select coalesce(cast(doc_id as varchar), '') as doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{00C0}-\x{00FF}]+')) as run
    from documents)
  where length(run) >= 6 group by all
), hashed as (
  select run, times, xor(list_reduce(
    flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
      case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [195, unicode(c) - 64] end)),
    lambda h, b: xor(h >> 8, steps[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) as h
  from runs, crc
), words as (
  select word, cast(sum(times) as bigint) as n
  from (
    select times, case when h % 199 = 0
      then substring(run, 1, cast(h % length(run) as bigint)) || substring(run, cast(h % length(run) as bigint) + 2)
      else run end as word
    from hashed)
  where length(word) >= 6 group by word having sum(times) >= 5
), shorter as (
  select word, spot, substring(word, 1, spot - 1) || substring(word, spot + 1) as rest
  from (select word, unnest(range(1, length(word) + 1)) as spot from words)
), near as (
  select a.word, b.word as other from shorter a join shorter b
    on a.spot = b.spot and a.rest = b.rest and a.word <> b.word
  union select s.word, w.word from shorter s join words w on s.rest = w.word
  union select w.word, s.word from shorter s join words w on s.rest = w.word
), ranked as (
  select near.word, other, o.n as other_n, count(*) over (partition by near.word) as n_near,
         row_number() over (partition by near.word order by o.n desc, other) as place
  from near join words o on o.word = near.other
), formed as (
  select words.word, words.n, coalesce(n_near, 0) as n_near,
         case when other_n >= 5 * words.n then other end as form,
         case when other_n >= 5 * words.n then other_n end as form_n
  from words left join ranked on ranked.word = words.word and place = 1
), chain as (
  select word, word as last, 0 as step from formed
  union all
  select chain.word, formed.form, step + 1 from chain join formed on formed.word = chain.last
  where formed.form is not null
), roots as (
  select word, arg_max(last, step) as root from chain group by word
)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""

ORACLES = {
    "op11_permuterm_variants": VARIANTS,
    "op13_document_fp_tree": RANKED,
    "op9_ball_tree": TOP_K,
    "op3_host_path_text": MAIN_TEXT,
    "op10_sentence_rules": _license_scan(),
}
