"""DuckDB SQL for the rows of those queries that SQL can express; the others are tested against brute force.

SQL has no tokenizer (op1, op4), no XXH64 (op7), no itemset mining (op10) and none of the generator of op3; op2 and op6 work
on character grams and on windows of word bigrams, which SQL could only follow by the million rows a text.
"""

from __future__ import annotations

from . import lines, mixing

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"



def _encoded(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


LINE_FREQUENCY = rf"""
with d as (
  select row_number() over () as item, doc_id, source, text as body, coalesce(text, '') as t from documents
), w as (
  select item, regexp_extract_all(t, '{_WORD}') as ws from d
), l as (
  select item, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls from d
), windows as (
  select item, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'w': array_to_string(ws[i:i + 2], ' ')}}), recursive := true) from w
), often as (
  select item, i from (select item, i, count(*) over (partition by item, w) as n from windows) where n > 1
), covered as (
  select item, count(*) as n from (select distinct item, i + o as at from often, (values (0), (1), (2)) as s(o)) group by item
), listed as (
  select item, array_to_string(ws, ' ') as line, sum(len(ws)) as words
  from (select item, regexp_extract_all(x, '{_WORD}') as ws from (select item, unnest(string_split(lower(t), chr(10))) as x from d))
  where len(ws) > 0 group by 1, 2
), firsts as (
  select source, body, min(item) as item from d group by source, body
), counted as (
  select f.source, line, count(*) as n from listed join firsts f using (item) group by f.source, line
), frequent as (
  select source, line from counted where n > {lines.LINE_DOCUMENTS}
), removed as (
  select item, sum(words)::bigint as words from listed join d using (item)
  join frequent f on d.source is not distinct from f.source and listed.line = f.line group by item
), figures as (
  select d.doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(r.words, 0) as removed_words
  from d join w using (item) join l using (item) left join covered c using (item) left join removed r using (item)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - removed_words >= {lines.KEPT_SHARE}::double * n_words
  and n_words - removed_words >= {lines.LEAST_WORDS} as kept, removed_words
from figures
"""

TILE_SEARCH = """
with v as (
  select row_number() over () as item, vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored as (
  select q.item as query, c.item, q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) as score
  from v q join v c on q.item <> c.item and len(q.e) = len(c.e) where q.vec_id % 100 = 0
)
select query_id, row_number() over (partition by query order by score, vec_id, item)::int as rank, vec_id, score
from scored qualify rank <= 10
"""

FAIR_MIX = f"""
with d as (
  select row_number() over () as item, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
    substr(md5(concat_ws(chr(0), '{mixing.SEED}', coalesce(doc_id::varchar, ''), coalesce(text, ''))), 1, 15) as key
  from documents
), s as (
  select source, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from d group by source
), filled as (
  select *, (sum(source_size) over ())::double - coalesce(3.0::double * sum(source_size) over (order by source_size / weight::double, source nulls last
      rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (order by source_size / weight::double, source nulls last rows between current row and unbounded following) as weights
  from s
), level as (
  select min_by(rest, weights * -1) as rest, max(weights) as weights from filled where rest * weight / weights <= 3 * source_size
), shares as (
  select source, source_size, case when level.weights is null or rest_full then 3.0::double * source_size else level.rest * weight / level.weights end as target
  from (select *, filled.rest * filled.weight / filled.weights > 3 * source_size as rest_full from filled) f, level
), queued as (
  select d.*, source_size, target, coalesce(sum(size) over (partition by d.source order by key, item rows between unbounded preceding and 1 preceding), 0) as own
  from d join shares s on d.source is not distinct from s.source
)
, epochs as (
  select q.*, e * source_size + own as first, e * source_size + own + size <= target as whole from queued q, (values (0), (1), (2)) as v(e)
  where size > 0 and e * source_size + own < target
), entries as (
  select item, source, target, first + f as begin, case when whole then size else least({mixing.QUANTUM}, size - f) end as words
  from (select *, unnest(case when whole then [0] else range(0, size, {mixing.QUANTUM}) end) as f from epochs)
), served as (
  select item, words, coalesce(sum(words) over (order by (begin + words)::double / target, source nulls last, begin rows between unbounded preceding and 1 preceding), 0) as before
  from entries where begin < target
), mixed as (
  select item, sum(least(words, greatest(0, (select sum(size) from d) - before)))::bigint as taken from served group by item
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from queued left join mixed using (item)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"

BUCKET_SEARCH = f"""
with d as (
  select row_number() over () as doc, doc_id, {_TERMS} as ws from documents
), held as (
  select doc, doc_id, len(ws) as n, ws from d where len(ws) > 0
), totals as (
  select count(*)::bigint as docs, sum(n)::bigint as terms from held
), postings as (
  select doc, term, count(*)::bigint as tf from (select doc, unnest(ws) as term from held) group by doc, term
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, totals group by term, docs
), asked as (
  select item, item_id, term, count(*)::bigint as q
  from (select item, item_id, unnest(ws) as term from (select row_number() over () as item, item_id, {_TERMS} as ws from benchmark)) group by item, item_id, term
), scored as (
  select item, item_id, doc_id, doc, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::bigint as score
  from asked join weights using (term) join postings using (term) join held using (doc), totals group by item, item_id, doc_id, doc
)
select item_id, row_number() over (partition by item order by score desc, doc_id nulls last, doc)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""

MERKLE_MANIFEST = f"""
with recursive fields as (
  select row_number() over () as item, doc_id, source, lang, n_chars, text,
    list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: case when x >= 0 then xor(crc, x) else xor(crc >> 1, case when crc & 1 = 1 then 3988292384 else 0 end) end) as crc
  from documents
), heads as (
  select *, {_encoded('doc_id::varchar')} || {_encoded('source')} || {_encoded('lang')} || {_encoded('n_chars::varchar')} as head,
    case when xor(crc, 4294967295) % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as altered
  from fields
), hashed as (
  select item, doc_id, source, sha256(head || {_encoded('text')}) as leaf, sha256(head || {_encoded('altered')}) as read from heads
), leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, item) - 1 as place, count(*) over (partition by source) as n from hashed
), nodes as (
  select source, 0 as level, place, leaf as node, n from leaves
  union all
  select source, level + 1, place // 16, sha256(string_agg(node, '' order by place)), (n + 15) // 16 from nodes where n > 1 group by source, level, place // 16, n
), subroots as (
  select source, node as subroot, level as levels, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from nodes where n = 1
), tops as (
  select 0 as level, place, subroot as node, n from subroots
  union all
  select level + 1, place // 16, sha256(string_agg(node, '' order by place)), (n + 15) // 16 from tops where n > 1 group by level, place // 16, n
), node_steps as (
  select a.source, a.level, a.place, string_agg(b.node, '' order by b.place) filter (b.place < a.place) as l, string_agg(b.node, '' order by b.place) filter (b.place > a.place) as r
  from nodes a join nodes b on a.source is not distinct from b.source and a.level = b.level and a.place // 16 = b.place // 16 where a.n > 1 group by a.source, a.level, a.place
), top_steps as (
  select a.level, a.place, string_agg(b.node, '' order by b.place) filter (b.place < a.place) as l, string_agg(b.node, '' order by b.place) filter (b.place > a.place) as r
  from tops a join tops b on a.level = b.level and a.place // 16 = b.place // 16 where a.n > 1 group by a.level, a.place
), steps as (
  select item, s.level as step, coalesce(l, '') as l, coalesce(r, '') as r
  from leaves join node_steps s on leaves.source is not distinct from s.source and s.place = leaves.place // (16 ** s.level)::bigint
  union all
  select item, levels + t.level, coalesce(l, ''), coalesce(r, '')
  from leaves join subroots u on leaves.source is not distinct from u.source join top_steps t on t.place = u.place // (16 ** t.level)::bigint
), folds as (
  select item, 0 as step, read as node from leaves
  union all
  select item, folds.step + 1, sha256(l || node || r) from folds join steps using (item, step)
), proofs as (
  select item, sha256(string_agg(l || r, '' order by step)) as proof_sha256 from steps group by item
)
select doc_id, leaf, subroot, tops.node as root, coalesce(proof_sha256, sha256('')) as proof_sha256, f.node as folded_root, f.node = tops.node as verified
from leaves join subroots on leaves.source is not distinct from subroots.source join tops on tops.n = 1 left join proofs using (item)
join (select item, arg_max(node, step) as node from folds group by item) f using (item)
"""

ORACLES = {"op5_fair_mix": FAIR_MIX, "op8_line_frequency": LINE_FREQUENCY, "op9_tile_search": TILE_SEARCH, "op12_bucket_search": BUCKET_SEARCH, "op13_merkle_manifest": MERKLE_MANIFEST}
