"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP7 = r"""
with sized as (
  select doc_id, source, case when source is null then 'n' else 'v' || source end as source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, text
  from documents),
sources as (
  select source_key, source, sum(size)::bigint as source_size from sized group by all),
weighed as (
  select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight
  from sources),
levels as (
  select *, source_size * 3.0::double as cap, source_size * 3.0::double / weight as ratio,
         (sum(source_size) over () - coalesce(sum(source_size * 3.0::double) over
             (order by source_size * 3.0::double / weight, source_key rows between unbounded preceding and 1 preceding), 0.0::double))
         / sum(weight) over (order by source_size * 3.0::double / weight, source_key rows between current row and unbounded following) as lvl
  from weighed),
targets as (
  select source_key, source_size,
         round(least(cap, coalesce((select lvl from levels where lvl <= ratio order by ratio, source_key limit 1), 0.0) * weight), 6) as target
  from levels),
placed as (
  select s.*, t.source_size, t.target,
         row_number() over (partition by s.source_key order by s.size desc, s.doc_id) - 1 as place,
         case when t.source_size > 0 then t.target / t.source_size else 0.0 end as expected,
         ('0x' || substr(md5('mix' || s.source_key), 1, 8))::bigint::double / 4294967296.0::double as shift
  from sized s join targets t using (source_key))
select doc_id, size, source_size, target::double as target,
       (least(floor(expected * (place + 1) + shift) - floor(expected * place + shift), 3)::bigint * size)::bigint as taken
from placed
"""

OP9 = """
with g as (select doc_id, coalesce(text, '') as t, row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) as r,
                  max(doc_id) over (partition by coalesce(text, '')) as keep_id, count(*) over (partition by coalesce(text, '')) as group_size
           from documents)
select doc_id, keep_id, group_size, r = 1 as kept, sha256(t) as text_sha256 from g
"""

OP3 = r"""
with recursive rows as (select conv_id, turn::bigint as turn, role, coalesce(text, '') as text from conversations),
calls as (select conv_id, 'call_' || turn as call_id, turn, role = 'system' as opens, text,
                 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as words
          from rows where role in ('system', 'user')),
asked as (select conv_id, call_id, unnest(case when opens then [] when words % 4 = 0 then ['call_' || (turn + 2)]
                                               when words % 4 = 1 then ['call_' || (turn - 1), 'call_' || (turn - 2)] else [] end) as need
          from calls),
links as (select a.conv_id, a.call_id, a.need, n.turn as need_turn from asked a join calls n on a.conv_id = n.conv_id and a.need = n.call_id),
longest as (select max(n) as n from (select count(*) as n from calls group by conv_id)),
reach(conv_id, call_id, need, need_turn, depth) as (
  select conv_id, call_id, need, need_turn, 1 from links
  union
  select r.conv_id, r.call_id, l.need, l.need_turn, r.depth + 1
  from reach r join links l on r.conv_id = l.conv_id and r.need = l.call_id where r.depth < (select n from longest)),
loops as (select distinct conv_id, call_id from reach where call_id = need),
stuck as (select conv_id, call_id from loops union select r.conv_id, r.call_id from reach r join loops l on r.conv_id = l.conv_id and r.need = l.call_id),
deepest as (select conv_id, call_id, max((need_turn, depth)) as place from reach anti join stuck using (conv_id, call_id) group by all),
ranked as (select c.*, s.call_id is not null as looped, greatest((c.turn, 0), coalesce(d.place, (c.turn, 0))) as place
           from calls c left join stuck s using (conv_id, call_id) left join deepest d using (conv_id, call_id)),
steps as (select *, row_number() over (partition by conv_id order by place, turn, call_id) - 1 as step from ranked),
results as (select conv_id, 'call_' || (turn - 1) as call_id, min(text) as content from rows where role = 'assistant' group by all),
errors as (select *, case when opens then null when words % 9 = 0 then 'words is missing' when words % 9 = 1 then 'words is not BIGINT'
                          when words % 9 = 2 then 'unknown argument note' end as error from steps)
select coalesce(s.conv_id, r.conv_id) as conv_id, coalesce(s.call_id, r.call_id) as call_id, step,
       case when s.call_id is null then 'no_call' when looped then 'loop' when error is not null then 'invalid'
            when r.call_id is null then 'no_result' else 'ok' end as status,
       error,
       '{' || case when s.call_id is null then '' else '"arguments":{' || case when not opens and words % 9 = 2 then '"note":"x",' else '' end
              || '"text":' || to_json(s.text)::varchar
              || case when opens or words % 9 = 0 then '' when words % 9 = 1 then ',"words":"' || words || '"' else ',"words":' || words end || '},' end
       || '"id":"' || coalesce(s.call_id, r.call_id) || '"'
       || case when r.call_id is null then '' else ',"result":' || to_json(r.content)::varchar end
       || case when s.call_id is null then '' when opens then ',"tool":"set_context"' else ',"tool":"ask"' end || '}' as message
from errors s full outer join results r on s.conv_id = r.conv_id and s.call_id = r.call_id
"""

ORACLES = {"op3_tool_calls": OP3, "op7_mixing": OP7, "op9_exact_dedup": OP9}
