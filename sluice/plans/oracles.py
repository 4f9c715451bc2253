"""DuckDB SQL that gives what the queries of the catalogue give."""

from __future__ import annotations

FNV = """list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, octet_length(encode({s})) + 1),
  lambda i: ('0x' || substr(hex(encode({s})), (2 * i - 1)::bigint, 2))::bigint)),
  lambda a, x: xor((a * 16777619) % 4294967296, x))"""

INPUTS = """
base as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders),
new as (select case when o_orderstatus = 'P' then o_orderkey + 10000000 else o_orderkey end as o_orderkey, o_custkey, o_orderstatus,
               case when o_orderstatus = 'F' then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderpriority
        from orders where o_orderstatus <> 'O' or o_orderpriority <> '5-LOW'),
gone as (select o_orderkey from orders where o_orderstatus = 'P'),
state as (select * from new
          union all select * from base b where not exists (select 1 from new n where n.o_orderkey = b.o_orderkey)
                                           and not exists (select 1 from gone g where g.o_orderkey = b.o_orderkey))
"""

PARTED = "parted as (select *, (user_id // 10)::varchar as _part from events)"
TASKS = f"""{PARTED},
tasks as (select event_type as queue, 'events-' || event_type || '-' || _part as task_id, (epoch_us(ts) // 1000) as asked, (epoch_us(ts) // 1000) + 10000 as due from parted),
firsts as (select queue, task_id, min(due) as due from tasks group by all)"""
FILES = """files as (select p as partition_key, idx as index, count(*) as num_rows from (
  select (o_orderkey // 5000)::varchar as p, ((row_number() over (partition by o_orderkey // 5000 order by o_orderkey) - 1) // 1000)::int as idx from orders) group by all)"""

ORACLES: dict[str, str] = {
    "q_scan_project": "select o_orderkey, o_custkey::int as o_custkey, o_totalprice::float::double as price from orders",
    "q_insert_roundtrip": "select event_id, user_id, event_type, value, (event_id // 2000)::varchar as _part from events",
    "q_part_int": "select o_orderkey, (o_orderkey // 1000)::bigint as bucket from orders",
    "q_part_int_neg": """select c_custkey, (((trunc(c_acctbal)::bigint // 100) % 4294967296 + 4294967296) % 4294967296)::bigint as bucket from customer""",
    "q_part_fnv": f"""with h as (select c_custkey, {FNV.format(s="c_name")} as hash from customer)
select c_custkey, hash::bigint as hash, least(hash // (4294967295 // 10), 9)::bigint as bucket from h""",
    "q_part_composite": f"""with h as (select c_custkey, {FNV.format(s="c_name")} as hash from customer)
select c_custkey, (c_custkey // 100)::varchar || '-' || least(hash // (4294967295 // 10), 9)::varchar as _part from h""",
    "q_batch_groups": f"with {PARTED} select _part, count(*) as rows from parted group by all",
    "q_set_distinct": """select event_id, user_id, event_type, value from events union select event_id, user_id, event_type, 0.0::double from events""",
    "q_pending_partitions": f"with {PARTED} select distinct event_type as source, _part from parted",
    "q_batch_take_n": f"""with {PARTED} select event_id, _part from parted qualify row_number() over (partition by _part order by event_id) <= 5""",
    "q_ready_partitions": f"""with {PARTED}, f as (select _part, min(ts) as first_seen from parted group by all)
select _part, epoch_us(first_seen) as first_micros from f where first_seen <= timestamp '2024-01-01 06:00:00' - interval 10 second""",
    "q_processed_keys": "select distinct l_orderkey, l_linenumber from lineitem",
    "q_sort_rank": """select o_orderkey, (o_orderkey // 1000)::varchar as _part, row_number() over (partition by o_orderkey // 1000 order by o_orderkey) as rank from orders""",
    "q_validate_dups": "select l_orderkey, l_linenumber, count(*) as count from lineitem group by all having count(*) > 1",
    "q_validate_unprocessed": f"with {INPUTS} select o_orderkey from new where o_orderkey not in (select o_orderkey from base)",
    "q_merge_classify": f"""with {INPUTS} select coalesce(n.o_orderkey, b.o_orderkey) as o_orderkey,
  case when n.o_orderkey is null and g.o_orderkey is not null then 'deleted' when n.o_orderkey is null then 'untouched'
       when b.o_orderkey is null then 'inserted'
       when b.o_custkey is not distinct from n.o_custkey and b.o_orderstatus is not distinct from n.o_orderstatus
            and b.o_totalprice is not distinct from n.o_totalprice and b.o_orderpriority is not distinct from n.o_orderpriority then 'unchanged'
       else 'updated' end as _merge_action
from base b full outer join new n on b.o_orderkey = n.o_orderkey left join gone g on g.o_orderkey = b.o_orderkey""",
    "q_merge_result": f"with {INPUTS} select * from state",
    "q_merge_insert_only": f"with {INPUTS} select * from new",
    "q_merge_delete": f"with {INPUTS} select b.* from base b join gone using (o_orderkey)",
    "q_merge_multi_batch": f"with {INPUTS} select * from base union all select * from new where o_orderkey >= 10000000",
    "q_merge_keep_old": f"""with {INPUTS} select n.o_orderkey, n.o_totalprice, 'new' as note from new n left join base b using (o_orderkey)
  where b.o_orderkey is null or b.o_totalprice is distinct from n.o_totalprice
union all select b.o_orderkey, b.o_totalprice, 'old' from base b left join new n using (o_orderkey) where n.o_orderkey is null or n.o_totalprice is not distinct from b.o_totalprice""",
    "q_pack_files": """with f as (select (l_orderkey // 1000)::varchar as _part,
  ((row_number() over (partition by l_orderkey // 1000 order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 1000)::int as index from lineitem)
select _part, index, count(*) as num_rows from f group by all""",
    "q_pack_ranges": """with f as (select (l_orderkey // 100000)::varchar as _part,
  ((row_number() over (partition by l_orderkey // 100000 order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 1000)::int as index from lineitem)
select _part, index, count(*) as num_rows from f group by all""",
    "q_round_batches": """with t as (select event_id, user_id, (row_number() over (partition by user_id // 10 order by event_id) - 1) // 50 as turn from events)
select event_id, turn, (dense_rank() over (partition by turn, user_id order by event_id))::int as wave from t""",
    "q_newly_added": "select distinct event_id, user_id, event_type, value from events where event_type = 'click'",
    "q_run_versions": """select event_id, user_id, event_type,
  value + case when event_id % 3 = 0 then 2.0::double when event_id % 2 = 0 then 1.0::double else 0.0::double end as value from events""",
    "q_widened": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice::float::double as o_totalprice, o_orderpriority from orders",
    "q_store_files": "select r_regionkey, r_name from region where r_name <> 'ASIA'",
    "q_read_index": f"""with {INPUTS} select * from state
  qualify (row_number() over (partition by o_orderkey // 5000 order by o_orderkey) - 1) // 1000 = 1""",
    "q_manifest_build": f"""with {FILES} select '1' as id, partition_key, 1::int as version,
  'table-state/part-data/orders/' || partition_key || '/d_1_' || index || '.parquet' as key, index, num_rows from files""",
    "q_manifest_json": f"with {FILES} select 'orders' as table_name, partition_key, count(*)::int as files, true as valid from files group by all",
    "q_manifest_latest": f"""with {PARTED} select _part as partition_key, max(event_id)::int as version, 'manifest_' || max(event_id) || '.json' as name
from parted where event_type <> 'click' group by all""",
    "q_key_parse": f"with {PARTED} select event_id, event_type as source, _part as part from parted",
    "q_packet_json": """select event_id, (props->>'k')::bigint as k, '{"id":' || event_id || ',"k":' || (props->>'k') || '}' as packet from events""",
    "q_queue_first_wins": f"""with {TASKS} select f.queue, f.task_id, f.due, r.due as replaced_due from firsts f
join (select queue, task_id, arg_max(due, asked) as due from tasks group by all) r using (queue, task_id)""",
    "q_queue_due": f"""with {TASKS} select queue, task_id, due from firsts where due <= 1704100000000
qualify row_number() over (partition by queue order by due, task_id) = 1""",
    "q_queue_length": f"with {TASKS} select queue, count(*) as length from firsts group by all",
    "q_multi_source": """select event_id, user_id, event_type, value from events
union all select event_id + 10000000, user_id, event_type, value from events""",
    "q_transform": "select doc_id, length(coalesce(text, '')) as chars, length(coalesce(text, '')) as arrow_chars from documents",
    "q_snapshot_read": f"with {INPUTS} select * from state",
    "q_snapshot_sql": f"with {INPUTS} select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from state group by all",
    "q_late_filter": """select event_id, case when event_type = 'purchase' then value else value + 1 end as value,
  case when event_type = 'purchase' then (epoch_us(ts) // 1000) else (epoch_us(ts) // 1000) + 1 end as _produced_ts from events""",
    "q_audit_cols": f"""with {INPUTS} select s.o_orderkey, 1 + (b.o_orderkey is not null and n.o_orderkey is not null)::bigint as _processed_count,
  1 + (b.o_orderkey is not null and n.o_orderkey is not null and b.o_totalprice is distinct from n.o_totalprice)::bigint as _updated_count
from state s left join base b using (o_orderkey) left join new n using (o_orderkey)""",
    "q_stream_ingest": "select event_id, user_id, event_type, value from events",
    "q_flagship": f"""with {INPUTS}, parts as (select (o_orderkey // 5000)::varchar as partition_key, count(*) as rows from state group by all),
olds as (select distinct (o_orderkey // 5000)::varchar as partition_key from base),
touched as (select distinct (o_orderkey // 5000)::varchar as partition_key from (select o_orderkey from new union all select o_orderkey from gone))
select partition_key, ((o.partition_key is not null)::int + (t.partition_key is not null)::int - 1)::int as version, ceil(rows / 1000.0)::int as files, rows
from parts left join olds o using (partition_key) left join touched t using (partition_key)""",
}
