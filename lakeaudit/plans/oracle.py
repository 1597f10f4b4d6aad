"""ANSI/DuckDB SQL with the same result as every registered query.

``VIEWS`` holds the record shapes over the given tables; a query names the ones
it needs and :func:`with_views` puts them in front as common table expressions.
"""

from __future__ import annotations

from lakeaudit.functions.sizes import TIME_LABELS
from lakeaudit.plans import params as P

VIEWS: dict[str, tuple[list[str], str]] = {
    "fx_files": (
        [],
        """select r_name||'/'||n_name||'/c'||cast(c_custkey as varchar)||'/'
          ||case when o_orderkey%11=0 then '.f' else 'f' end||cast(o_orderkey as varchar) as path,
          false as is_dir, cast(round(o_totalprice*100) as bigint) as length, o_orderdate as mtime,
          o_orderkey, c_custkey
        from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey
        join region on n_regionkey=r_regionkey""",
    ),
    "fx_dirs": (
        [],
        """select '' as path, timestamp '1995-01-01 00:00:00' as mtime
        union all select r_name, timestamp '1995-01-01 00:00:00' from region
        union all select r_name||'/'||n_name, timestamp '1995-01-01 00:00:00'
          from nation join region on n_regionkey=r_regionkey
        union all select r_name||'/'||n_name||'/c'||cast(c_custkey as varchar), max(o_orderdate)
          from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey
          join region on n_regionkey=r_regionkey group by r_name,n_name,c_custkey
        union all select r_name||'/'||n_name||'/s'||cast(s_suppkey as varchar),
          case when s_suppkey%2=0 then timestamp '1995-01-01 00:00:00'
               else timestamp '2001-12-31 00:00:00' end
          from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    ),
    "fx_entries": (
        ["fx_files", "fx_dirs"],
        """select path, is_dir, length, mtime,
          case when path='' then null else regexp_replace(path,'/?[^/]*$','') end as parent,
          regexp_extract(path,'([^/]*)$',1) as name
        from (select path,is_dir,length,mtime from fx_files
              union all select path,true,cast(0 as bigint),mtime from fx_dirs)""",
    ),
    "fx_base": (
        ["fx_entries"],
        """select e.path, case when e.name like 's%0' then false else e.is_dir end as is_dir, e.length
        from fx_entries e left join fx_files f on e.path=f.path
        where coalesce(f.o_orderkey%7<>0 and f.c_custkey%10<>3, e.name not like 'c%3')""",
    ),
    "fx_dup": (
        [],
        """select 'd'||lpad(cast(o_orderkey as varchar),12,'0')||'/n'||cast(o_custkey as varchar) as path,
          'n'||cast(o_custkey as varchar) as name, cast(ascii(o_orderstatus) as bigint) as length
        from orders""",
    ),
    "fx_shelves": (
        [],
        """select doc_id, doc_id%16 as shelf, 'lang='||coalesce(lang,'none') as top,
          'lang='||coalesce(lang,'none')||'/shelf='||(doc_id%16) as folder, strlen(coalesce(text,''))+1 as bytes from documents""",
    ),
    "fx_expected": (
        ["fx_files"],
        """select path, length + case when o_orderkey%17=0 then 1 else 0 end as expected_length
        from fx_files where o_orderkey%13<>0
        union all select path||'.gone', length from fx_files where o_orderkey%101=0""",
    ),
    "fx_kv": (
        [],
        """select event_type||'!'||cast(user_id as varchar)||'!'||lpad(cast(event_id as varchar),12,'0')
          as key, props as value from events""",
    ),
    "fx_entities": (
        [],
        "select event_type as entity_type, event_id as entity_id, ts as start_ts from events",
    ),
    "fx_oplog": (
        [],
        """select user_id as worker, row_number() over (partition by user_id order by event_id) as seq,
          event_type as op, ts as start_ts, cast(round(value*100) as bigint) as elapsed,
          least(cast(regexp_extract(props,'([0-9]+)',1) as bigint), cast(round(value*100) as bigint)) as gc,
          1+event_id%5 as items from events""",
    ),
    "fx_lines": (
        [],
        """select source||'-'||cast(doc_id as varchar) as file,
          cast(generate_subscripts(string_split(text,chr(10)),1) as bigint) as line_no,
          unnest(string_split(text,chr(10))) as line from documents""",
    ),
    "fx_hosts": (
        [],
        """select 'hosts-'||cast(c_nationkey as varchar) as file, c_custkey as line_no,
          case when c_custkey%9=0 then '#' else '' end||lower(c_name) as line from customer""",
    ),
    "fx_reports": (
        [],
        """select 'report-'||cast(c_custkey as varchar) as file, i as line_no,
          case i when 1 then 'Configured Capacity: '||cast(c_custkey as varchar)
            when 2 then case when c_custkey%11=0 then 'Dead datanodes (1):'
                        else 'Live datanodes ('||cast(c_custkey%5 as varchar)||'):' end
            else 'Name: 10.0.0.'||cast(c_nationkey as varchar) end as line
        from customer, unnest(range(1,4)) t(i)""",
    ),
    "fx_runs": (
        [],
        """select o_orderpriority as suite, case o_orderstatus when 'O' then 'before' else 'after' end as phase,
          cast(o_orderkey%3+1 as int) as repeat_no, cast(1000*(o_custkey%5+1) as int) as level,
          'avg_time' as metric, cast(round(o_totalprice*100) as bigint) as value
        from orders""",
    ),
    "fx_records": (
        [],
        """select file, pos, pos + case when event_id%97=0 then 8 else 0 end as value
        from (select event_type as file, event_id,
              (row_number() over (partition by event_type order by event_id)-1)*8 as pos from events)""",
    ),
    "fx_sizes": (
        [],
        """select p_brand as grp, p_partkey,
          cast(p_size as varchar)||case p_partkey%5 when 0 then 'KB' when 1 then 'mb' when 2 then 'GB'
            when 3 then 'B' else '' end as size_txt,
          cast(p_size as varchar)||case p_partkey%5 when 0 then 'ms' when 1 then 's' when 2 then 'm'
            when 3 then 'H' else '' end as time_txt from part""",
    ),
    "fx_layouts": (
        [],
        """select s_suppkey as thread, s_suppkey%4+1 as subdirs, cast(s_nationkey+1 as bigint) as files,
          s_suppkey%3+1 as d0, s_suppkey%2+1 as d1, s_suppkey%4+1 as d2 from supplier""",
    ),
    "fx_parsed": (
        ["fx_sizes"],
        """select *, cast(regexp_extract(size_txt,'^([0-9]+)',1) as bigint)
            * case upper(regexp_extract(size_txt,'([A-Za-z]*)$',1)) when 'KB' then 1024
              when 'MB' then 1048576 when 'GB' then 1073741824 else 1 end as bytes,
          cast(regexp_extract(time_txt,'^([0-9]+)',1) as bigint)
            * case lower(regexp_extract(time_txt,'([A-Za-z]*)$',1)) when 'ms' then 1
              when 'm' then 60000 when 'h' then 3600000 else 1000 end as millis
        from fx_sizes""",
    ),
}


def with_views(names: list[str], sql: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    body = ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in order)
    return f"with {body}\n{sql}" if order else sql


def _decimals(col: str, unit: int, label: str) -> str:
    """col / unit with two decimals, half up, in whole numbers."""
    h = f"(({col})*200+{unit})//({2 * unit})"
    return (
        f"cast({h}//100 as varchar)||'.'||lpad(cast({h}%100 as varchar),2,'0')||' {label}'"
    )


def _size(col: str) -> str:
    return f"""case when {col}>=1073741824 then {_decimals(col, 1073741824, 'GB')}
      when {col}>=1048576 then {_decimals(col, 1048576, 'MB')}
      when {col}>=1024 then {_decimals(col, 1024, 'KB')} else cast({col} as varchar)||' B' end"""


def _time(col: str) -> str:
    h, m, s, ms = TIME_LABELS
    return f"""case when {col}>=3600000 then {_decimals(col, 3600000, h)}
      when {col}>=60000 then {_decimals(col, 60000, m)}
      when {col}>=1000 then {_decimals(col, 1000, s)} else cast({col} as varchar)||' {ms}' end"""


_RATE = "cast(items as double)*workers*1000/nullif(cast(elapsed as double),0)"

VIEWS["removable"] = (
    ["fx_entries"],
    f"""select d.path, bool_and(case when e.path=d.path then e.mtime < timestamp '{P.CUTOFF}' end) as own_old,
    bool_and(e.mtime < timestamp '{P.CUTOFF}') as removable
  from (select path from fx_entries where is_dir) d
  join (select path, mtime, unnest(list_distinct(list_concat([path,''],
          list_transform(range(1,len(string_split(path,'/'))),
            lambda i: array_to_string(string_split(path,'/')[1:i],'/'))))) as up from fx_entries) e
    on e.up=d.path
  group by d.path""",
)

_LISTING = with_views(
    ["fx_shelves"],
    """select '' as path, true as is_dir, true as listed, 0 as length, true as has_mtime from (select count(*) from fx_shelves)
    union all select distinct top, true, true, 0, true from fx_shelves
    union all select distinct folder, true, true, 0, true from fx_shelves
    union all select folder||'/data', false, true, sum(bytes)::bigint, true from fx_shelves group by folder""",
)

ORACLE: dict[str, str] = {
    "src_listing": _LISTING,
    "src_fs_listing": _LISTING,
    "src_children": with_views(
        ["fx_entries"],
        f"select path,is_dir,length,mtime from fx_entries where parent='{P.CHILD_ROOT}'",
    ),
    "src_read_verify": with_views(
        ["fx_shelves"],
        """select folder, sum(bytes)::bigint as expected_length, (sum(bytes) filter (written))::bigint as length
        from (select *, shelf<>7 and doc_id%97<>0 as written from fx_shelves) group by folder
        having sum(bytes) is distinct from sum(bytes) filter (written)""",
    ),
    "kv_scan": with_views(["fx_kv"], "select key, value from fx_kv order by key"),
    "kv_prefix": with_views(
        ["fx_kv"], f"select key, value from fx_kv where starts_with(key,'{P.KEY_PREFIX}')"
    ),
    "kv_seek_desc": with_views(
        ["fx_entities"],
        f"select * from fx_entities where start_ts <= timestamp '{P.SEEK}' order by start_ts desc",
    ),
    "kv_seek_newest": with_views(
        ["fx_entities"],
        f"""select printf('%016X', xor(epoch_us(start_ts), 9223372036854775807)) as key, entity_type, entity_id, start_ts
        from fx_entities where start_ts <= timestamp '{P.SEEK}'""",
    ),
    "kv_dump": with_views(["fx_kv"], "select key||' = '||value as line from fx_kv"),
    "src_inventory_lines": with_views(
        ["fx_hosts"], "select * from fx_hosts where not starts_with(line,'#')"
    ),
    "sink_append": with_views(["fx_runs"], "select * from fx_runs"),
    "sink_overwrite": with_views(
        ["fx_runs"],
        """select suite,phase,repeat_no,level,metric,value from (
          select *, max(repeat_no) over (partition by level) as last_repeat
          from fx_runs) where repeat_no=last_repeat""",
    ),
    "sink_fanout": with_views(["fx_runs"], "select * from fx_runs"),
    "gen_manifest": with_views(
        ["fx_layouts"],
        """select 'thread_'||thread||'/subdir_'||s||'/file_'||f as path
        from fx_layouts, unnest(range(subdirs)) t(s), unnest(range(files)) u(f)""",
    ),
    "gen_tree_manifest": with_views(
        ["fx_layouts"],
        """select 'd'||thread||'/d'||a||'/d'||b||'/d'||c||'/f'||f as path
        from fx_layouts, unnest(range(d0)) t0(a), unnest(range(d1)) t1(b), unnest(range(d2)) t2(c),
          unnest(range(files)) u(f)""",
    ),
    "table_register": " union all ".join(
        f"select '{t}' as name, count(*) as n from {t}" for t in P.TABLES
    ),
    "kv_count_contains": with_views(
        ["fx_kv"], f"select count(*) as n from fx_kv where contains(key,'{P.KEY_TEXT}')"
    ),
    "retention_files": with_views(
        ["fx_entries"],
        f"""select path,length,mtime from fx_entries
        where not is_dir and mtime < timestamp '{P.CUTOFF}'""",
    ),
    "retention_exact_day": with_views(
        ["fx_entities"],
        f"""select * from fx_entities
        where cast(start_ts as date) = date '{P.REF_DAY}' - {P.DAYS_BACK}""",
    ),
    "proj_rel_path": with_views(
        ["fx_entries"],
        "select path, substring(path, length(split_part(path,'/',1)) + 1) as rel from fx_entries",
    ),
    "filter_hidden": with_views(
        ["fx_entries"], "select path,name from fx_entries where not starts_with(name,'.')"
    ),
    "grep_context": with_views(
        ["fx_lines"],
        f"""select file,line_no,line,is_match from (select *,
          max(is_match::int) over (partition by file order by line_no rows between 2 preceding and current row)
            as near from (select *, contains(lower(line),'{P.GREP}') as is_match from fx_lines))
        where near=1""",
    ),
    "report_extract": with_views(
        ["fx_reports"],
        f"""select file, min(case when starts_with(line,'{P.REPORT_HEAD}')
          then cast(regexp_extract(line,'([0-9]+)',1) as bigint) end) as observed
        from fx_reports group by file""",
    ),
    "health_gate": with_views(
        ["fx_reports"],
        f"""select file, observed, cast({P.REQUIRED_NODES} as bigint) as required,
          coalesce(observed={P.REQUIRED_NODES}, false) as ok from (
          select file, min(case when starts_with(line,'{P.REPORT_HEAD}')
            then cast(regexp_extract(line,'([0-9]+)',1) as bigint) end) as observed
          from fx_reports group by file)""",
    ),
    "tree_diff_missing": with_views(
        ["fx_entries", "fx_base"],
        """select path, is_dir from fx_entries e
        where not exists (select 1 from fx_base b where b.path=e.path) and not starts_with(name,'.')
          and exists (select 1 from fx_base b where b.path=e.parent and b.is_dir)""",
    ),
    "tree_diff_kind": with_views(
        ["fx_entries", "fx_base"],
        """select e.path, b.is_dir as base_is_dir, e.is_dir as target_is_dir
        from fx_entries e join fx_base b on e.path=b.path
        join fx_base p on p.path=e.parent and p.is_dir where e.is_dir<>b.is_dir""",
    ),
    "empty_dirs": with_views(
        ["fx_entries"],
        """select path from fx_entries d where is_dir
        and not exists (select 1 from fx_entries e where e.parent=d.path)""",
    ),
    "manifest_check": with_views(
        ["fx_entries", "fx_expected"],
        """select coalesce(m.path,e.path) as path, expected_length, length,
          case when e.path is null then 'missing' when m.path is null then 'unexpected'
            when length=expected_length then 'ok' else 'wrong length' end as status
        from fx_expected m full outer join (select * from fx_entries where not is_dir) e on m.path=e.path""",
    ),
    "kv_group_count": with_views(
        ["fx_kv"],
        """select case when key='' then ' ' else substring(key,1,1) end as kind, count(*) as n
        from fx_kv group by 1""",
    ),
    "dir_child_count": with_views(
        ["fx_entries"],
        """select d.path, count(e.path) as n from fx_entries d left join fx_entries e on e.parent=d.path
        where d.is_dir group by d.path""",
    ),
    "retention_dirs": with_views(["removable"], "select path, own_old, removable from removable"),
    "retention_plan": with_views(
        ["removable"],
        f"""select path, false as is_dir,
          case when mtime < timestamp '{P.CUTOFF}' then 'delete' else 'keep' end as action,
          case when mtime < timestamp '{P.CUTOFF}' then 'file older than cutoff'
            else 'file not older than cutoff' end as reason from fx_entries where not is_dir
        union all select path, true, case when removable then 'delete' else 'keep' end,
          case when removable then 'directory and content older than cutoff'
            when own_old then 'content is kept' else 'directory not older than cutoff' end
        from removable""",
    ),
    "op_min_max_total": with_views(
        ["fx_oplog"],
        """select op, count(*) as calls, min(elapsed) as min_elapsed, max(elapsed) as max_elapsed,
          cast(sum(elapsed) as bigint) as total_elapsed,
          max(epoch_us(start_ts)+elapsed*1000)-min(epoch_us(start_ts)) as span_us
        from fx_oplog group by op""",
    ),
    "op_slowest": with_views(
        ["fx_oplog"],
        """select op, elapsed, worker, seq, start_ts from (select *, row_number() over
          (partition by op order by elapsed desc, worker, seq) as rn from fx_oplog) where rn=1""",
    ),
    "op_throughput": with_views(
        ["fx_oplog"],
        f"""select *, {_RATE} as per_sec from (select op, count(distinct worker) as workers,
          cast(sum(items) as bigint) as items, cast(sum(elapsed) as bigint) as elapsed
          from fx_oplog group by op)""",
    ),
    "op_mode_split": with_views(
        ["fx_oplog"],
        f"""select *, {_RATE} as per_sec from (
          select m.mode, count(worker) as workers, cast(coalesce(sum(items),0) as bigint) as items,
            cast(coalesce(sum(elapsed),0) as bigint) as elapsed
          from (values ('read'),('write')) m(mode) left join (
            select worker, items, elapsed, case when row_number() over (order by worker)
              <= floor(count(*) over ()*{P.READ_SHARE}) then 'read' else 'write' end as mode
            from (select worker, sum(items) as items, sum(elapsed) as elapsed from fx_oplog group by worker)
          ) w on w.mode=m.mode group by m.mode)""",
    ),
    "op_batch_time": with_views(
        ["fx_oplog"],
        f"""select worker, (seq-1)//{P.BATCH} as batch, count(*) as calls,
          cast(sum(elapsed) as bigint) as elapsed, min(start_ts) as start_ts from fx_oplog group by 1,2""",
    ),
    "op_gc_adjusted": with_views(
        ["fx_oplog"],
        """select seq, cast(sum(elapsed) as bigint) as elapsed, cast(sum(gc) as bigint) as gc,
          cast(sum(elapsed-gc) as bigint) as net from fx_oplog group by seq""",
    ),
    "op_cpu_usage": with_views(
        ["fx_oplog"],
        """select *, cast(cpu as double)*100/nullif(cast(wall as double),0) as usage_pct from (
          select op, cast(sum(gc) as bigint) as cpu, cast(sum(elapsed) as bigint) as wall
          from fx_oplog group by op)""",
    ),
    "entity_types": with_views(["fx_entities"], "select distinct entity_type from fx_entities"),
    "entity_ttl": with_views(
        ["fx_entities"],
        f"""select entity_type, count(*) filter (where start_ts > timestamp '{P.SEEK}') as kept,
          count(*) filter (where start_ts <= timestamp '{P.SEEK}') as discarded
        from fx_entities group by entity_type""",
    ),
    "dir_expect_count": with_views(
        ["fx_entries"],
        f"""select d.path, n, e.name as child from (
          select d.path, count(e.path) as n from fx_entries d left join fx_entries e on e.parent=d.path
          where d.is_dir group by d.path) d left join fx_entries e on e.parent=d.path
        where n<>{P.EXPECTED_CHILDREN}""",
    ),
    "mask_bucket": """select (event_id//16)*16 as block_start, count(*) as n, min(event_id) as min_id,
          max(event_id) as max_id, (event_id//16)*16+16 as next_start from events group by 1,5""",
    "ab_compare": with_views(
        ["fx_runs"],
        """select *, after-before as delta, after/nullif(before,0) as ratio from (
          select suite, level, cast(sum(value) filter (where phase='before') as double)
              / nullif(count(*) filter (where phase='before'),0) as before,
            cast(sum(value) filter (where phase='after') as double)
              / nullif(count(*) filter (where phase='after'),0) as after
          from fx_runs group by suite, level)""",
    ),
    "human_size_rollup": with_views(
        ["fx_parsed"],
        f"""select grp, bytes, millis, {_size('bytes')} as size_txt, {_time('millis')} as time_txt from (
          select grp, cast(sum(bytes) as bigint) as bytes, cast(sum(millis) as bigint) as millis
          from fx_parsed group by grp)""",
    ),
    "dup_files": with_views(
        ["fx_dup"],
        """select path, rep, 'rm -rf '||chr(39)||replace(path,chr(39),chr(39)||chr(92)||chr(39)||chr(39))||chr(39) as rm_cmd, 'ln -s '||chr(39)||replace(rep,chr(39),chr(39)||chr(92)||chr(39)||chr(39))||chr(39)||' '||chr(39)||replace(path,chr(39),chr(39)||chr(92)||chr(39)||chr(39))||chr(39) as ln_cmd from (
          select *, first_value(path) over (partition by name, run order by string_split(path,'/')) as rep
          from (select *, sum(new) over (partition by name order by string_split(path,'/')) as run
            from (select *, case when length = lag(length) over
              (partition by name order by string_split(path,'/')) then 0 else 1 end as new from fx_dup)))
        where new=0""",
    ),
    "op_running_max": with_views(
        ["fx_oplog"],
        f"""select * from (select worker, seq, count(*) over w as calls, max(elapsed) over w as max_elapsed
          from fx_oplog window w as (partition by worker order by seq
            rows between unbounded preceding and current row)) where seq%{P.REPORT_EVERY}=0""",
    ),
    "op_milestones": with_views(
        ["fx_oplog"],
        """select worker, seq, op, start_ts, elapsed from fx_oplog
        where regexp_matches(cast(seq as varchar), '^10*$')""",
    ),
    "op_running_total": with_views(
        ["fx_oplog"],
        """select seq, items, elapsed,
          cast(coalesce(sum(items) over (order by seq rows between unbounded preceding and 1 preceding),0)
            as bigint) as items_before,
          cast(sum(items) over (order by seq rows between unbounded preceding and current row) as bigint)
            as items_after
        from (select seq, cast(sum(items) as bigint) as items, cast(sum(elapsed) as bigint) as elapsed
          from fx_oplog group by seq)""",
    ),
    "id_gap": "select event_id, event_id - lag(event_id) over (order by event_id) as gap from events",
    "top_dirs": with_views(
        ["fx_entries"],
        f"""select d.path, count(e.path) as n from fx_entries d left join fx_entries e on e.parent=d.path
        where d.is_dir group by d.path order by n desc, d.path limit {P.TOP}""",
    ),
    "tail_n": with_views(
        ["fx_records"],
        f"""select * from (select *, row_number() over (partition by file order by pos desc) as from_end
          from fx_records) where from_end<={P.TAIL}""",
    ),
    "record_verify": with_views(
        ["fx_records"],
        f"""select file, pos, value, from_end<={P.TAIL} as in_tail,
          cast('0x'||substr(md5('0/'||file||'/'||cast(pos as varchar)),1,8) as bigint)%{P.ONE_IN}=0 as in_sample from (
          select *, row_number() over (partition by file order by pos desc) as from_end from fx_records)
        where value<>pos""",
    ),
    "parse_size": with_views(["fx_parsed"], "select p_partkey, size_txt, bytes from fx_parsed"),
    "parse_time": with_views(["fx_parsed"], "select p_partkey, time_txt, millis from fx_parsed"),
    "format_size": f"""select o_orderkey, bytes, {_size('bytes')} as size_txt from (
      select o_orderkey, cast(round(o_totalprice*100) as bigint)*(o_orderkey%1000) as bytes from orders)""",
    "format_time": f"""select o_orderkey, millis, {_time('millis')} as time_txt from (
      select o_orderkey, cast(round(o_totalprice*100) as bigint)*(o_orderkey%10) as millis from orders)""",
    "split_ints": with_views(
        ["fx_layouts"],
        "select thread, 3 as levels, cast(d0+d1+d2 as int) as total, cast(d2 as int) as third from fx_layouts",
    ),
    "path_parts": with_views(
        ["fx_entries"],
        """select path, parent, name, cast(case when path='' then 0 else len(s) end as int) as depth,
          array_to_string(s,'|') as segments,
          case when path='' then '' else array_to_string(list_transform(range(0,len(s)),
            lambda i: array_to_string(s[1:i],'/')),'|') end as ancestors
        from (select *, string_split(path,'/') as s from fx_entries)""",
    ),
    "stream_op_rollup": with_views(
        ["fx_oplog"],
        f"""select window_start, window_start + interval {P.WINDOW} as window_end, op, count(*) as n,
          max(elapsed) as max_elapsed
        from (select *, time_bucket(interval {P.WINDOW}, start_ts) as window_start from fx_oplog)
        group by window_start, op""",
    ),
    "stream_rollup_late": f"""with arrived as (
        select time_bucket(interval {P.WINDOW}, ts) as window_start, event_type as op, ts, cast(round(value*100) as bigint) as elapsed,
          least(floor((dayofyear(ts)-1+case when event_id%{P.HELD_BACK}=0 then 7 else 0 end)/7), {P.BUNCHES - 1}) as bunch from events),
      tops as (select b, (select max(ts) from arrived where bunch<b) as top from range({P.BUNCHES}) r(b)),
      judged as (
        select a.*, coalesce(window_start + interval {P.WINDOW} <= top - interval {P.DELAY}, false) as late
        from arrived a left join tops on b=bunch)
      select window_start, window_start + interval {P.WINDOW} as window_end, op, count(*) filter (not late) as n,
        max(elapsed) filter (not late) as max_elapsed, count(*) filter (late) as late
      from judged group by window_start, op""",
    "stream_paced_read": with_views(
        ["fx_shelves"],
        f"""select folder, sum(bytes)::bigint as length, ((sum(bytes)+{P.PACE}-1)//{P.PACE})::bigint as triggers,
          least(sum(bytes),{P.PACE})::bigint as most from fx_shelves group by folder""",
    ),
    "stream_running_max": with_views(
        ["fx_oplog"],
        "select worker, count(*) as calls, max(elapsed) as max_elapsed from fx_oplog group by worker",
    ),
    "stream_expect_alert": f"""select 'c'||o_custkey as path, n, 'f'||o_orderkey as child from (
      select *, count(*) over (partition by o_custkey) as n from orders) where n<>{P.EXPECTED_CHILDREN}""",
    "stream_throttled_read": "select * from events",
    "kv_map_partitions": """select event_type as kind, user_id, event_id,
      cast(length(props) as bigint) as value_len from events""",
}
