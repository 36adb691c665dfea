"""The contest relations as SQL over the driver tables, and a WITH clause for those a query names."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["participants"] = """
select c_custkey as user_id, c_name as username, concat('u', c_custkey, '@example.org') as email,
       case when c_custkey % 3 <> 0 then c_mktsegment end as nombre,
       c_acctbal >= 0 as is_approved, c_custkey % 500 = 0 as is_admin
from customer
"""

VIEWS["teams"] = """
select n_nationkey as team_id, n_name as team, r_name as grp
from nation join region on r_regionkey = n_regionkey
"""

FIXTURES = """
select match_id, match_order, home_id, away_id, match_date, match_time, match_day, status, home_goals, away_goals,
       case when status = 'finished' and home_goals is not null and away_goals is not null
            then case when home_goals > away_goals then '1' when away_goals > home_goals then '2' else 'X' end end as actual_result
from (
  select p_partkey + 1 as match_id, p_partkey + 1 as match_order, p_partkey % 25 as home_id,
         case when p_partkey % 7 = 0 then (p_partkey + 1) % 25
              else (p_partkey + 5 * (1 + cast(floor(p_partkey / 25.0) as bigint) % 4)) % 25 end as away_id,
         date '2026-06-11' + cast(floor(p_partkey / 4.0) as int) as match_date,
         concat(13 + (p_partkey % 4) * 3, ':00:00') as match_time,
         case (cast(floor(p_partkey / 4.0) as bigint) + case when p_partkey % 17 = 0 then 1 else 0 end) % 7
              when 0 then 'Jueves' when 1 then 'Viernes' when 2 then 'Sábado' when 3 then 'Domingo'
              when 4 then 'Lunes' when 5 then 'Martes' else 'Miércoles' end as match_day,
         case when p_partkey % 10 < 7 then 'finished' when p_partkey % 10 < 9 then 'in_progress' else 'pending' end as status,
         case when p_partkey % 10 = 9 or p_size = 11 then null else p_size % 4 end as home_goals,
         case when p_partkey % 10 = 9 or p_size = 11 then null else cast(p_partkey % 3 as int) end as away_goals
  from {source}) f
"""

VIEWS["fixtures"] = FIXTURES.format(source="part")

VIEWS["raw_picks"] = """
select o_custkey as user_id, l_partkey + 1 as match_id,
       case l_returnflag when 'A' then '1' when 'N' then 'X' else '2' end as predicted_result,
       l_shipdate as created_at,
       row_number() over (partition by o_custkey, l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey) as arrival
from lineitem join orders on o_orderkey = l_orderkey where l_linestatus = 'F'
"""

VIEWS["picks"] = """
select user_id, match_id, predicted_result, created_at from raw_picks where arrival = 1
"""

VIEWS["pending"] = """
select s_name as label, l_partkey + 1 as match_id,
       case l_returnflag when 'A' then '1' when 'N' then 'X' else '2' end as predicted_result,
       case when s_suppkey % 4 = 0 then s_suppkey end as assigned_to
from lineitem join supplier on s_suppkey = l_suppkey where l_linestatus = 'O'
"""

VIEWS["friend_edges"] = """
select distinct user_id, friend_id from (
  select o_custkey as user_id, cast(floor(o_totalprice) as bigint) % (select count(*) from customer) as friend_id
  from orders where o_orderstatus in ('P', 'F')) e
where user_id <> friend_id
"""

VIEWS["slots"] = """
select p_partkey % 72 as p_partkey, cast(sum(p_size) % 50 + 1 as int) as p_size from part group by p_partkey % 72
"""

VIEWS["d_fixtures"] = FIXTURES.format(source="slots")

VIEWS["d_picks"] = """
select user_id, match_id, predicted_result, created_at from (
  select l_suppkey as user_id, l_partkey % 72 + 1 as match_id,
         case l_returnflag when 'A' then '1' when 'N' then 'X' else '2' end as predicted_result,
         l_shipdate as created_at,
         row_number() over (partition by l_suppkey, l_partkey % 72 order by l_shipdate, l_orderkey, l_linenumber, l_partkey) as rn
  from lineitem where not (l_suppkey % 2 = 1 and (l_suppkey * 7 + l_partkey % 72) % 41 = 0)) z
where rn = 1
"""

VIEWS["d_pending"] = """
select concat('set-', user_id) as label, match_id, predicted_result,
       case when user_id % 4 = 0 then user_id end as assigned_to
from d_picks
"""

VIEWS["sheet"] = """
select l_orderkey as set_id, cast(10 - l_linenumber as bigint) as "row",
       case when l_partkey % 29 = 0 then 'n/a' when l_partkey % 31 = 0 then concat(l_linenumber, '.5')
            when l_partkey % 37 = 0 then '0' else cast(l_linenumber as varchar) end as match_order,
       case when l_returnflag = 'A' or l_quantity = 1
            then case when l_partkey % 3 = 0 then concat(chr(9), 'x', chr(160)) else 'x ' end else '' end as gana_local,
       case when l_returnflag = 'N' and l_tax < 0.08
            then case when l_partkey % 3 = 0 then concat(chr(8195), 'X', chr(13), chr(10)) else ' X' end end as empate,
       case when l_returnflag = 'R' and l_discount < 0.1 then 'X' when l_quantity = 2 then 'X' end as gana_visitante,
       case when l_returnflag = 'R' and l_discount >= 0.1 and l_tax < 0.05 then '2' when l_tax = 0.08 then 'q' end as old_pick
from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey) as rn from lineitem) z
where rn = 1
"""

VIEWS["d_sheet"] = """
select user_id as set_id, match_id * 37 % 73 as "row",
       case when user_id % 10 = 8 and match_id = 5 then '1005' when user_id % 10 = 2 and match_id = 7 then 'siete'
            when user_id % 10 = 6 and match_id = 9 then '9.5' else cast(match_id as varchar) end as match_order,
       case when match_id % 6 <> 0 and (predicted_result = '1' or (user_id % 10 = 4 and match_id = 50)) then concat('x', chr(9)) else '' end as gana_local,
       case when match_id % 6 <> 0 and (predicted_result = 'X' or (user_id % 10 = 4 and match_id = 50)) then concat(chr(160), 'X') end as empate,
       case when match_id % 6 <> 0 and predicted_result = '2' then 'X' end as gana_visitante,
       case when match_id % 6 = 0 and not (user_id % 10 = 6 and match_id = 12) then lower(predicted_result) end as old_pick
from d_picks
"""

VIEWS["assign_requests"] = """
select distinct concat('set-', user_id) as label,
       case when user_id % 3 = 0 then user_id else user_id + 1000000 end as user_id
from d_picks
"""

VIEWS["subscription_log"] = """
select event_id, user_id, concat('ep-', event_id % 3) as endpoint, props as p256dh,
       concat('auth-', event_id % 101) as auth, cast(ts as timestamp) as created_at, event_type <> 'error' as delivered
from events
"""

VIEWS["results_log"] = """
select event_id, event_id % 72 + 1 as match_id, cast(ts as timestamp) as ts,
       case when event_type = 'purchase' then 'finish' else 'save' end as action,
       case when event_id % 11 = 0 then 'n/a' when event_id % 13 = 0 then '-1' else concat('', event_id % 5) end as home_goals,
       concat('', event_id % 3) as away_goals
from events where event_type in ('view', 'purchase')
"""

VIEWS["signups"] = """
select event_id as user_id, concat('mail', event_id, '@example.org') as email,
       case when event_id % 2 = 0 then concat('{"username":"nick', event_id, '","nombre":"N"}') else '{}' end as raw_meta
from events where event_type = 'signup'
"""
VIEWS["d_participants"] = """
select s_suppkey as user_id, s_name as username, concat('s', s_suppkey, '@example.org') as email,
       case when s_suppkey % 3 <> 0 then concat('Nombre ', s_suppkey) end as nombre
from supplier
"""

VIEWS["named_fixtures"] = """
select f.*, h.team as home_team, a.team as away_team
from fixtures f join teams h on h.team_id = f.home_id join teams a on a.team_id = f.away_id
"""

VIEWS["d_named_fixtures"] = """
select f.*, h.team as home_team, a.team as away_team
from d_fixtures f join teams h on h.team_id = f.home_id join teams a on a.team_id = f.away_id
"""

VIEWS["points"] = """
select u.*, coalesce(h.n, 0) as total_points
from participants u left join (
  select p.user_id, count(*) as n from picks p join fixtures f on f.match_id = p.match_id
  where f.status = 'finished' and f.actual_result = p.predicted_result group by p.user_id) h
on h.user_id = u.user_id
"""

VIEWS["label_ids"] = """
select label, concat(substr(d, 1, 8), '-', substr(d, 9, 4), '-5', substr(d, 14, 3), '-',
       substr('89ab', cast((strpos('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 as int) + 1, 1), substr(d, 18, 3),
       '-', substr(d, 21, 12)) as label_id
from (select label, sha1(unhex(repeat('00', 16)) || encode(label)) as d
      from (select label from pending union select label from d_pending) l) x
"""

VIEWS["set_points"] = """
select label, count(f.match_id) as total_points
from pending p left join fixtures f
  on f.match_id = p.match_id and f.status = 'finished' and f.actual_result = p.predicted_result
where assigned_to is null group by label
"""

VIEWS["ranking_rows"] = """
select cast(user_id as varchar) as user_id, username, total_points, false as is_pending from points where is_approved
union all
select i.label_id, s.label, s.total_points, true from set_points s join label_ids i on i.label = s.label
"""

VIEWS["positions"] = """
select *, row_number() over (order by total_points desc, username) as position from ranking_rows
"""

VIEWS["friends"] = """
select user_id as viewer_id, friend_id from friend_edges
union select friend_id, user_id from friend_edges
"""

VIEWS["friend_requests"] = """
select o_custkey as user_id, cast(floor(o_totalprice) as bigint) % (select count(*) from customer) as friend_id
from orders where o_orderstatus = 'O'
"""

VIEWS["votes"] = """
select match_id, match_order, coalesce(n_home, 0) as votes_1, coalesce(n_draw, 0) as votes_x,
       coalesce(n_away, 0) as votes_2, coalesce(n, 0) as votes_total
from fixtures left join (
  select match_id, cast(sum(case when predicted_result = '1' then 1 else 0 end) as bigint) as n_home,
         cast(sum(case when predicted_result = 'X' then 1 else 0 end) as bigint) as n_draw,
         cast(sum(case when predicted_result = '2' then 1 else 0 end) as bigint) as n_away, count(*) as n
  from picks group by match_id) counted using (match_id)
"""

VIEWS["shares"] = """
select *, case when votes_total > 0 then cast(round(votes_1 / votes_total * 100) as int) end as pct_1,
       case when votes_total > 0 then cast(round(votes_x / votes_total * 100) as int) end as pct_x,
       case when votes_total > 0 then cast(round(votes_2 / votes_total * 100) as int) end as pct_2
from votes
"""

VIEWS["rated"] = """
select p.user_id, p.match_id, v.match_order, p.predicted_result,
       case p.predicted_result when '1' then votes_1 when 'X' then votes_x else votes_2 end as votes,
       votes_total as total
from picks p join votes v on v.match_id = p.match_id where votes_total > 0
"""

VIEWS["all_rows"] = """
select listed.user_id, username, match_id, match_order, predicted_result from (
  select cast(user_id as varchar) as user_id, username, match_id, predicted_result
  from picks join participants using (user_id)
  union all
  select label_id, label, match_id, predicted_result from pending join label_ids using (label)
  where assigned_to is null) listed
join fixtures using (match_id)
"""

VIEWS["d_rows"] = """
select listed.user_id, username, match_id, match_order, predicted_result from (
  select cast(user_id as varchar) as user_id, username, match_id, predicted_result
  from d_picks join d_participants using (user_id)
  union all
  select label_id, label, match_id, predicted_result from d_pending join label_ids using (label)
  where assigned_to is null) listed
join d_fixtures using (match_id)
"""

VIEWS["next_open"] = """
select u.user_id, u.username, min(f.match_order) filter (where p.user_id is null) as next_order
from d_participants u join d_fixtures f on true
left join d_picks p on p.user_id = u.user_id and p.match_id = f.match_id group by u.user_id, u.username
"""

VIEWS["finished_places"] = """
select match_id, actual_result, row_number() over (order by match_order) as place,
       count(*) over () as places
from d_fixtures where status = 'finished'
"""

VIEWS["run_marks"] = """
select u.user_id, f.place, f.places, coalesce(p.predicted_result = f.actual_result, false) as hit
from d_participants u join finished_places f on true
left join d_picks p on p.user_id = u.user_id and p.match_id = f.match_id
"""

VIEWS["subs"] = """
select min(event_id) over (partition by user_id, endpoint) as sub_id, user_id, endpoint, p256dh, auth
from subscription_log
qualify row_number() over (partition by user_id, endpoint order by created_at desc, event_id desc) = 1
"""

VIEWS["approved_now"] = """
select p.* replace (p.is_approved or r.user_id is not null as is_approved)
from participants p left join (select distinct user_id from events where event_type = 'signup') r
on r.user_id = p.user_id
"""

VIEWS["edits"] = """
select event_id, match_id, ts, action, h as home_goals, a as away_goals from (
  select *, try_cast(nullif(regexp_extract(home_goals, '^\\s*([+-]?\\d+)', 1), '') as int) as h,
         try_cast(nullif(regexp_extract(away_goals, '^\\s*([+-]?\\d+)', 1), '') as int) as a from results_log) z
where h >= 0 and a >= 0
"""

VIEWS["turns"] = """
select *, action = 'finish' and not was_done as turned from (
  select e.event_id, e.match_id, e.ts, e.action, e.home_goals, e.away_goals, e.result,
         coalesce(lag(e.action) over w = 'finish', f.status = 'finished') as was_done,
         case when lag(e.action) over w is null then case when f.status = 'finished' then f.actual_result end
              else lag(e.result) over w end as old_result
  from (select *, case when action = 'finish' then case when home_goals > away_goals then '1'
                       when away_goals > home_goals then '2' else 'X' end end as result from edits) e
  join fixtures f on f.match_id = e.match_id
  window w as (partition by e.match_id order by e.ts, e.event_id)) t
"""

VIEWS["last_edits"] = """
select * from edits qualify row_number() over (partition by match_id order by ts desc, event_id desc) = 1
"""

VIEWS["last_finishes"] = """
select * from edits where action = 'finish'
qualify row_number() over (partition by match_id order by ts desc, event_id desc) = 1
"""

VIEWS["edited"] = """
select f.match_id, f.match_order,
       case when l.match_id is not null then l.home_goals else f.home_goals end as home_goals,
       case when l.match_id is not null then l.away_goals else f.away_goals end as away_goals,
       case l.action when 'finish' then 'finished' when 'save' then 'in_progress' else f.status end as status,
       case when n.match_id is null then f.actual_result when n.home_goals > n.away_goals then '1'
            when n.away_goals > n.home_goals then '2' else 'X' end as actual_result
from fixtures f left join last_edits l on l.match_id = f.match_id
left join last_finishes n on n.match_id = f.match_id
"""

_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _cell(column: str) -> str:
    return f"upper(regexp_replace(coalesce({column}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g'))"


VIEWS["sheet_marks"] = f"""
select *, cast(gl = 'X' as int) + cast(em = 'X' as int) + cast(gv = 'X' as int) as marks,
       case when number = floor(number) then cast(cast(number as bigint) as varchar) else cast(number as varchar) end as shown,
       case when gl = 'X' then '1' when em = 'X' then 'X' when gv = 'X' then '2'
            when old in ('1', 'X', '2') then old end as pick
from (select set_id, "row", try_cast(match_order as double) as number, {_cell('gana_local')} as gl,
             {_cell('empate')} as em, {_cell('gana_visitante')} as gv, {_cell('old_pick')} as old, kind
      from (select *, 'wide' as kind from sheet union all select *, 'dense' from d_sheet) s) z
where number <> 0
"""

VIEWS["sheet_read"] = """
select m.kind, m.set_id, m."row", case when number = floor(number) then cast(number as bigint) end as match_order,
       f.match_id, m.pick as predicted_result,
       case when m.marks > 1 then concat('Fila #', m.shown, ': tiene más de una X marcada')
            when m.pick is null then concat('Fila #', m.shown, ': sin pronóstico')
            when f.match_id is null then concat('Fila #', m.shown, ': partido no encontrado') end as error
from sheet_marks m left join (
  select match_order, match_id, 'wide' as kind from fixtures
  union all select match_order, match_id, 'dense' from d_fixtures) f
on f.match_order = m.number and f.kind = m.kind
"""

VIEWS["verdicts"] = """
select set_id, valid_rows, error_rows, error_rows = 0 and valid_rows = 72 as accepted,
       case when error_rows > 0 then concat('Errores:', chr(10), shown,
              case when error_rows > 10 then concat(chr(10), '...y ', error_rows - 10, ' más') else '' end)
            when valid_rows <> 72 then concat('Se encontraron ', valid_rows, ' pronósticos válidos, se necesitan 72.')
       end as message
from (select set_id, count(*) filter (where error is null) as valid_rows, count(error) as error_rows,
             string_agg(error, chr(10) order by "row", error) filter (where error is not null and n <= 10) as shown
      from (select *, row_number() over (partition by set_id, error is null order by "row", error) as n
            from sheet_read where kind = 'dense') s group by set_id) v
"""

VIEWS["eligibility"] = """
select q.label, q.user_id, coalesce(u.n, 0) as user_picks, coalesce(s.n, 0) as set_rows,
       coalesce(u.n, 0) = 0 and coalesce(s.n, 0) = 72 as eligible,
       case when coalesce(u.n, 0) > 0 then 'user_has_picks' when coalesce(s.n, 0) <> 72 then 'set_size' end as reason,
       coalesce(s.owner is not null, false) as already_assigned
from assign_requests q
left join (select user_id, count(*) as n from d_picks group by user_id) u on u.user_id = q.user_id
left join (select label, count(*) as n, min(assigned_to) as owner from d_pending group by label) s on s.label = q.label
"""

VIEWS["attempts"] = """
select a.*, f.match_order, row_number() over (partition by a.user_id order by created_at, a.match_id, order_key,
       line_number, part_key) as arrival
from (select l_suppkey as user_id, l_partkey % 75 + 1 as match_id,
             case l_returnflag when 'A' then '1' when 'N' then 'X' else '2' end as predicted_result,
             l_shipdate as created_at, l_orderkey as order_key, l_linenumber as line_number, l_partkey as part_key
      from lineitem) a left join d_fixtures f on f.match_id = a.match_id
"""

VIEWS["accepted"] = """
select user_id, 1 as k, min(arrival) as arrival from attempts where match_order = 1 group by user_id
union all
select t.user_id, t.k + 1, min(a.arrival) from accepted t
join attempts a on a.user_id = t.user_id and a.match_order = t.k + 1 and a.arrival > t.arrival
group by t.user_id, t.k + 1
"""

VIEWS["verdicts_in"] = """
select a.user_id, a.match_id, a.predicted_result, a.order_key, a.line_number, a.part_key, a.match_order,
       case when a.match_order is null then 'unknown_match' when t.arrival = a.arrival then 'accepted'
            when t.arrival < a.arrival then 'duplicate' else 'out_of_sequence' end as verdict
from attempts a left join accepted t on t.user_id = a.user_id and t.k = a.match_order
"""

_NAME = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in dict.fromkeys(_NAME.findall(text)):
        if name not in seen:
            inner = [n for n in _NAME.findall(VIEWS[name]) if n != name]
            _needed(" ".join(inner), seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(body: str) -> str:
    """``body`` behind the relations it names and those they need."""
    names = _needed(body, [])
    if not names:
        return body.strip()
    clauses = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
    body = body.strip()
    joined = f",\n{body[len('with '):]}" if body.startswith("with ") else f"\n{body}"
    return f"with recursive {clauses}{joined}"
