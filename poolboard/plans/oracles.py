"""Independent SQL for every query of the catalog, on the driver tables."""

from __future__ import annotations

from .oracle_views import with_views

ORACLES: dict[str, str] = {}

ORACLES["fixture_list"] = """
select match_id, match_order, match_day, cast(match_date as varchar) as match_date, substr(match_time, 1, 5) as kickoff,
       home_team, away_team,
       case status when 'finished' then concat('Resultado final: ', home_goals, ' - ', away_goals, ' (', actual_result, ')')
            when 'in_progress' then concat('En desarrollo: ', home_goals, ' - ', away_goals) else 'Pendiente' end as status_text
from named_fixtures
"""

ORACLES["match_board"] = """
select f.match_id, f.match_order, f.match_day, cast(f.match_date as varchar) as match_date,
       substr(f.match_time, 1, 5) as kickoff, f.home_team, f.away_team,
       coalesce(cast(f.home_goals as varchar), '') as home_goals_text,
       coalesce(cast(f.away_goals as varchar), '') as away_goals_text, f.status, f.actual_result,
       s.votes_1, s.votes_x, s.votes_2, s.votes_total, s.pct_1, s.pct_x, s.pct_2
from named_fixtures f join shares s on s.match_id = f.match_id
"""

ORACLES["fixture_export"] = """
select match_order as "#", cast(match_date as varchar) as "Fecha", substr(match_time, 1, 5) as "Hora",
       match_day as "Día", '' as "Gana Local", home_team as "Local", '' as "Empate", away_team as "Visitante",
       '' as "Gana Visitante"
from named_fixtures
"""

ORACLES["fixture_text_load"] = """
select match_order, home_team, away_team, cast(match_date as varchar) as match_date, match_time, match_day
from named_fixtures
"""

ORACLES["seed_reload"] = """
select row_number() over (order by match_order) as match_id, match_order, home_team, away_team,
       cast(match_date as varchar) as match_date, match_time, match_day, 'pending' as status
from named_fixtures
"""

ORACLES["sheet_normalise"] = """
select set_id, match_order, match_id, predicted_result from sheet_read where kind = 'wide' and error is null
"""

ORACLES["sheet_errors"] = """
select set_id, "row", match_order, error from sheet_read where kind = 'wide' and error is not null
"""

ORACLES["sheet_verdict"] = "select * from verdicts"

ORACLES["sheet_import"] = """
select user_id as set_id, match_id as match_order, match_id, predicted_result from d_picks
"""

ORACLES["stage_sets"] = """
select label, match_id, predicted_result, assigned_to from d_pending
union all
select concat('sheet-', r.set_id), r.match_id, r.predicted_result, null
from sheet_read r join verdicts v on v.set_id = r.set_id where r.kind = 'dense' and v.accepted and r.error is null
  and r.set_id % 20 <> 0
"""

ORACLES["profile_from_signup"] = """
select user_id, coalesce(json_extract_string(raw_meta, '$.username'), split_part(email, '@', 1)) as username, email,
       json_extract_string(raw_meta, '$.nombre') as nombre, json_extract_string(raw_meta, '$.apellido') as apellido,
       false as is_admin, false as is_approved
from signups where user_id not in (select user_id from participants)
"""

ORACLES["user_profile"] = "select * from points where user_id = 8"

ORACLES["derive_result"] = """
select match_id, status, home_goals, away_goals, actual_result from fixtures
"""

ORACLES["pick_hits"] = """
select p.user_id, p.match_id, f.match_order, p.predicted_result, f.actual_result,
       coalesce(f.status = 'finished' and p.predicted_result = f.actual_result, false) as hit
from picks p join fixtures f on f.match_id = p.match_id
"""

ORACLES["user_points"] = "select user_id, username, total_points from points"

ORACLES["pending_points"] = """
select i.label_id as user_id, s.label as username, s.total_points
from set_points s join label_ids i on i.label = s.label
"""

ORACLES["match_results_apply"] = "select * from edited"

ORACLES["full_ranking"] = "select * from ranking_rows order by total_points desc, username"

ORACLES["ranking_positions"] = "select * from positions"

ORACLES["ranking_fallback"] = "select user_id, username, total_points, false as is_pending from points"

ORACLES["ranking_annotated"] = """
select p.*, p.user_id = '8' as is_me,
       p.user_id in (select cast(friend_id as varchar) from friends where viewer_id = 8) as is_friend,
       p.user_id <> '8' and not p.is_pending as can_befriend
from positions p
"""

ORACLES["notify_ranking"] = """
select user_id, username, total_points, row_number() over (order by total_points desc, username) as position
from points
"""

ORACLES["rank_movement"] = """
select user_id, username, position, prev_position,
       case when prev_position > position then 'up' when prev_position < position then 'down' else 'none' end as movement,
       abs(prev_position - position) as steps
from (select user_id, username, row_number() over (order by total desc, username) as position,
             row_number() over (order by half desc, username) as prev_position
      from (select u.user_id, u.username, count(f.match_id) as total,
                   count(f.match_id) filter (where f.match_order <= 36) as half
            from d_participants u left join d_picks p on p.user_id = u.user_id
            left join d_fixtures f on f.match_id = p.match_id and f.status = 'finished'
                 and f.actual_result = p.predicted_result
            group by u.user_id, u.username) t) r
"""

ORACLES["friend_leaderboard"] = """
select b.viewer_id, b.user_id, p.username, p.total_points,
       row_number() over (partition by b.viewer_id order by p.total_points desc, p.username) as position
from (select viewer_id, friend_id as user_id from friends where viewer_id in (select user_id from participants)
      union select user_id, user_id from participants) b
join points p on p.user_id = b.user_id
"""

ORACLES["all_picks"] = "select * from all_rows order by username, match_order"

ORACLES["match_picks"] = """
select p.user_id, u.username, p.predicted_result from picks p join participants u on u.user_id = p.user_id
where p.match_id = 7
"""

ORACLES["my_picks"] = "select match_id, predicted_result from picks where user_id = 8"

ORACLES["pick_matrix"] = "select user_id, username,\n" + ",\n".join(
    f"coalesce(max(case predicted_result when '1' then 'L' when 'X' then 'E' else 'V' end) "
    f"filter (where match_order = {i}), '') as p{i}" for i in range(1, 73)
) + "\nfrom d_rows group by user_id, username"

ORACLES["pick_map"] = """
select user_id, username, match_order,
       max(case predicted_result when '1' then 'L' when 'X' then 'E' else 'V' end) filter (where true) as letter
from (select *, row_number() over (partition by user_id, username, match_order
        order by case predicted_result when '1' then 1 when 'X' then 2 else 3 end desc) as n from all_rows) r
where n = 1 group by user_id, username, match_order
"""

ORACLES["last_finished"] = "select max(match_order) as match_order from fixtures where status = 'finished'"

ORACLES["pick_counts"] = "select user_id, count(*) as picks from all_rows group by user_id"

ORACLES["pick_completeness"] = """
select u.user_id, u.username, count(p.match_id) as picks, concat(count(p.match_id), '/72') as progress,
       count(p.match_id) = 72 as complete
from d_participants u left join d_picks p on p.user_id = u.user_id group by u.user_id, u.username
"""

ORACLES["next_open_match"] = "select * from next_open"

ORACLES["pick_card_state"] = """
select u.user_id, f.match_order, split_part(f.home_team, ' ', 1) as home_short,
       split_part(f.away_team, ' ', 1) as away_short, p.predicted_result as picked,
       case when p.user_id is not null then 'locked' when f.match_order = u.next_order then 'enabled'
            else 'disabled' end as state
from next_open u join d_named_fixtures f on true
left join d_picks p on p.user_id = u.user_id and p.match_id = f.match_id
"""

ORACLES["picks_digest"] = """
select u.user_id, u.username, u.email as mail_to, coalesce(nullif(u.nombre, ''), u.username) as display_name,
       f.match_order, f.home_team, f.away_team, cast(f.match_date as varchar) as match_date,
       case p.predicted_result when '1' then 'Local' when 'X' then 'Empate' else 'Visitante' end as pick
from d_participants u join d_picks p on p.user_id = u.user_id
join d_named_fixtures f on f.match_id = p.match_id
where u.user_id in (select user_id from d_picks group by user_id having count(*) = 72)
"""

ORACLES["consensus"] = "select * from votes"

ORACLES["consensus_percent"] = "select * from shares where votes_total > 0"

for _key, _direction in {"consensus_top5": "desc", "consensus_bottom5": "asc"}.items():
    ORACLES[_key] = f"""
select * from (
  select *, cast(row_number() over (partition by user_id order by votes / total {_direction}, match_order) as int) as rank
  from rated) r where rank <= 5
"""

ORACLES["user_distribution"] = """
select u.user_id, d.slot, d.name, coalesce(c.n, 0) as value,
       case when t.n > 0 then cast(round(coalesce(c.n, 0) / t.n * 100) as int) end as pct
from participants u
join (values (1, 'Local (1)', '1'), (2, 'Empate (X)', 'X'), (3, 'Visitante (2)', '2')) d(slot, name, pick) on true
left join (select user_id, predicted_result, count(*) as n from picks group by all) c
  on c.user_id = u.user_id and c.predicted_result = d.pick
left join (select user_id, count(*) as n from picks group by user_id) t on t.user_id = u.user_id
"""

ORACLES["group_standings"] = """
select user_id, grp, cast(row_number() over (partition by user_id, grp order by points desc, won desc, team_id) as int) as rank,
       team, played, won, drawn, lost, points
from (select u.user_id, t.grp, t.team_id, t.team, count(s.team_id) as played,
             count(*) filter (where s.gain = 3) as won, count(*) filter (where s.gain = 1) as drawn,
             count(*) filter (where s.gain = 0) as lost, cast(coalesce(sum(s.gain), 0) as bigint) as points
      from participants u join teams t on true
      left join (
        select p.user_id, f.home_id as team_id,
               case p.predicted_result when '1' then 3 when 'X' then 1 else 0 end as gain
        from picks p join fixtures f on f.match_id = p.match_id
        join teams h on h.team_id = f.home_id join teams a on a.team_id = f.away_id and a.grp = h.grp
        union all
        select p.user_id, f.away_id, case p.predicted_result when '2' then 3 when 'X' then 1 else 0 end
        from picks p join fixtures f on f.match_id = p.match_id
        join teams h on h.team_id = f.home_id join teams a on a.team_id = f.away_id and a.grp = h.grp) s
      on s.user_id = u.user_id and s.team_id = t.team_id
      group by u.user_id, t.grp, t.team_id, t.team) x
"""

ORACLES["group_map_audit"] = """
select f.match_id, f.match_order, f.home_team, f.away_team, h.grp as home_grp, a.grp as away_grp
from named_fixtures f left join teams h on h.team = f.home_team left join teams a on a.team = f.away_team
where h.grp is distinct from a.grp or h.grp is null
"""

ORACLES["streak_best"] = """
select user_id, coalesce(max(n), 0) as best_streak from (
  select user_id, island, count(*) filter (where hit) as n from (
    select *, count(*) filter (where not hit) over (partition by user_id order by place) as island from run_marks) m
  group by user_id, island) r group by user_id
"""

ORACLES["streak_current"] = """
select user_id, cast(min(places) - coalesce(max(place) filter (where not hit), 0) as bigint) as current_streak
from run_marks group by user_id
"""

ORACLES["friend_set"] = "select * from friends"

ORACLES["friend_add"] = """
select user_id, friend_id from friend_edges
union select user_id, friend_id from friend_requests where user_id <> friend_id
"""

ORACLES["friend_remove"] = """
select user_id, friend_id from friend_edges e where not exists (
  select 1 from (
    select cast(floor(o_totalprice) as bigint) % (select count(*) from customer) as asker, o_custkey as other
    from orders where o_orderstatus in ('P', 'F') and o_orderpriority = '1-URGENT') r
  where r.asker = e.user_id and r.other = e.friend_id)
"""

ORACLES["friend_remove_both"] = ORACLES["friend_remove"].replace(
    "where r.asker = e.user_id and r.other = e.friend_id)",
    "where (r.asker = e.user_id and r.other = e.friend_id) or (r.asker = e.friend_id and r.other = e.user_id))")

ORACLES["approval_queue"] = """
select user_id, username, email, nombre,
       cast(date '2026-01-01' + cast(user_id * 7919 % 150 as int) as varchar) as created_at
from participants where not is_approved and not is_admin
"""

ORACLES["approved_overview"] = """
select p.user_id, p.username, p.nombre, p.is_admin, p.total_points, coalesce(c.n, 0) as picks,
       concat(coalesce(c.n, 0), '/72') as progress, coalesce(c.n, 0) = 72 as complete,
       not p.is_admin and coalesce(c.n, 0) = 0 and exists (select 1 from pending where assigned_to is null) as may_assign
from points p left join (select user_id, count(*) as n from picks group by user_id) c on c.user_id = p.user_id
where p.is_approved
"""

ORACLES["approve_users"] = "select * from approved_now"

ORACLES["approve_all_admins"] = """
select user_id, username, email, nombre, is_approved or is_admin as is_approved, is_admin from participants
"""

ORACLES["welcome_outbox"] = """
select n.user_id, n.email as mail_to, coalesce(nullif(n.nombre, ''), n.username) as display_name
from approved_now n join participants p on p.user_id = n.user_id where n.is_approved and not p.is_approved
"""

ORACLES["pending_set_summary"] = """
select label, count(*) as picks, min(assigned_to) as assigned_to from pending group by label
"""

ORACLES["unassigned_sets"] = """
select label, count(*) as picks, min(assigned_to) as assigned_to from pending group by label
having min(assigned_to) is null
"""

ORACLES["assign_eligibility"] = "select * from eligibility"

ORACLES["assign_sets"] = """
select user_id, match_id, predicted_result from d_picks
union all
select e.user_id, p.match_id, p.predicted_result from eligibility e join d_pending p on p.label = e.label where e.eligible
"""

ORACLES["assign_sets_stamp"] = """
select p.label, p.match_id, p.predicted_result, coalesce(e.user_id, p.assigned_to) as assigned_to
from d_pending p left join eligibility e on e.label = p.label and e.eligible
"""

ORACLES["delete_set"] = "select * from d_pending where label <> 'set-8'"

ORACLES["finish_outbox"] = """
select s.sub_id, s.user_id, s.endpoint, f.match_id, concat('🏁 Finalizó #', f.match_order) as title,
       concat_ws(chr(10), concat('⚽ ', f.home_team, ' ', f.home_goals, ' - ', f.away_goals, ' ', f.away_team),
         concat('Resultado: ', case f.actual_result when '1' then 'Local' when 'X' then 'Empate' else 'Visitante' end),
         case when p.predicted_result = f.actual_result then '✅ ¡Acertaste!'
              when p.predicted_result is not null then '❌ No acertaste' end,
         case when r.position is not null then concat('📊 Posición: ', r.position, '°',
              case when r.prev > r.position then concat(' (subiste ', r.prev - r.position, ' 🔼)')
                   when r.prev < r.position then concat(' (bajaste ', r.position - r.prev, ' 🔽)') else '' end) end) as body,
       '/partidos' as url
from subs s join named_fixtures f on f.match_id = 7
left join picks p on p.user_id = s.user_id and p.match_id = 7
left join (
  select q.user_id, row_number() over (order by q.total_points desc, q.username) as position,
         row_number() over (order by q.total_points - coalesce(h.n, 0) desc, q.username) as prev
  from points q left join (
    select p7.user_id, 1 as n from picks p7 join fixtures f7 on f7.match_id = p7.match_id
    where f7.match_id = 7 and f7.status = 'finished' and f7.actual_result = p7.predicted_result) h
  on h.user_id = q.user_id) r on r.user_id = s.user_id
"""

ORACLES["delivery_summary"] = """
select count(*) filter (where delivered) as sent, count(*) as total, count(*) filter (where not delivered) as removed
from subscription_log
"""

ORACLES["prune_subscriptions"] = """
select * from subs where sub_id not in (select event_id from subscription_log where not delivered)
"""

ORACLES["subscription_upsert"] = "select * from subs"

ORACLES["subscription_remove"] = """
select * from subs s where not exists (
  select 1 from events e where e.event_type = 'click' and e.user_id = s.user_id
  and concat('ep-', e.event_id % 3) = s.endpoint)
"""

ORACLES["insert_ignore"] = """
select user_id, match_id, predicted_result from d_picks
union all
select user_id, match_id, predicted_result from picks p where not exists (
  select 1 from d_picks d where d.user_id = p.user_id and d.match_id = p.match_id)
"""

ORACLES["upsert_update"] = """
select coalesce(p.user_id, s.user_id) as user_id,
       case when s.user_id is null then p.username
            else coalesce(json_extract_string(raw_meta, '$.username'), split_part(s.email, '@', 1)) end as username,
       coalesce(p.email, s.email) as email,
       case when s.user_id is null then p.nombre else json_extract_string(raw_meta, '$.nombre') end as nombre,
       coalesce(p.is_approved, false) as is_approved, coalesce(p.is_admin, false) as is_admin
from participants p full join signups s on s.user_id = p.user_id
"""

ORACLES["update_from"] = """
select p.user_id, p.username,
       case when p.user_id in (select user_id from picks) then p.total_points
            else cast(floor(abs(c.c_acctbal) / 100) as bigint) end as total_points
from points p join customer c on c.c_custkey = p.user_id
"""

ORACLES["cascade_delete"] = """
with gone_users as (select user_id from participants where not is_approved),
     gone_matches as (select match_id from fixtures where status = 'pending')
select 'picks' as relation, cast(user_id as varchar) as k1, cast(match_id as varchar) as k2, predicted_result as v
from picks where user_id not in (from gone_users) and match_id not in (from gone_matches)
union all
select 'edges', cast(user_id as varchar), cast(friend_id as varchar), null from friend_edges
where user_id not in (from gone_users) and friend_id not in (from gone_users)
union all
select 'subscriptions', cast(user_id as varchar), endpoint, p256dh from subs where user_id not in (from gone_users)
union all
select 'pending', label, cast(match_id as varchar),
       case when assigned_to not in (from gone_users) then cast(assigned_to as varchar) end
from pending where match_id not in (from gone_matches)
"""

ORACLES["synthetic_picks"] = """
select u.user_id, f.match_id,
       case (u.user_id * 31 + f.match_id * 17) % 3 when 0 then '1' when 1 then 'X' else '2' end as predicted_result
from d_participants u join d_fixtures f on true
where not exists (select 1 from d_picks p where p.user_id = u.user_id and p.match_id = f.match_id)
"""

ORACLES["check_domain"] = """
select 'predictions' as relation, concat(user_id, '|', match_id) as key, 'outcome' as rule, predicted_result as value
from picks where predicted_result not in ('1', 'X', '2')
union all
select 'matches', cast(match_id as varchar), 'match_order', cast(match_order as varchar)
from fixtures where match_order not between 1 and 72
union all
select 'matches', cast(match_id as varchar), 'outcome', actual_result
from fixtures where actual_result not in ('1', 'X', '2')
union all
select 'matches', cast(match_id as varchar), 'status', status
from fixtures where status not in ('pending', 'in_progress', 'finished')
union all
select 'pending_predictions', concat(label, '|', match_id), 'outcome', predicted_result
from pending where predicted_result not in ('1', 'X', '2')
union all
select distinct 'friendships', concat(user_id, '|', friend_id), 'self_friend', cast(friend_id as varchar)
from friend_requests where user_id = friend_id
"""


def _nulls(relation: str, table: str, columns: str) -> str:
    return "\nunion all\n".join(
        f"select '{relation}' as relation, '{c}' as column_name, count(*) filter (where {c} is null) as nulls from {table}"
        for c in columns.split())


ORACLES["check_not_null"] = "\nunion all\n".join([
    _nulls("users", "participants", "user_id username email is_admin is_approved"),
    _nulls("matches", "named_fixtures", "match_id match_order home_team away_team match_date match_time status"),
    _nulls("predictions", "picks", "user_id match_id predicted_result created_at"),
    _nulls("pending_predictions", "pending", "label match_id predicted_result"),
    _nulls("push_subscriptions", "subs", "user_id endpoint p256dh auth"),
    _nulls("profiles", "participants", "nombre"),
    _nulls("results", "fixtures", "home_goals away_goals actual_result"),
])


def _copies(relation: str, table: str, keys: str) -> str:
    columns = keys.split()
    return (f"select '{relation}' as relation, '{','.join(columns)}' as rule, concat_ws('|', {', '.join(columns)}) as key, "
            f"count(*) as copies from {table} group by {', '.join(columns)} having count(*) > 1")


ORACLES["check_unique"] = "\nunion all\n".join([
    _copies("users", "participants", "username"),
    _copies("users", "participants", "email"),
    _copies("matches", "fixtures", "match_order"),
    _copies("predictions", "raw_picks", "user_id match_id"),
    _copies("friendships", "friend_requests", "user_id friend_id"),
    _copies("pending_predictions", "pending", "label match_id"),
    _copies("push_subscriptions", "subscription_log", "user_id endpoint"),
])


def _orphans(relation: str, child: str, column: str, parent: str, key: str) -> str:
    return (f"select '{relation}' as relation, '{column}' as column_name, cast({column} as varchar) as missing, "
            f"count(*) as rows from {child} where {column} is not null "
            f"and {column} not in (select {key} from {parent}) group by {column}")


ORACLES["check_foreign_keys"] = "\nunion all\n".join([
    _orphans("predictions", "picks", "user_id", "participants", "user_id"),
    _orphans("predictions", "picks", "match_id", "fixtures", "match_id"),
    _orphans("attempts", "(select l_partkey % 75 + 1 as match_id from lineitem)", "match_id", "d_fixtures", "match_id"),
    _orphans("friendships", "friend_edges", "user_id", "participants", "user_id"),
    _orphans("friendships", "friend_edges", "friend_id", "participants", "user_id"),
    _orphans("pending_predictions", "pending", "match_id", "fixtures", "match_id"),
    _orphans("pending_predictions", "pending", "assigned_to", "participants", "user_id"),
    _orphans("requests", "assign_requests", "user_id", "participants", "user_id"),
    _orphans("push_subscriptions", "subs", "user_id", "participants", "user_id"),
])

ORACLES["check_sequence"] = """
select user_id, match_id, match_order, lower, 'out_of_sequence' as problem from (
  select p.user_id, p.match_id, f.match_order,
         count(*) over (partition by p.user_id order by f.match_order rows between unbounded preceding and 1 preceding) as lower
  from d_picks p join d_fixtures f on f.match_id = p.match_id) z
where match_order > 1 and lower < match_order - 1
"""

ORACLES["check_sequence_replay"] = """
select user_id, match_id, match_order, 'out_of_sequence' as problem from (
  select p.user_id, p.match_id, p.match_id as match_order, count(q.match_id) as lower
  from d_picks p left join d_picks q on q.user_id = p.user_id and q.match_id < p.match_id
    and q.created_at <= p.created_at
  group by p.user_id, p.match_id) z
where match_order > 1 and lower < match_order - 1
"""

ORACLES["check_immutable"] = """
select a.user_id, a.match_id, cast(b.arrival as int) as arrival, a.predicted_result as old_value, b.predicted_result as new_value
from raw_picks a join raw_picks b on b.user_id = a.user_id and b.match_id = a.match_id
where b.arrival = a.arrival + 1 and a.predicted_result is distinct from b.predicted_result
"""

ORACLES["check_fixture_calendar"] = """
select match_id, match_order, 'weekday' as problem, match_day as found, right_day as expected from (
  select *, case dayofweek(match_date) when 0 then 'Domingo' when 1 then 'Lunes' when 2 then 'Martes'
            when 3 then 'Miércoles' when 4 then 'Jueves' when 5 then 'Viernes' else 'Sábado' end as right_day
  from fixtures) d where match_day <> right_day
union all
select match_id, match_order, 'kickoff_order', kickoff, ahead from (
  select *, lag(kickoff) over (order by match_order) as ahead
  from (select *, concat(match_date, ' ', match_time) as kickoff from fixtures) k) o where kickoff < ahead
"""

ORACLES["visible_picks"] = "select user_id, match_id, predicted_result from picks where user_id = 8"

ORACLES["visible_picks_for"] = """
select user_id, match_id, predicted_result from picks where user_id in (select user_id from participants where is_admin)
"""

ORACLES["visible_edges"] = "select * from friend_edges where user_id = 8 or friend_id = 8"

ORACLES["visible_subscriptions"] = """
select * from subs where user_id = 8 or exists (select 1 from participants where user_id = 8 and is_admin)
"""

ORACLES["admin_only"] = """
select * from pending where exists (select 1 from participants where user_id = 0 and is_admin)
"""

ORACLES["write_gate"] = """
select c.*, case when relation = 'predictions' then operation = 'insert' and owner_id = writer_id
                 when relation in ('friendships', 'push_subscriptions')
                   then operation in ('insert', 'delete') and owner_id = writer_id
                 when relation = 'users' then operation = 'update' and (owner_id = writer_id or is_boss)
                 when relation = 'matches' then operation = 'update' and is_boss
                 when relation = 'pending_predictions' then is_boss else false end as allowed
from (select change_id, relation, operation, owner_id, writer_id,
             writer_id in (select user_id from participants where is_admin) as is_boss
      from (select event_id as change_id,
                   case event_type when 'signup' then 'users' when 'click' then 'friendships'
                        when 'view' then 'predictions' when 'purchase' then 'matches'
                        else case when event_id % 4 < 2 then 'push_subscriptions' else 'pending_predictions' end
                   end as relation,
                   case event_id % 3 when 0 then 'insert' when 1 then 'update' else 'delete' end as operation,
                   user_id as owner_id, case when value < 20 then user_id else event_id % 7 end as writer_id
            from events) e) c
"""
ORACLES["write_gate"] = ORACLES["write_gate"].replace("select c.*,", "select c.* exclude (is_boss),", 1)

ORACLES["public_rows"] = "select * from participants"

ORACLES["stream_points"] = """
with cut as (select max(struct_pack(ts := ts, event_id := event_id)) as m from edits where action = 'finish'),
counted as (select e.* from edits e, cut where struct_pack(ts := e.ts, event_id := e.event_id) <= cut.m),
now_last as (select * from counted qualify row_number() over (partition by match_id order by ts desc, event_id desc) = 1),
now_finish as (select * from counted where action = 'finish'
               qualify row_number() over (partition by match_id order by ts desc, event_id desc) = 1),
state as (
  select f.match_id, coalesce(case l.action when 'finish' then 'finished' when 'save' then 'in_progress' end, f.status) as status,
         case when n.match_id is null then f.actual_result when n.home_goals > n.away_goals then '1'
              when n.away_goals > n.home_goals then '2' else 'X' end as actual_result
  from fixtures f left join now_last l on l.match_id = f.match_id left join now_finish n on n.match_id = f.match_id)
select u.user_id, u.username, count(s.match_id) as total_points
from participants u left join picks p on p.user_id = u.user_id
left join state s on s.match_id = p.match_id and s.status = 'finished' and s.actual_result = p.predicted_result
group by u.user_id, u.username
"""

ORACLES["stream_points_late_picks"] = ORACLES["stream_points"]

ORACLES["stream_points_replayed"] = ORACLES["stream_points"]

ORACLES["stream_intake"] = "select * from verdicts_in"

ORACLES["stream_intake_keyed"] = ORACLES["stream_intake"]

ORACLES["stream_consensus"] = """
select f.match_id, f.match_order, count(v.user_id) filter (where v.predicted_result = '1') as votes_1,
       count(v.user_id) filter (where v.predicted_result = 'X') as votes_x,
       count(v.user_id) filter (where v.predicted_result = '2') as votes_2, count(v.user_id) as votes_total
from d_fixtures f left join (select * from verdicts_in where verdict = 'accepted') v on v.match_id = f.match_id
group by f.match_id, f.match_order
"""

ORACLES["stream_finish_outbox"] = """
with moves as (
  select p.user_id, t.ts, t.event_id,
         cast(coalesce(p.predicted_result = t.result, false) as int)
         - cast(coalesce(p.predicted_result = t.old_result, false) as int) as delta
  from turns t join picks p on p.match_id = t.match_id where t.result is distinct from t.old_result),
line as (
  select u.user_id, u.username, u.total_points, t.ts, t.event_id, 0 as delta, true as asked
  from points u join turns t on t.turned
  union all select user_id, null, 0, ts, event_id, delta, false from moves),
totals as (
  select *, total_points + sum(delta) over (partition by user_id order by ts, event_id) as total from line),
places as (
  select event_id, user_id, row_number() over (partition by event_id order by total desc, username) as position
  from totals where asked)
select t.event_id, s.sub_id, s.user_id, s.endpoint, f.match_id, concat('🏁 Finalizó #', f.match_order) as title,
       concat_ws(chr(10), concat('⚽ ', f.home_team, ' ', t.home_goals, ' - ', t.away_goals, ' ', f.away_team),
         concat('Resultado: ', case t.result when '1' then 'Local' when 'X' then 'Empate' else 'Visitante' end),
         case when p.predicted_result = t.result then '✅ ¡Acertaste!'
              when p.predicted_result is not null then '❌ No acertaste' end,
         case when r.position is not null then concat('📊 Posición: ', r.position, '°') end) as body,
       '/partidos' as url
from turns t join named_fixtures f on f.match_id = t.match_id
join subs s on true
left join picks p on p.user_id = s.user_id and p.match_id = f.match_id
left join places r on r.user_id = s.user_id and r.event_id = t.event_id
where t.turned
"""

ORACLES["stream_subscriptions"] = "select * from subs"


ORACLES |= {f"{name}_parts": ORACLES[name] for name in ("upsert_update", "update_from", "cascade_delete")}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(body) for name, body in ORACLES.items()}
