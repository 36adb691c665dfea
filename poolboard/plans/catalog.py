"""Every operator as a named query over one data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wording import CONTEST_SIZE, OUTCOMES
from ..operators import admin, fixtures, maintain, outbox, picks, policy, quality, ranking, scoring, sheets, social, stats
from ..session import fresh_path
from ..sources import parted
from ..sources.projections import Relations
from ..streaming import intake
from ..streaming import points as points_stream
from ..streaming import subscriptions as subscription_stream
from ..streaming.logs import BatchLog, once
from ..streaming.picks import both_arrive

VIEWER = 8
ADMIN = 0
MATCH = 7

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Callable[[Relations], DataFrame]] = {}


def query(build: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
    _QUERIES[build.__name__] = build
    return build


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Dates as text, so that every client compares the same value."""
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() == "date"
                       else F.col(f"`{f.name}`") for f in df.schema])


def queries() -> dict[str, Query]:
    def bind(build):
        return lambda spark, sf_dir: _dates_as_text(build(Relations(spark, sf_dir)))
    return {name: bind(build) for name, build in _QUERIES.items()}


# -- shared inputs -------------------------------------------------------------

def _points(r: Relations) -> DataFrame:
    return scoring.user_points(r.participants(), r.picks(), r.fixtures())


def _d_points(r: Relations, last_order: int | None = None) -> DataFrame:
    matches = r.d_fixtures()
    if last_order is not None:
        matches = matches.where(F.col("match_order") <= last_order)
    return scoring.user_points(r.d_participants(), r.d_picks(), matches)


def _consensus(r: Relations) -> DataFrame:
    return stats.consensus(r.picks(), r.fixtures())


def _subs(r: Relations) -> DataFrame:
    return outbox.subscription_upsert(r.subscription_log())


def _outcomes(r: Relations) -> DataFrame:
    return r.subscription_log().select(F.col("event_id").alias("sub_id"), "delivered")


def _eligibility(r: Relations) -> DataFrame:
    chosen = r.stored("d_picks")
    return admin.assign_eligibility(r.assign_requests(), chosen, r.d_pending())


def _d_sheet_rows(r: Relations) -> DataFrame:
    return r.stored("sheet_rows", sheets.sheet_rows(r.d_sheet(), r.d_fixtures()))


# -- sources and sinks -----------------------------------------------------------

@query
def fixture_list(r):
    return fixtures.fixture_list(r.named_fixtures())


@query
def match_board(r):
    return fixtures.match_board(r.named_fixtures(), stats.consensus_percent(_consensus(r)))


@query
def fixture_export(r):
    path = fresh_path(r.spark, "export")
    fixtures.write_fixture_export(r.named_fixtures(), path)
    blank = fixtures.fixture_export(r.named_fixtures()).schema
    return r.spark.read.schema(blank).option("header", True).option("nullValue", "\0").csv(path)


@query
def fixture_text_load(r):
    path = fresh_path(r.spark, "fixture-text")
    fixtures.fixture_lines(r.named_fixtures()).write.text(path)
    return fixtures.fixture_text_load(r.spark, path)


@query
def seed_reload(r):
    return fixtures.write_seed(r.named_fixtures())


@query
def sheet_normalise(r):
    return sheets.sheet_normalise(sheets.sheet_rows(r.sheet(), r.fixtures()))


@query
def sheet_errors(r):
    return sheets.sheet_errors(sheets.sheet_rows(r.sheet(), r.fixtures()))


@query
def sheet_verdict(r):
    return sheets.sheet_verdict(_d_sheet_rows(r))


@query
def sheet_import(r):
    """Every user's picks filled into the export, written, read back and judged row by row."""
    matches = r.d_named_fixtures()
    blank = fixtures.fixture_export(matches)
    filled = r.d_picks().join(matches.select("match_id", F.col("match_order").alias("#")), "match_id").join(blank, "#")
    pick = F.col("predicted_result")
    for name, outcome in zip(("Gana Local", "Empate", "Gana Visitante"), OUTCOMES, strict=True):
        filled = filled.withColumn(name, F.when(pick == outcome, "X").otherwise(""))
    path = fresh_path(r.spark, "filled")
    sheets.write_filled(filled.withColumn("set_id", F.col("user_id")), path)
    read = sheets.read_filled(r.spark, path, "bigint", together=True)
    return sheets.sheet_normalise(sheets.sheet_rows(read, matches))


@query
def stage_sets(r):
    rows = _d_sheet_rows(r)
    name = F.when(F.col("set_id") % 20 == 0, "\t\u00a0 ").otherwise(F.concat(F.lit("\t sheet-"), "set_id", F.lit("\u00a0")))
    labels = rows.select("set_id").distinct().withColumn("label", name)
    return sheets.stage_sets(rows, sheets.sheet_verdict(rows), labels, r.d_pending())


@query
def profile_from_signup(r):
    return admin.profile_from_signup(r.signups(), r.participants())


@query
def user_profile(r):
    return admin.user_profile(_points(r), VIEWER)


# -- scoring ---------------------------------------------------------------------

@query
def derive_result(r):
    return scoring.derive_result(r.fixtures()).select(
        "match_id", "status", "home_goals", "away_goals", "actual_result")


@query
def pick_hits(r):
    return scoring.pick_hits(r.picks(), r.fixtures())


@query
def user_points(r):
    return _points(r).select("user_id", "username", "total_points")


@query
def pending_points(r):
    return scoring.pending_points(r.pending(), r.fixtures())


@query
def match_results_apply(r):
    return scoring.match_results_apply(r.fixtures(), r.results_log()).select(
        "match_id", "match_order", "home_goals", "away_goals", "status", "actual_result")


# -- rankings ----------------------------------------------------------------------

@query
def full_ranking(r):
    return ranking.full_ranking(_points(r), r.pending(), r.fixtures())


@query
def ranking_positions(r):
    return ranking.ranking_positions(_points(r), r.pending(), r.fixtures())


@query
def ranking_fallback(r):
    return ranking.ranking_fallback(_points(r))


@query
def ranking_annotated(r):
    positions = ranking.ranking_positions(_points(r), r.pending(), r.fixtures())
    return ranking.ranking_annotated(positions, r.friend_edges(), VIEWER)


@query
def notify_ranking(r):
    return ranking.notify_ranking(_points(r))


@query
def rank_movement(r):
    half = CONTEST_SIZE // 2
    return ranking.rank_movement(
        ranking.notify_ranking(_d_points(r, half)), ranking.notify_ranking(_d_points(r)))


@query
def friend_leaderboard(r):
    return ranking.friend_leaderboard(_points(r), r.friend_edges(), r.participants())


# -- picks ---------------------------------------------------------------------------

@query
def all_picks(r):
    return picks.all_picks(r.picks(), r.participants(), r.pending_with_id(), r.fixtures())


@query
def match_picks(r):
    return picks.match_picks(r.picks(), r.participants(), MATCH, ADMIN)


@query
def my_picks(r):
    return picks.my_picks(r.picks(), VIEWER)


@query
def pick_matrix(r):
    chosen = r.stored("d_picks")
    return picks.pick_matrix(chosen, r.d_participants(), r.d_pending(), r.d_fixtures())


@query
def pick_map(r):
    return picks.pick_map(r.picks(), r.participants(), r.pending(), r.fixtures())


@query
def last_finished(r):
    return picks.last_finished(r.fixtures())


@query
def pick_counts(r):
    return picks.pick_counts(r.picks(), r.participants(), r.pending(), r.fixtures())


@query
def pick_completeness(r):
    return picks.pick_completeness(r.d_participants(), r.d_picks())


@query
def next_open_match(r):
    return picks.next_open_match(r.d_participants(), r.d_picks(), r.d_fixtures())


@query
def pick_card_state(r):
    return picks.pick_card_state(r.d_participants(), r.d_picks(), r.d_named_fixtures())


@query
def picks_digest(r):
    chosen = r.stored("d_picks")
    return picks.picks_digest(r.d_participants(), chosen, r.d_named_fixtures())


# -- statistics ------------------------------------------------------------------------

@query
def consensus(r):
    return _consensus(r)


@query
def consensus_percent(r):
    return stats.consensus_percent(_consensus(r)).where("votes_total > 0")


@query
def consensus_top5(r):
    chosen = r.picks()
    return stats.consensus_top(chosen, stats.consensus(chosen, r.fixtures()))


@query
def consensus_bottom5(r):
    chosen = r.picks()
    return stats.consensus_bottom(chosen, stats.consensus(chosen, r.fixtures()))


@query
def user_distribution(r):
    return stats.user_distribution(r.participants(), r.picks())


@query
def group_standings(r):
    return stats.group_standings(r.participants(), r.picks(), r.named_fixtures(), r.teams())


@query
def group_map_audit(r):
    return stats.group_map_audit(r.named_fixtures(), r.teams())


@query
def streak_best(r):
    return stats.streak_best(r.d_participants(), r.d_picks(), r.d_fixtures())


@query
def streak_current(r):
    return stats.streak_current(r.d_participants(), r.d_picks(), r.d_fixtures())


# -- friends -----------------------------------------------------------------------------

@query
def friend_set(r):
    return social.friend_set(r.friend_edges())


@query
def friend_add(r):
    return social.friend_add(r.friend_edges(), r.friend_requests())


@query
def friend_remove(r):
    return social.friend_remove(r.friend_edges(), r.unfriend_requests())


@query
def friend_remove_both(r):
    return social.friend_remove(r.friend_edges(), r.unfriend_requests(), both=True)


# -- administration ------------------------------------------------------------------------

@query
def approval_queue(r):
    return admin.approval_queue(r.dated_participants()).select(
        "user_id", "username", "email", "nombre", "created_at")


@query
def approved_overview(r):
    return admin.approved_overview(_points(r), r.picks(), r.pending())


@query
def approve_users(r):
    policy.require_admin(r.participants(), ADMIN)
    return admin.approve_users(r.participants(), r.approval_requests())


@query
def approve_all_admins(r):
    return admin.approve_all_admins(r.participants())


@query
def welcome_outbox(r):
    before = r.participants()
    return admin.welcome_outbox(before, admin.approve_users(before, r.approval_requests()))


@query
def pending_set_summary(r):
    return admin.pending_set_summary(r.pending())


@query
def unassigned_sets(r):
    return admin.unassigned_sets(admin.pending_set_summary(r.pending()))


@query
def assign_eligibility(r):
    return _eligibility(r)


@query
def assign_sets(r):
    chosen = r.stored("d_picks")
    return admin.assign_sets(_eligibility(r), chosen, r.d_pending())


@query
def assign_sets_stamp(r):
    return admin.stamp_sets(_eligibility(r), r.d_pending())


@query
def delete_set(r):
    return admin.delete_set(r.d_pending(), f"set-{VIEWER}")


# -- notifications ---------------------------------------------------------------------------

@query
def finish_outbox(r):
    done = r.named_fixtures().where(F.col("match_id") == MATCH)
    points = r.stored("points", scoring.points_without(_points(r), r.picks(), r.fixtures(), [MATCH]))
    return outbox.finish_outbox(done, _subs(r), r.picks(), ranking.movement(points))


@query
def delivery_summary(r):
    return outbox.delivery_summary(_outcomes(r))


@query
def prune_subscriptions(r):
    return outbox.prune_subscriptions(_subs(r), _outcomes(r))


@query
def subscription_upsert(r):
    return _subs(r)


@query
def subscription_remove(r):
    return outbox.subscription_remove(_subs(r), r.unsubscribe_requests())


# -- table maintenance -------------------------------------------------------------------------

@query
def insert_ignore(r):
    kept = ["user_id", "match_id", "predicted_result"]
    held = r.stored("d_picks").select(*kept)
    return maintain.insert_ignore(held, r.raw_picks().select(*kept, "arrival"), ["user_id", "match_id"], ["arrival"])


@query
def upsert_update(r):
    people = r.participants()
    new = admin.profile_from_signup(r.signups(), people.where(F.lit(False))).select(
        "user_id", "username", "email", "nombre", "is_approved", "is_admin")
    return maintain.upsert_update(people, new, ["user_id"], ["username", "nombre"])


@query
def update_from(r):
    live = scoring.points_of_pickers(r.picks(), r.fixtures())
    return maintain.update_from(r.stored_points(), live, "user_id", "total_points").select(
        "user_id", "username", "total_points")


def _parted(r: Relations, name: str, df: DataFrame, key: str) -> parted.PartedRelation:
    return parted.PartedRelation.create(df, fresh_path(r.spark, name), key)


@query
def upsert_update_parts(r):
    """The upsert in the folders of a stored relation that it touches."""
    people = r.participants()
    new = admin.profile_from_signup(r.signups(), people.where(F.lit(False))).select(
        "user_id", "username", "email", "nombre", "is_approved", "is_admin")
    table = _parted(r, "participants", people, "user_id")
    parted.upsert_update(table, new, ["user_id"], ["username", "nombre"])
    return table.read()


@query
def update_from_parts(r):
    live = scoring.points_of_pickers(r.picks(), r.fixtures())
    table = _parted(r, "points", r.stored_points(), "user_id")
    parted.update_from(table, live, "user_id", "total_points")
    return table.read().select("user_id", "username", "total_points")


def _gone(r: Relations) -> tuple[DataFrame, DataFrame]:
    return r.participants().where(~F.col("is_approved")), r.fixtures().where(F.col("status") == "pending")


@query
def cascade_delete(r):
    return _in_one_list(maintain.cascade_delete(
        {"picks": r.picks(), "edges": r.friend_edges(), "subscriptions": _subs(r), "pending": r.pending()}, *_gone(r)))


@query
def cascade_delete_parts(r):
    tables = {"picks": _parted(r, "picks", r.picks(), "user_id"), "edges": _parted(r, "edges", r.friend_edges(), "user_id"),
              "subscriptions": _parted(r, "subscriptions", _subs(r), "user_id"), "pending": _parted(r, "pending", r.pending(), "label")}
    parted.cascade_delete(tables, *_gone(r))
    return _in_one_list({name: table.read() for name, table in tables.items()})


def _in_one_list(left: dict[str, DataFrame]) -> DataFrame:
    columns = {"picks": ("user_id", "match_id", "predicted_result"), "edges": ("user_id", "friend_id", None),
               "subscriptions": ("user_id", "endpoint", "p256dh"), "pending": ("label", "match_id", "assigned_to")}
    text = {name: [F.col(c).cast("string") if c else F.lit(None).cast("string") for c in cs]
            for name, cs in columns.items()}
    return quality.union_all([
        left[name].select(F.lit(name).alias("relation"), *[c.alias(a) for c, a in zip(cs, ("k1", "k2", "v"))])
        for name, cs in text.items()])


@query
def synthetic_picks(r):
    draw = (F.col("user_id") * 31 + F.col("match_id") * 17) % 3
    return maintain.synthetic_picks(r.d_participants(), r.d_fixtures(), r.d_picks(), draw)


# -- data quality --------------------------------------------------------------------------------

@query
def check_domain(r):
    return quality.check_domain(r.picks(), r.fixtures(), r.pending(), r.friend_requests().distinct())


@query
def check_not_null(r):
    required = [
        ("users", r.participants(), ["user_id", "username", "email", "is_admin", "is_approved"]),
        ("matches", r.named_fixtures(), ["match_id", "match_order", "home_team", "away_team", "match_date",
                                         "match_time", "status"]),
        ("predictions", r.picks(), ["user_id", "match_id", "predicted_result", "created_at"]),
        ("pending_predictions", r.pending(), ["label", "match_id", "predicted_result"]),
        ("push_subscriptions", _subs(r), ["user_id", "endpoint", "p256dh", "auth"]),
        ("profiles", r.participants(), ["nombre"]),
        ("results", r.fixtures(), ["home_goals", "away_goals", "actual_result"]),
    ]
    return quality.union_all([quality.check_not_null(*item) for item in required])


@query
def check_unique(r):
    keyed = [
        ("users", r.participants(), ["username"]),
        ("users", r.participants(), ["email"]),
        ("matches", r.fixtures(), ["match_order"]),
        ("predictions", r.pick_copies(), ["user_id", "match_id"]),
        ("friendships", r.friend_requests(), ["user_id", "friend_id"]),
        ("pending_predictions", r.pending(), ["label", "match_id"]),
        ("push_subscriptions", r.subscription_log(), ["user_id", "endpoint"]),
    ]
    return quality.union_all([quality.check_unique(*item) for item in keyed])


@query
def check_foreign_keys(r):
    users, matches = r.participants(), r.fixtures()
    return quality.union_all([
        quality.check_foreign_key("predictions", r.picks(), "user_id", users, "user_id"),
        quality.check_foreign_key("predictions", r.picks(), "match_id", matches, "match_id"),
        quality.check_foreign_key("attempts", r.attempts(), "match_id", r.d_fixtures(), "match_id"),
        quality.check_foreign_key("friendships", r.friend_edges(), "user_id", users, "user_id"),
        quality.check_foreign_key("friendships", r.friend_edges(), "friend_id", users, "user_id"),
        quality.check_foreign_key("pending_predictions", r.pending(), "match_id", matches, "match_id"),
        quality.check_foreign_key("pending_predictions", r.pending(), "assigned_to", users, "user_id"),
        quality.check_foreign_key("requests", r.assign_requests(), "user_id", users, "user_id"),
        quality.check_foreign_key("push_subscriptions", _subs(r), "user_id", users, "user_id"),
    ])


@query
def check_sequence(r):
    return quality.check_sequence(r.d_picks(), r.d_fixtures())


@query
def check_sequence_replay(r):
    return quality.check_sequence_replay(r.d_picks(), r.d_fixtures())


@query
def check_immutable(r):
    arrived = r.stored("raw_picks")
    before = arrived.withColumn("arrival", F.col("arrival") + 1)
    return quality.check_immutable(before, arrived, ["user_id", "match_id", "arrival"], "predicted_result")


@query
def check_fixture_calendar(r):
    return quality.check_fixture_calendar(r.fixtures())


# -- visibility -------------------------------------------------------------------------------------

@query
def visible_picks(r):
    return policy.visible_picks(r.picks(), VIEWER).select("user_id", "match_id", "predicted_result")


@query
def visible_picks_for(r):
    """Own picks of every administrator at once."""
    return policy.visible_picks_for(r.picks(), policy.admins(r.participants())).select(
        "user_id", "match_id", "predicted_result")


@query
def visible_edges(r):
    return policy.visible_edges(r.friend_edges(), VIEWER)


@query
def visible_subscriptions(r):
    return policy.visible_subscriptions(_subs(r), r.participants(), VIEWER)


@query
def admin_only(r):
    return policy.admin_only(r.pending(), r.participants(), ADMIN)


@query
def write_gate(r):
    return policy.write_gate(r.change_set(), r.participants())


@query
def public_rows(r):
    return policy.public_rows(r.participants())


# -- streams ----------------------------------------------------------------------------------------

def _edits(r: Relations):
    return r.arrivals("edits", r.results_log(), ["ts", "event_id"])


def _intake(r: Relations) -> BatchLog:
    attempts, arriving = r.arrivals("attempts", r.attempts(), intake.ARRIVAL)
    return intake.stream_intake(attempts, r.stored("d_fixtures"), arriving=arriving)


@query
def stream_points(r):
    edits, arriving = _edits(r)
    return points_stream.stream_points(edits, r.participants(), r.picks(), r.stored("fixtures"), arriving=arriving)


@query
def stream_points_late_picks(r):
    """Picks and edits both go on arriving, each part of the picks ahead of the same part of the edits."""
    edits, more_edits = _edits(r)
    chosen, more_picks = r.arrivals("picks", r.stored("picks"), ["created_at", "user_id", "match_id"])
    return points_stream.stream_points(both_arrive(edits, chosen), r.participants(), chosen, r.stored("fixtures"),
                                       arriving=zip(more_picks, more_edits, strict=True))


@query
def stream_intake(r):
    return _intake(r).read().drop("created_at", "batch")


@query
def stream_intake_keyed(r):
    """The intake from keyed state; same verdicts."""
    attempts, arriving = r.arrivals("attempts", r.attempts(), intake.ARRIVAL)
    verdicts, _ = intake.stream_intake_keyed(attempts, r.stored("d_fixtures"), arriving=arriving)
    return verdicts.read().drop("created_at", "batch")


@query
def stream_points_replayed(r):
    """Every fifth edit is delivered a second time, a day after the first; totals are those of one delivery."""
    again = r.results_log().where(F.col("event_id") % 5 == 0).withColumn("at", F.expr("ts + interval 1 day"))
    twice = r.results_log().withColumn("at", F.col("ts")).unionByName(again)
    edits, arriving = r.arrivals("edits", twice, ["at", "event_id"])
    return points_stream.stream_points(once(edits, ["event_id"], "ts", "2 days"), r.participants(), r.picks(),
                                       r.stored("fixtures"), arriving=arriving)


@query
def stream_consensus(r):
    return intake.stream_consensus(intake.accepted_stream(_intake(r)), r.d_fixtures())


@query
def stream_finish_outbox(r):
    edits, arriving = _edits(r)
    return points_stream.stream_finish_outbox(
        edits, r.participants(), r.stored("picks"), r.stored("named_fixtures"), r.stored("subs", _subs(r)), arriving=arriving)


@query
def stream_subscriptions(r):
    writes, arriving = r.arrivals("writes", r.subscription_log(), ["event_id"])
    return subscription_stream.stream_subscriptions(writes, arriving=arriving)
