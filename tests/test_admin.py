"""Sign-up, approval, and the way of an imported set from sheet to ranking."""

import contest as c
from poolboard.operators import admin, fixtures, policy, quality, ranking, scoring, sheets, social


def signups(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id long, email string, raw_meta string")


def test_profile_name_comes_from_metadata_or_mail(spark):
    new = signups(spark, (1, "ana@example.org", '{"username":"anita","nombre":"Ana","apellido":"Paz"}'),
                  (2, "bea@example.org", "{}"), (3, "old@example.org", "{}"))
    known = c.users(spark, (3, "old", True, False))
    got = admin.profile_from_signup(new, known)
    assert c.rows(got, "user_id", "username", "nombre", "apellido", "is_approved") == [
        (1, "anita", "Ana", "Paz", False), (2, "bea", None, None, False)]


def test_approval_sends_one_welcome_per_new_approval(spark):
    before = c.users(spark, (1, "ana", False, False), (2, "bea", True, False), (3, "cai", False, False),
                     (4, "boss", False, True))
    assert [r.user_id for r in admin.approval_queue(before, "user_id").collect()] == [1, 3]
    ids = spark.createDataFrame([(1,), (2,), (1,)], "user_id long")
    after = admin.approve_users(before, ids)
    assert c.rows(after, "user_id", "is_approved") == [(1, True), (2, True), (3, False), (4, False)]
    assert c.rows(admin.welcome_outbox(before, after)) == [(1, "ana@example.org", "ana")]
    assert c.rows(admin.approve_all_admins(before).where("is_approved"), "user_id") == [(2,), (4,)]


def test_overview_offers_sets_only_to_players_without_picks(spark):
    who = c.users(spark, (1, "ana", True, False), (2, "bea", True, False), (3, "boss", True, True), (4, "dan", False, False))
    chosen, matches = c.picks(spark, {1: "1X"}), c.finished(spark, "1X")
    points = scoring.user_points(who, chosen, matches)
    free, taken = c.pending(spark, ("s", 10, "1", None)), c.pending(spark, ("s", 10, "1", 9))
    got = admin.approved_overview(points, chosen, free, size=2)
    assert c.rows(got, "user_id", "progress", "complete", "may_assign") == [
        (1, "2/2", True, False), (2, "0/2", False, True), (3, "0/2", False, False)]
    assert admin.approved_overview(points, chosen, taken, size=2).where("may_assign").count() == 0


def test_import_assign_and_rank(spark):
    """A sheet becomes a set, the set scores under its label, then under its user."""
    matches = c.finished(spark, "1X2")
    who = c.users(spark, (1, "ana", True, False))
    sheet = spark.createDataFrame(
        [(7, 1, 1, "X", "", "", ""), (7, 2, 2, "", "", "", "x"), (7, 3, 3, "X", "", "", ""),
         (8, 1, 1, "X", "X", "", ""), (8, 2, 2, "", "X", "", ""), (8, 3, 3, "", "X", "", "")],
        "set_id long, row long, match_order long, gana_local string, empate string, gana_visitante string, old_pick string")
    labels = spark.createDataFrame([(7, "  Set de Ana "), (8, "bad")], "set_id long, label string")
    read = sheets.sheet_rows(sheet, matches)
    pending = sheets.stage_sets(read, sheets.sheet_verdict(read, size=3), labels, c.pending(spark))
    assert c.rows(admin.pending_set_summary(pending)) == [("Set de Ana", 3, None)]

    none = c.picks(spark, {})
    shown = ranking.full_ranking(scoring.user_points(who, none, matches), pending, matches)
    assert [(r.username, r.total_points) for r in shown.collect()] == [("Set de Ana", 2), ("ana", 0)]

    rated = admin.assign_eligibility(
        spark.createDataFrame([("Set de Ana", 1)], "label string, user_id long"), none, pending, size=3)
    chosen, pending = admin.assign_sets(rated, none, pending), admin.stamp_sets(rated, pending)
    shown = ranking.full_ranking(scoring.user_points(who, chosen, matches), pending, matches)
    assert [(r.username, r.total_points) for r in shown.collect()] == [("ana", 2)]
    assert admin.delete_set(pending, "Set de Ana").count() == 0


def test_rank_movement_and_annotations(spark):
    who, matches = c.people(spark, "ana", "bea", "cai"), c.finished(spark, "11")
    chosen = c.picks(spark, {1: "1X", 2: "X1", 3: "11"})
    early = ranking.notify_ranking(scoring.user_points(who, chosen, matches.where("match_order = 1")))
    now_points = scoring.user_points(who, chosen, matches)
    moved = ranking.rank_movement(early, ranking.notify_ranking(now_points))
    assert c.rows(moved, "username", "position", "prev_position", "movement", "steps") == [
        ("ana", 2, 1, "down", 1), ("bea", 3, 3, "none", 0), ("cai", 1, 2, "up", 1)]
    earlier = scoring.points_without(now_points, chosen, matches, [20])
    assert c.by(earlier, "username", "before_points") == {"ana": 1, "bea": 0, "cai": 1}
    edges = spark.createDataFrame([(2, 1)], "user_id long, friend_id long")
    table = ranking.ranking_positions(now_points, c.pending(spark, ("set", 10, "1", None)), matches)
    seen = ranking.ranking_annotated(table, edges, 1)
    assert c.rows(seen, "username", "is_me", "is_friend", "can_befriend") == [
        ("ana", True, False, False), ("bea", False, True, True), ("cai", False, False, True), ("set", False, False, False)]


def test_friend_edges_are_one_way_and_read_both_ways(spark):
    edges = spark.createDataFrame([(1, 2)], "user_id long, friend_id long")
    asked = spark.createDataFrame([(1, 2), (3, 3), (2, 3), (2, 3)], "user_id long, friend_id long")
    assert c.rows(social.friend_add(edges, asked)) == [(1, 2), (2, 3)]
    assert c.rows(social.friend_set(edges)) == [(1, 2), (2, 1)]
    assert c.rows(policy.visible_edges(edges, 2)) == [(1, 2)]


def test_reload_numbers_matches_anew(spark):
    played = c.fixtures(spark, (3, "finished", 1, 0, "1"), (1, "pending", None, None, None))
    fresh = fixtures.write_seed(played)
    assert c.rows(fresh, "match_id", "match_order", "status") == [(1, 1, "pending"), (2, 3, "pending")]


def test_orphans_are_counted_per_missing_value(spark):
    chosen = c.picks(spark, {1: "11", 9: "111"})
    got = quality.check_foreign_key("predictions", chosen, "user_id", c.people(spark, "ana"), "user_id")
    assert c.rows(got) == [("predictions", "user_id", "9", 3)]


def test_changed_picks_between_snapshots(spark):
    before, after = c.picks(spark, {1: "1X"}), c.picks(spark, {1: "11", 2: "1"})
    assert c.rows(quality.check_immutable(before, after, ["user_id", "match_id"], "predicted_result")) == [
        (1, 20, "X", "1")]


def test_status_line_of_each_state(spark):
    matches = c.fixtures(spark, (1, "finished", 2, 1, "1"), (2, "in_progress", 0, 0, None), (3, "pending", None, None, None),
                         (4, "finished", None, None, None))
    assert [r.status_text for r in fixtures.fixture_list(matches).collect()] == [
        "Resultado final: 2 - 1 (1)", "En desarrollo: 0 - 0", "Pendiente", "Resultado final:  -  ()"]
