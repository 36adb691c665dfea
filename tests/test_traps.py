"""Behaviour that is easy to get wrong, on hand-made rows."""

import uuid

import pytest
from pyspark.sql import functions as F

import contest as c
from poolboard.functions import wording
from poolboard.functions.ids import label_uuid
from poolboard.operators import admin, fixtures, maintain, outbox, picks, policy, quality, ranking, scoring, sheets, social, stats


SHEET = ("set_id long, row long, match_order string, gana_local string, empate string, gana_visitante string, "
         "old_pick string")


def points(spark, people, chosen, matches):
    return scoring.user_points(people, chosen, matches)


def test_points_are_live_after_a_finish_is_undone(spark):
    chosen, who = c.picks(spark, {1: "11"}), c.people(spark, "ana")
    assert c.by(points(spark, who, chosen, c.finished(spark, "11")), "user_id", "total_points") == {1: 2}
    undone = c.fixtures(spark, (1, "finished", 1, 0, "1"), (2, "in_progress", 1, 0, "1"))
    assert c.by(points(spark, who, chosen, undone), "user_id", "total_points") == {1: 1}


def test_user_without_picks_has_zero(spark):
    got = points(spark, c.people(spark, "ana", "bea"), c.picks(spark, {1: "1"}), c.finished(spark, "1"))
    assert c.by(got, "user_id", "total_points") == {1: 1, 2: 0}


def test_null_result_is_a_miss_for_points_and_runs(spark):
    matches = c.fixtures(spark, (1, "finished", 1, 0, "1"), (2, "finished", None, None, None), (3, "finished", 1, 0, "1"))
    chosen, who = c.picks(spark, {1: "111"}), c.people(spark, "ana")
    assert [r.hit for r in scoring.pick_hits(chosen, matches).orderBy("match_order").collect()] == [True, False, True]
    assert c.rows(stats.streaks(who, chosen, matches)) == [(1, 1, 1)]


def test_manual_result_stays_without_goals_and_goals_win(spark):
    matches = c.fixtures(spark, (1, "finished", None, None, "2"), (2, "finished", 3, 1, "2"), (3, "pending", 1, 0, None))
    assert c.by(scoring.derive_result(matches), "match_order", "actual_result") == {1: "2", 2: "1", 3: None}


def test_label_imported_twice_counts_double_and_fails_the_size_gate(spark):
    matches = c.finished(spark, "1X")
    twice = c.pending(spark, *[("juan", m, p, None) for m, p in [(10, "1"), (20, "X")] * 2])
    assert c.by(scoring.pending_points(twice, matches), "username", "total_points") == {"juan": 4}
    request = spark.createDataFrame([("juan", 9)], "label string, user_id long")
    rated = admin.assign_eligibility(request, c.picks(spark, {1: "1"}), twice, size=2).first()
    assert (rated.eligible, rated.reason, rated.set_rows) == (False, "set_size", 4)
    assert quality.check_unique("pending_predictions", twice, ["label", "match_id"]).count() == 2


def test_set_with_a_repeated_match_passes_the_gate_and_loses_a_row(spark):
    rows = c.pending(spark, ("juan", 10, "1", None), ("juan", 10, "2", None))
    chosen = c.picks(spark, {1: "1"})
    request = spark.createDataFrame([("juan", 9)], "label string, user_id long")
    rated = admin.assign_eligibility(request, chosen, rows, size=2)
    assert rated.first().eligible
    assert c.rows(admin.assign_sets(rated, chosen, rows)) == [(1, 10, "1"), (9, 10, "1")]


def test_assigned_set_can_be_assigned_again_with_a_warning(spark):
    rows = c.pending(spark, ("juan", 10, "1", 5))
    request = spark.createDataFrame([("juan", 9)], "label string, user_id long")
    rated = admin.assign_eligibility(request, c.picks(spark, {1: "1"}), rows, size=1)
    assert (rated.first().eligible, rated.first().already_assigned) == (True, True)
    assert c.rows(admin.stamp_sets(rated, rows)) == [("juan", 10, "1", 9)]


def test_second_set_for_the_same_user_is_refused(spark):
    rows = c.pending(spark, ("a", 10, "1", None), ("b", 10, "2", None))
    request = spark.createDataFrame([("a", 9), ("b", 9)], "label string, user_id long")
    rated = admin.assign_eligibility(request, c.picks(spark, {1: "1"}), rows, size=1)
    assert c.rows(rated, "label", "eligible", "reason") == [("a", True, None), ("b", False, "user_has_picks")]


def test_deleting_a_user_returns_the_set_to_the_ranking(spark):
    matches, rows = c.finished(spark, "1"), c.pending(spark, ("juan", 10, "1", 1))
    relations = {
        "picks": c.picks(spark, {1: "1", 2: "1"}),
        "edges": spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "user_id long, friend_id long"),
        "subscriptions": spark.createDataFrame([(1, "e"), (2, "e")], "user_id long, endpoint string"),
        "pending": rows,
    }
    gone = spark.createDataFrame([(1,)], "user_id long")
    left = maintain.cascade_delete(relations, gone, matches.where("false"))
    assert c.rows(left["picks"]) == [(2, 10, "1")]
    assert c.rows(left["edges"]) == [(2, 3)]
    assert c.rows(left["subscriptions"]) == [(2, "e")]
    assert scoring.pending_points(rows, matches).count() == 0
    assert c.rows(scoring.pending_points(left["pending"], matches), "username", "total_points") == [("juan", 1)]


def test_deleting_a_match_takes_its_picks_and_pending_rows(spark):
    relations = {
        "picks": c.picks(spark, {1: "11"}),
        "edges": spark.createDataFrame([], "user_id long, friend_id long"),
        "subscriptions": spark.createDataFrame([], "user_id long, endpoint string"),
        "pending": c.pending(spark, ("juan", 10, "1", None), ("juan", 20, "1", None)),
    }
    gone = spark.createDataFrame([(10,)], "match_id long")
    left = maintain.cascade_delete(relations, spark.createDataFrame([], "user_id long"), gone)
    assert c.rows(left["picks"], "match_id") == [(20,)]
    assert c.rows(left["pending"], "match_id") == [(20,)]


def test_label_equal_to_a_username_keeps_its_own_matrix_row(spark):
    matches = c.finished(spark, "1X")
    grid = picks.pick_matrix(c.picks(spark, {1: "1-"}), c.people(spark, "ana"),
                             c.pending(spark, ("ana", 10, "2", None)), matches, orders=[1, 2])
    assert c.rows(grid, "username", "p1", "p2") == [("ana", "L", ""), ("ana", "V", "")]


def test_ties_go_by_username_and_positions_have_no_holes(spark):
    who = c.users(spark, (1, "zoe", True, False), (2, "ana", True, False), (3, "bea", False, False))
    scored = points(spark, who, c.picks(spark, {1: "1", 2: "1", 3: "X"}), c.finished(spark, "1"))
    none = c.pending(spark)
    table = ranking.ranking_positions(scored, none, c.finished(spark, "1"))
    assert c.rows(table, "position", "username") == [(1, "ana"), (2, "zoe")]
    everyone = ranking.notify_ranking(scored)
    assert c.rows(everyone, "position", "username") == [(1, "ana"), (2, "zoe"), (3, "bea")]


def test_unapproved_users_are_ranked_only_for_notifications_and_fallback(spark):
    who = c.users(spark, (1, "ana", True, False), (2, "boss", False, True))
    scored = points(spark, who, c.picks(spark, {2: "1"}), c.finished(spark, "1"))
    shown = ranking.full_ranking(scored, c.pending(spark), c.finished(spark, "1"))
    assert [r.username for r in shown.collect()] == ["ana"]
    assert [r.username for r in ranking.ranking_fallback(scored).collect()] == ["boss", "ana"]


def test_crowd_votes_leave_pending_sets_out_and_the_ranking_counts_them(spark):
    matches, rows = c.finished(spark, "1"), c.pending(spark, ("juan", 10, "1", None))
    chosen = c.picks(spark, {1: "X"})
    assert c.rows(stats.consensus(chosen, matches)) == [(10, 1, 0, 1, 0, 1)]
    shown = ranking.full_ranking(points(spark, c.people(spark, "ana"), chosen, matches), rows, matches)
    assert [(r.username, r.total_points, r.is_pending) for r in shown.collect()] == [("juan", 1, True), ("ana", 0, False)]


def test_last_edit_wins_and_a_save_keeps_the_earlier_result(spark):
    matches = c.fixtures(spark, (1, "pending", None, None, None), (2, "pending", None, None, None))
    log = spark.createDataFrame(
        [(1, 10, "2026-06-11 10:00:00", "finish", "2", "1"), (2, 10, "2026-06-11 11:00:00", "save", "0", "0"),
         (3, 20, "2026-06-11 10:00:00", "save", " 3", "1x"), (4, 20, "2026-06-11 12:00:00", "finish", "n/a", "1"),
         (5, 20, "2026-06-11 13:00:00", "finish", "-1", "1")],
        "event_id long, match_id long, ts string, action string, home_goals string, away_goals string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    got = scoring.match_results_apply(matches, log)
    assert c.rows(got, "match_order", "status", "home_goals", "away_goals", "actual_result") == [
        (1, "in_progress", 0, 0, "1"), (2, "in_progress", 3, 1, None)]


def test_missing_pick_breaks_a_run(spark):
    matches, who = c.finished(spark, "1111"), c.people(spark, "ana", "bea", "cai", "dan")
    got = stats.streaks(who, c.picks(spark, {1: "11-1", 2: "111-", 3: "1111"}), matches)
    assert c.rows(got) == [(1, 2, 1), (2, 3, 0), (3, 4, 4), (4, 0, 0)]


def test_set_ids_are_standard_name_based_uuids(spark):
    labels = ["Pronóstico de Juan", "set-1", "", "ñandú ⚽"]
    got = spark.createDataFrame([(x,) for x in labels], "label string").select("label", label_uuid("label").alias("id"))
    assert c.by(got, "label", "id") == {x: str(uuid.uuid5(uuid.UUID(int=0), x)) for x in labels}


def test_percent_divides_before_scaling(spark):
    votes = spark.createDataFrame([(v, t) for t in range(1, 120) for v in range(t + 1)], "v int, t int")
    from poolboard.functions.outcomes import percent
    got = votes.select("v", "t", percent("v", "t").alias("p")).collect()
    assert all(r.p == int(r.v / r.t * 100 + 0.5) for r in got)


def test_admin_only_calls_refuse_others(spark):
    who = c.users(spark, (1, "ana", True, False), (2, "boss", True, True))
    with pytest.raises(PermissionError):
        picks.match_picks(c.picks(spark, {1: "1"}), who, 10, caller=1)
    assert picks.match_picks(c.picks(spark, {1: "1"}), who, 10, caller=2).count() == 1
    assert policy.admin_only(who, who, 1).count() == 0
    assert policy.admin_only(who, who, 2).count() == 2
    assert policy.admin_only(who, who, 77).count() == 0


def test_removing_a_friend_leaves_the_edge_the_other_side_made(spark):
    edges = spark.createDataFrame([(1, 2), (3, 1)], "user_id long, friend_id long")
    asked = spark.createDataFrame([(1, 2), (1, 3)], "user_id long, friend_id long")
    assert c.rows(social.friend_remove(edges, asked)) == [(3, 1)]
    assert c.rows(social.friend_remove(edges, asked, both=True)) == []


def test_sheet_rules_in_order(spark):
    sheet = spark.createDataFrame(
        [(1, 9, "1", "x ", "X", None, None), (1, 8, "2", "", None, "\tX\u00a0", "1"), (1, 7, "3.0", None, "\u2003x\r\n", "", None),
         (1, 6, "4", "", "", "", " x"), (1, 5, "5", "", "", "", "9"), (1, 4, "9", "X", "", "", ""), (1, 3, "0", "X", "", "", ""),
         (1, 2, None, "X", "", "", ""), (1, 1, "uno", "X", "", "", ""), (1, 0, "1.5", "X", "", "", "")], SHEET)
    read = sheets.sheet_rows(sheet, c.finished(spark, "11111"))
    assert c.rows(sheets.sheet_normalise(read)) == [(1, 2, 20, "2"), (1, 3, 30, "X"), (1, 4, 40, "X")]
    assert c.rows(sheets.sheet_errors(read), "set_id", "row", "error") == [
        (1, 0, "Fila #1.5: partido no encontrado"), (1, 4, "Fila #9: partido no encontrado"),
        (1, 5, "Fila #5: sin pronóstico"), (1, 9, "Fila #1: tiene más de una X marcada")]


def test_a_blank_label_stages_nothing(spark):
    sheet = spark.createDataFrame([(s, 1, "1", "X", "", "", "") for s in (1, 2)], SHEET)
    read = sheets.sheet_rows(sheet, c.finished(spark, "1"))
    labels = spark.createDataFrame([(1, "\u00a0 \t"), (2, "\t juan\u00a0")], "set_id long, label string")
    staged = sheets.stage_sets(read, sheets.sheet_verdict(read, size=1), labels, c.pending(spark))
    assert c.rows(staged, "label", "match_id") == [("juan", 10)]


def test_an_export_filled_in_can_be_imported(spark, tmp_path):
    matches = c.finished(spark, "1X2").withColumn("match_date", F.lit("2026-06-11").cast("date"))
    blank = fixtures.fixture_export(matches)
    marked = {1: "Gana Local", 2: "Empate", 3: "Gana Visitante"}
    filled = blank
    for order, column in marked.items():
        filled = filled.withColumn(column, F.when(F.col("#") == order, " x").otherwise(F.col(f"`{column}`")))
    path = str(tmp_path / "filled")
    filled.withColumn("set_id", F.lit("juan")).coalesce(1).orderBy("#").write.partitionBy("set_id").option(
        "header", True).csv(path)
    read = sheets.sheet_rows(sheets.read_filled(spark, path), matches)
    assert c.rows(sheets.sheet_normalise(read)) == [("juan", 1, 10, "1"), ("juan", 2, 20, "X"), ("juan", 3, 30, "2")]


def test_verdict_shows_ten_errors_and_counts_the_rest(spark):
    sheet = spark.createDataFrame(
        [(1, 20 - i, str(i), "", "", "", "") for i in range(1, 13)] + [(2, 1, "1", "X", "", "", "")], SHEET)
    got = {r.set_id: r for r in sheets.sheet_verdict(sheets.sheet_rows(sheet, c.finished(spark, "1" * 12))).collect()}
    lines = got[1].message.split("\n")
    assert (lines[0], len(lines), lines[1], lines[-1]) == ("Errores:", 12, "Fila #12: sin pronóstico", "...y 2 más")
    assert got[2].message == "Se encontraron 1 pronósticos válidos, se necesitan 72."


def test_notification_lines_appear_only_when_they_apply(spark):
    match = c.finished(spark, "1")
    subs = spark.createDataFrame([(1, 1, "e"), (2, 2, "e"), (3, 3, "e"), (4, 4, "e")],
                                 "sub_id long, user_id long, endpoint string")
    table = spark.createDataFrame([(1, 1, 3), (2, 5, 2), (3, 4, None)],
                                  "user_id long, position long, prev_position long")
    got = outbox.finish_outbox(match, subs, c.picks(spark, {1: "1", 2: "X"}), table)
    bodies = c.by(got, "sub_id", "body")
    head = "⚽ HOME 1 1 - 0 AWAY 1\nResultado: Local"
    assert bodies == {
        1: f"{head}\n✅ ¡Acertaste!\n📊 Posición: 1° (subiste 2 🔼)",
        2: f"{head}\n❌ No acertaste\n📊 Posición: 5° (bajaste 3 🔽)",
        3: f"{head}\n📊 Posición: 4°",
        4: head,
    }
    assert c.rows(got, "title", "url")[0] == ("🏁 Finalizó #1", "/partidos")


def test_any_failed_send_removes_the_subscription(spark):
    subs = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "sub_id long, user_id long, endpoint string")
    sent = spark.createDataFrame([(1, False), (2, True)], "sub_id long, delivered boolean")
    assert c.rows(outbox.prune_subscriptions(subs, sent), "sub_id") == [(2,)]
    assert c.rows(outbox.delivery_summary(sent)) == [(1, 2, 1)]


def test_upsert_overwrites_with_nulls_and_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 6)], "id long, name string, city string, n int")
    new = spark.createDataFrame([(2, "B", None), (3, "C", "z")], "id long, name string, city string")
    got = maintain.upsert_update(old, new, ["id"], ["city"])
    assert c.rows(got) == [(1, "a", "x", 5), (2, "b", None, 6), (3, "C", "z", None)]


def test_synthetic_picks_fill_only_what_is_missing(spark):
    have = c.picks(spark, {1: "1-"})
    got = maintain.synthetic_picks(c.people(spark, "ana", "bea"), c.finished(spark, "11"), have)
    assert c.rows(got, "user_id", "match_id") == [(1, 20), (2, 10), (2, 20)]
    assert {r.predicted_result for r in got.collect()} <= {"1", "X", "2"}


def test_cards_follow_the_next_open_match(spark):
    who, matches = c.people(spark, "ana", "bea"), c.fixtures(spark, *[(i, "pending", None, None, None) for i in (1, 2, 3)])
    chosen = c.picks(spark, {1: "1-X"})
    assert c.by(picks.next_open_match(who, chosen, matches), "user_id", "next_order") == {1: 2, 2: 1}
    cards = picks.pick_card_state(who, chosen, matches)
    assert c.rows(cards, "user_id", "match_order", "home_short", "picked", "state") == [
        (1, 1, "HOME", "1", "locked"), (1, 2, "HOME", None, "enabled"), (1, 3, "HOME", "X", "locked"),
        (2, 1, "HOME", None, "enabled"), (2, 2, "HOME", None, "disabled"), (2, 3, "HOME", None, "disabled")]


def test_digest_only_for_full_cards(spark):
    matches = c.finished(spark, "1X2")
    got = picks.picks_digest(c.people(spark, "ana", "bea"), c.picks(spark, {1: "1X2", 2: "11-"}), matches, size=3)
    assert c.rows(got, "user_id", "match_order", "pick") == [(1, 1, "Local"), (1, 2, "Empate"), (1, 3, "Visitante")]
    assert c.rows(got, "mail_to", "display_name") == [("ana@example.org", "ana")] * 3


def test_calendar_audit_finds_wrong_days_and_order(spark):
    matches = c.finished(spark, "111").withColumn(
        "match_date", F.when(F.col("match_order") == 2, F.lit("2026-06-14")).otherwise(F.lit("2026-06-15")).cast("date")
    ).withColumn("match_day", F.when(F.col("match_order") == 2, "Domingo").when(F.col("match_order") == 3, "Martes")
                 .otherwise("Lunes"))
    got = quality.check_fixture_calendar(matches)
    assert c.rows(got, "match_order", "problem") == [(2, "kickoff_order"), (3, "weekday")]


def test_sequence_by_order_and_by_time(spark):
    chosen = c.picks(spark, {1: "11-1", 2: "11"}).withColumn(
        "created_at", F.when((F.col("user_id") == 2) & (F.col("match_id") == 10), F.lit("2026-01-02"))
        .otherwise(F.lit("2026-01-01")).cast("date"))
    stray = spark.createDataFrame([(2, 999, "1", "2026-01-09")], c.PICK_TYPES + ", created_at string").withColumn(
        "created_at", F.col("created_at").cast("date"))
    chosen, matches = chosen.unionByName(stray), c.finished(spark, "1111")
    assert c.rows(quality.check_sequence(chosen, matches), "user_id", "match_order", "problem") == [
        (1, 4, "out_of_sequence"), (2, None, "unknown_match")]
    assert c.rows(quality.check_sequence_replay(chosen, matches), "user_id", "match_order", "problem") == [
        (1, 4, "out_of_sequence"), (2, 2, "out_of_sequence"), (2, None, "unknown_match")]


def test_domain_audit_reports_every_broken_rule(spark):
    matches = c.fixtures(spark, (99, "over", None, None, "3"))
    edges = spark.createDataFrame([(1, 1), (1, 2)], "user_id long, friend_id long")
    got = quality.check_domain(c.picks(spark, {1: "9"}), matches, c.pending(spark, ("l", 10, "Q", None)), edges)
    assert c.rows(got, "relation", "rule", "value") == [
        ("friendships", "self_friend", "1"), ("matches", "match_order", "99"), ("matches", "outcome", "3"),
        ("matches", "status", "over"), ("pending_predictions", "outcome", "Q"), ("predictions", "outcome", "9")]


def test_write_gate_follows_owner_and_admin(spark):
    who = c.users(spark, (1, "ana", True, False), (2, "boss", True, True))
    changes = spark.createDataFrame(
        [("predictions", "insert", 1, 1, True), ("predictions", "update", 1, 1, False), ("predictions", "insert", 1, 2, False),
         ("friendships", "delete", 1, 1, True), ("push_subscriptions", "update", 1, 1, False),
         ("users", "update", 1, 1, True), ("users", "update", 1, 2, True), ("users", "delete", 1, 2, False),
         ("matches", "update", 1, 2, True), ("matches", "insert", 1, 2, False), ("matches", "update", 1, 1, False),
         ("pending_predictions", "delete", 1, 2, True), ("pending_predictions", "insert", 1, 1, False),
         ("elsewhere", "insert", 1, 1, False)],
        "relation string, operation string, owner_id long, writer_id long, expected boolean")
    assert policy.write_gate(changes, who).where("allowed <> expected").count() == 0


def test_files_of_an_import_follow_the_bytes_and_not_the_sets(spark, tmp_path):
    import os

    cells = [(s, str(i), "", "", "", " x" if i == s % 3 + 1 else "", "", "", "", "") for s in range(300) for i in (1, 2, 3)]
    filled = spark.createDataFrame(cells, ["set_id", *wording.SHEET_HEADER])
    path = str(tmp_path / "filled")
    sheets.write_filled(filled, path)
    found = [name for _, _, names in os.walk(path) for name in names if name.endswith(".csv")]
    assert 0 < len(found) <= 8
    read = sheets.read_filled(spark, path, "bigint", together=True)
    assert read.count() == 900 and dict(read.dtypes)["set_id"] == "bigint"
    got = sheets.sheet_normalise(sheets.sheet_rows(read, c.finished(spark, "1X2")))
    assert c.rows(got) == sorted(((s, s % 3 + 1, (s % 3 + 1) * 10, "1") for s in range(300)), key=repr)
