"""A contest of a few people and matches, and helpers to read results."""

FIXTURE_TYPES = ("match_id long, match_order long, home_team string, away_team string, match_date date, "
                 "match_time string, match_day string, status string, home_goals int, away_goals int, "
                 "actual_result string")
USER_TYPES = "user_id long, username string, email string, nombre string, is_approved boolean, is_admin boolean"
PICK_TYPES = "user_id long, match_id long, predicted_result string"
PENDING_TYPES = "label string, match_id long, predicted_result string, assigned_to long"


def fixtures(spark, *rows):
    """Rows of (order, status, home_goals, away_goals, result); ids are ten times the order."""
    full = [(o * 10, o, f"HOME {o}", f"AWAY {o}", None, "13:00:00", "Lunes", status, h, a, result)
            for o, status, h, a, result in rows]
    return spark.createDataFrame(full, FIXTURE_TYPES)


def finished(spark, results):
    """One finished match per letter of ``results``, in order."""
    goals = {"1": (1, 0), "X": (0, 0), "2": (0, 1)}
    return fixtures(spark, *[(i, "finished", *goals[r], r) for i, r in enumerate(results, 1)])


def users(spark, *rows):
    """Rows of (id, name, approved, admin)."""
    return spark.createDataFrame(
        [(i, name, f"{name}@example.org", None, approved, admin) for i, name, approved, admin in rows], USER_TYPES)


def people(spark, *names):
    return users(spark, *[(i, n, True, False) for i, n in enumerate(names, 1)])


def picks(spark, by_user):
    """``{user: "1X-2"}``: one letter per match, a dash for no pick."""
    rows = [(user, i * 10, letter) for user, letters in by_user.items()
            for i, letter in enumerate(letters, 1) if letter != "-"]
    return spark.createDataFrame(rows, PICK_TYPES)


def pending(spark, *rows):
    return spark.createDataFrame(list(rows), PENDING_TYPES)


def rows(df, *columns):
    """Sorted tuples of the named columns."""
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
