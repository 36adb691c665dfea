"""Approval of users, and the life of imported pick sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_name
from ..functions.wording import CONTEST_SIZE
from .maintain import insert_ignore


def profile_from_signup(signups: DataFrame, users: DataFrame) -> DataFrame:
    """Profiles for sign-ups (each id once) nobody has yet; a name in the metadata wins over the mail's local part."""
    meta = {k: F.get_json_object("raw_meta", f"$.{k}") for k in ("username", "nombre", "apellido")}
    new = signups.join(users.select("user_id"), "user_id", "left_anti")
    return new.select(
        "user_id", F.coalesce(meta["username"], F.split_part("email", F.lit("@"), F.lit(1))).alias("username"),
        "email", meta["nombre"].alias("nombre"), meta["apellido"].alias("apellido"),
        F.lit(False).alias("is_admin"), F.lit(False).alias("is_approved"))


def user_profile(users: DataFrame, user_id) -> DataFrame:
    return users.where(F.col("user_id") == user_id)


def approval_queue(users: DataFrame, arrival: str = "created_at") -> DataFrame:
    """People who wait for approval, first come first."""
    return users.where(~F.col("is_approved") & ~F.col("is_admin")).orderBy(arrival)


def approved_overview(points: DataFrame, picks: DataFrame, pending: DataFrame, size: int = CONTEST_SIZE) -> DataFrame:
    """Approved users with points, progress, and whether a set may be assigned to them."""
    counts = picks.groupBy("user_id").agg(F.count("*").alias("picks"))
    done = F.coalesce("picks", F.lit(0))
    sets_left = unassigned_sets(pending_set_summary(pending)).agg(F.count("*") > 0).scalar()
    return points.where("is_approved").join(counts, "user_id", "left").select(
        "user_id", "username", "nombre", "is_admin", "total_points", done.alias("picks"),
        F.concat(done, F.lit(f"/{size}")).alias("progress"), (done == size).alias("complete"),
        (~F.col("is_admin") & (done == 0) & sets_left).alias("may_assign"))


def approve_users(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Users after the given ids are approved."""
    marked = ids.select("user_id").distinct().withColumn("__ok", F.lit(True))
    approved = F.col("is_approved") | F.coalesce("__ok", F.lit(False))
    return users.join(marked, "user_id", "left").withColumn("is_approved", approved).select(*users.columns)


def approve_all_admins(users: DataFrame) -> DataFrame:
    return users.withColumn("is_approved", F.col("is_approved") | F.col("is_admin"))


def welcome_outbox(before: DataFrame, after: DataFrame) -> DataFrame:
    """One mail per user approved between two snapshots."""
    waiting = before.where(~F.col("is_approved")).select("user_id")
    return after.where("is_approved").join(waiting, "user_id", "left_semi").select(
        "user_id", F.col("email").alias("mail_to"), display_name("nombre", "username").alias("display_name"))


def pending_set_summary(pending: DataFrame) -> DataFrame:
    return pending.groupBy("label").agg(
        F.count("*").alias("picks"), F.min("assigned_to").alias("assigned_to"))


def unassigned_sets(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("assigned_to").isNull())


def assign_eligibility(requests: DataFrame, picks: DataFrame, pending: DataFrame,
                       size: int = CONTEST_SIZE) -> DataFrame:
    """For each wanted (label, user): may it go ahead, and if not, why.

    The user must have no picks and the set exactly ``size`` rows. A set that already
    belongs to someone passes, with a warning. Of several good requests for one user the
    first label passes; after it the user has picks.
    """
    per_user = picks.groupBy("user_id").agg(F.count("*").alias("user_picks"))
    per_set = pending_set_summary(pending).select(
        "label", F.col("picks").alias("set_rows"), F.col("assigned_to").isNotNull().alias("already_assigned"))
    rated = (requests.select("label", "user_id").distinct()
             .join(per_user, "user_id", "left").join(per_set, "label", "left")
             .withColumn("user_picks", F.coalesce("user_picks", F.lit(0)))
             .withColumn("set_rows", F.coalesce("set_rows", F.lit(0)))
             .withColumn("already_assigned", F.coalesce("already_assigned", F.lit(False))))
    good = (F.col("user_picks") == 0) & (F.col("set_rows") == size)
    first = rated.where(good).groupBy("user_id").agg(F.min("label").alias("first_label"))
    reason = (F.when(F.col("user_picks") > 0, "user_has_picks").when(F.col("set_rows") != size, "set_size")
              .when(F.col("label") != F.col("first_label"), "user_has_picks"))
    return rated.join(first, "user_id", "left").withColumn("reason", reason).select(
        "label", "user_id", "user_picks", "set_rows", F.col("reason").isNull().alias("eligible"), "reason",
        "already_assigned")


def _granted(eligibility: DataFrame) -> DataFrame:
    return eligibility.where("eligible").select("label", "user_id")


def assign_sets(eligibility: DataFrame, picks: DataFrame, pending: DataFrame) -> DataFrame:
    """Picks after the eligible sets are copied; of copies within a set one row stays."""
    rows = pending.select("label", "match_id", "predicted_result").join(_granted(eligibility), "label")
    return insert_ignore(picks.select("user_id", "match_id", "predicted_result"),
                         rows.drop("label"), ["user_id", "match_id"], ["predicted_result"])


def stamp_sets(eligibility: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending rows after assignment: the whole set belongs to its (last) user."""
    owner = _granted(eligibility).groupBy("label").agg(F.max("user_id").alias("__owner"))
    return pending.join(owner, "label", "left").withColumn(
        "assigned_to", F.coalesce("__owner", "assigned_to")).select(*pending.columns)


def delete_set(pending: DataFrame, label: str) -> DataFrame:
    return pending.where(F.col("label") != label)
