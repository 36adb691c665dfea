"""Relations of a contest. ``user_id`` may be any orderable type; test data uses bigint."""

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("email", T.StringType(), False),
    T.StructField("nombre", T.StringType()),
    T.StructField("apellido", T.StringType()),
    T.StructField("is_admin", T.BooleanType(), False),
    T.StructField("is_approved", T.BooleanType(), False),
    T.StructField("total_points", T.IntegerType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

FIXTURES = T.StructType([
    T.StructField("match_id", T.LongType(), False),
    T.StructField("match_order", T.LongType(), False),
    T.StructField("home_team", T.StringType(), False),
    T.StructField("away_team", T.StringType(), False),
    T.StructField("match_date", T.DateType(), False),
    T.StructField("match_time", T.StringType(), False),
    T.StructField("match_day", T.StringType()),
    T.StructField("home_goals", T.IntegerType()),
    T.StructField("away_goals", T.IntegerType()),
    T.StructField("actual_result", T.StringType()),
    T.StructField("status", T.StringType(), False),
])

PICKS = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("match_id", T.LongType(), False),
    T.StructField("predicted_result", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

FRIEND_EDGES = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("friend_id", T.StringType(), False),
])

PENDING = T.StructType([
    T.StructField("label", T.StringType(), False),
    T.StructField("match_id", T.LongType(), False),
    T.StructField("predicted_result", T.StringType(), False),
    T.StructField("assigned_to", T.StringType()),
])

SUBSCRIPTIONS = T.StructType([
    T.StructField("sub_id", T.LongType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("p256dh", T.StringType(), False),
    T.StructField("auth", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

RESULTS_LOG = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("match_id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("home_goals", T.StringType()),
    T.StructField("away_goals", T.StringType()),
])
