"""Contest relations made from the driver's star-schema tables.

Two contests: *wide* has one fixture per part, for volume; *dense* has the
72 fixtures of a real contest and suppliers as participants.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.outcomes import derive_result
from ..functions.wording import CONTEST_SIZE, WEEKDAYS
from ..operators.fixtures import with_team_names
from ..session import fresh_path
from .arrivals import let_arrive, read_log, write_log

_FIRST_DAY = "2026-06-11"
_WEEK = ", ".join(f"'{day}'" for day in WEEKDAYS[4:] + WEEKDAYS[:4])  # from the first day, a Thursday, on


def _outcome(flag: str = "l_returnflag") -> Column:
    return F.when(F.col(flag) == "A", "1").when(F.col(flag) == "N", "X").otherwise("2")


class Relations:
    """Lazy relations of one data folder; nothing is registered in the session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._stored: dict[str, DataFrame] = {}

    def arrivals(self, name: str, df: DataFrame, order: list[str], parts: int = 3) -> tuple[DataFrame, Iterator[int]]:
        """A frame as a stream of rows by ``order``, and an iterator that lets them arrive in ``parts``."""
        path = fresh_path(self.spark, f"arriving-{name}")
        write_log(df, path, order)
        return read_log(self.spark, path, df.schema), let_arrive(path, parts)

    def stored(self, name: str, df: DataFrame | None = None) -> DataFrame:
        """A relation written once to the shared folder, for queries that read it several times."""
        if name not in self._stored:
            path = fresh_path(self.spark, name)
            (getattr(self, name)() if df is None else df).write.parquet(path)
            self._stored[name] = self.spark.read.parquet(path)
        return self._stored[name]

    def table(self, name: str) -> DataFrame:
        """A driver table; its footer is read once per set of relations."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # -- dimensions ----------------------------------------------------------

    def participants(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("user_id"),
            F.col("c_name").alias("username"),
            F.concat(F.lit("u"), key, F.lit("@example.org")).alias("email"),
            F.when(key % 3 != 0, F.col("c_mktsegment")).alias("nombre"),
            (F.col("c_acctbal") >= 0).alias("is_approved"),
            (key % 500 == 0).alias("is_admin"),
        )

    def stored_points(self) -> DataFrame:
        """Participants with a points column as some earlier run left it."""
        old = self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.floor(F.abs("c_acctbal") / 100).cast("long").alias("total_points"))
        return self.participants().join(old, "user_id")

    def dated_participants(self) -> DataFrame:
        """Participants with the day they signed up."""
        day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("user_id") * 7919 % 150).cast("int"))
        return self.participants().withColumn("created_at", day)

    def d_participants(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("user_id"), F.col("s_name").alias("username"),
            F.concat(F.lit("s"), key, F.lit("@example.org")).alias("email"),
            F.when(key % 3 != 0, F.concat(F.lit("Nombre "), key)).alias("nombre"))

    def teams(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
            F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team"), F.col("r_name").alias("grp"))

    def fixtures(self) -> DataFrame:
        return self._fixtures_of(self.table("part"))

    def d_fixtures(self) -> DataFrame:
        """The whole of ``part`` folded onto the slots of a real contest."""
        slot = (F.col("p_partkey") % CONTEST_SIZE).alias("p_partkey")
        return self._fixtures_of(self.table("part").groupBy(slot).agg(
            (F.sum("p_size") % 50 + 1).cast("int").alias("p_size")))

    def _fixtures_of(self, parts: DataFrame) -> DataFrame:
        played = parts.selectExpr(
            "p_partkey + 1 as match_id",
            "p_partkey + 1 as match_order",
            "p_partkey % 25 as home_id",
            "case when p_partkey % 7 = 0 then (p_partkey + 1) % 25 "
            "else (p_partkey + 5 * (1 + floor(p_partkey / 25) % 4)) % 25 end as away_id",
            f"date_add(date '{_FIRST_DAY}', cast(floor(p_partkey / 4) as int)) as match_date",
            "concat(13 + (p_partkey % 4) * 3, ':00:00') as match_time",
            f"elt(cast((floor(p_partkey / 4) + if(p_partkey % 17 = 0, 1, 0)) % 7 as int) + 1, {_WEEK}) as match_day",
            "case when p_partkey % 10 < 7 then 'finished' when p_partkey % 10 < 9 then 'in_progress' "
            "else 'pending' end as status",
            "if(p_partkey % 10 = 9 or p_size = 11, null, p_size % 4) as home_goals",
            "if(p_partkey % 10 = 9 or p_size = 11, null, cast(p_partkey % 3 as int)) as away_goals",
        )
        return played.withColumn("actual_result", derive_result(given=F.lit(None).cast("string")))

    def named_fixtures(self) -> DataFrame:
        return with_team_names(self.fixtures(), self.teams())

    def d_named_fixtures(self) -> DataFrame:
        return with_team_names(self.d_fixtures(), self.teams())

    # -- picks ---------------------------------------------------------------

    def _pick_lines(self) -> DataFrame:
        lines = self.table("lineitem").where(F.col("l_linestatus") == "F").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", _outcome().alias("pick"))
        buyers = self.table("orders").select("o_orderkey", "o_custkey")
        return lines.join(buyers, F.col("o_orderkey") == F.col("l_orderkey"))

    def raw_picks(self, first_only: bool = False) -> DataFrame:
        """Every pick with its arrival number per user and match, or the first of each.

        The condition sits on the number, so Spark trims each group before the shuffle.
        """
        arrived = Window.partitionBy("o_custkey", "l_partkey").orderBy(
            "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
        ranked = self._pick_lines().withColumn("arrival", F.row_number().over(arrived))
        if first_only:
            ranked = ranked.where(F.col("arrival") == 1)
        return ranked.select(
            F.col("o_custkey").alias("user_id"), (F.col("l_partkey") + 1).alias("match_id"),
            F.col("pick").alias("predicted_result"), F.col("l_shipdate").alias("created_at"), "arrival")

    def pick_copies(self) -> DataFrame:
        """Every pick as it came, unnumbered."""
        return self._pick_lines().select(
            F.col("o_custkey").alias("user_id"), (F.col("l_partkey") + 1).alias("match_id"),
            F.col("pick").alias("predicted_result"))

    def picks(self) -> DataFrame:
        return self.raw_picks(first_only=True).drop("arrival")

    def pending_with_id(self) -> DataFrame:
        lines = self.table("lineitem").where(F.col("l_linestatus") == "O").select(
            F.xxhash64("l_orderkey", "l_linenumber").alias("id"),
            "l_suppkey", "l_partkey", _outcome().alias("predicted_result"))
        labels = self.table("supplier").select("s_suppkey", "s_name")
        return lines.join(labels, F.col("s_suppkey") == F.col("l_suppkey")).select(
            "id", F.col("s_name").alias("label"), (F.col("l_partkey") + 1).alias("match_id"), "predicted_result",
            F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey")).alias("assigned_to"))

    def pending(self) -> DataFrame:
        return self.pending_with_id().drop("id")

    def d_picks(self) -> DataFrame:
        slot = F.col("l_partkey") % CONTEST_SIZE
        first = Window.partitionBy("l_suppkey", "slot").orderBy(
            "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
        lines = self.table("lineitem").select(
            "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_shipdate",
            slot.alias("slot"), _outcome().alias("pick"))
        skipped = (F.col("l_suppkey") % 2 == 1) & ((F.col("l_suppkey") * 7 + F.col("slot")) % 41 == 0)
        return (lines.where(~skipped).withColumn("rn", F.row_number().over(first)).where(F.col("rn") == 1)
                .select(F.col("l_suppkey").alias("user_id"), (F.col("slot") + 1).alias("match_id"),
                        F.col("pick").alias("predicted_result"), F.col("l_shipdate").alias("created_at")))

    def d_pending(self) -> DataFrame:
        user = F.col("user_id")
        return self._d_pick_table().select(
            F.concat(F.lit("set-"), user).alias("label"), "match_id", "predicted_result",
            F.when(user % 4 == 0, user).alias("assigned_to"))

    def _d_pick_table(self) -> DataFrame:
        return self._stored.get("d_picks") or self.d_picks()

    def attempts(self) -> DataFrame:
        """Pick attempts with repeats, gaps and matches that don't exist."""
        return self.table("lineitem").select(*attempt_columns())

    # -- friends -------------------------------------------------------------

    def _friend_rows(self, statuses: str, *extra: Column) -> DataFrame:
        people = self.table("customer").agg(F.count("*")).scalar()
        rows = self.table("orders").where(F.col("o_orderstatus").isin(*statuses))
        for condition in extra:
            rows = rows.where(condition)
        return rows.select(F.col("o_custkey").alias("user_id"),
                           (F.floor("o_totalprice").cast("long") % people).alias("friend_id"))

    def friend_edges(self) -> DataFrame:
        return self._friend_rows("PF").where(F.col("user_id") != F.col("friend_id")).distinct()

    def friend_requests(self) -> DataFrame:
        """Wanted edges, with repeats and people who ask for themselves."""
        return self._friend_rows("O")

    def unfriend_requests(self) -> DataFrame:
        return self._friend_rows("PF", F.col("o_orderpriority") == "1-URGENT").select(
            F.col("friend_id").alias("user_id"), F.col("user_id").alias("friend_id"))

    # -- sheets --------------------------------------------------------------

    def sheet(self) -> DataFrame:
        first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey")
        flag, tax, discount, quantity = (F.col(c) for c in ("l_returnflag", "l_tax", "l_discount", "l_quantity"))
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            "l_returnflag", "l_tax", "l_discount", "l_quantity")
        return lines.withColumn("rn", F.row_number().over(first)).where(F.col("rn") == 1).select(
            F.col("l_orderkey").alias("set_id"), (10 - F.col("l_linenumber")).cast("long").alias("row"),
            _number_cell(F.col("l_linenumber"), F.col("l_partkey")).alias("match_order"),
            F.when((flag == "A") | (quantity == 1), F.when(F.col("l_partkey") % 3 == 0, "\tx\u00a0").otherwise("x "))
            .otherwise("").alias("gana_local"),
            F.when((flag == "N") & (tax < 0.08), F.when(F.col("l_partkey") % 3 == 0, "\u2003X\r\n").otherwise(" X"))
            .alias("empate"),
            F.when((flag == "R") & (discount < 0.1), "X").when(quantity == 2, "X").alias("gana_visitante"),
            F.when((flag == "R") & (discount >= 0.1) & (tax < 0.05), "2").when(tax == 0.08, "q").alias("old_pick"))

    def d_sheet(self) -> DataFrame:
        user, match, pick = F.col("user_id"), F.col("match_id"), F.col("predicted_result")
        new_format = match % 6 != 0
        twice = (user % 10 == 4) & (match == 50)
        return self.d_picks().select(
            user.alias("set_id"), (match * 37 % 73).alias("row"),
            F.when((user % 10 == 8) & (match == 5), "1005").when((user % 10 == 2) & (match == 7), "siete")
            .when((user % 10 == 6) & (match == 9), "9.5").otherwise(match.cast("string")).alias("match_order"),
            F.when(new_format & ((pick == "1") | twice), "x\t").otherwise("").alias("gana_local"),
            F.when(new_format & ((pick == "X") | twice), "\u00a0X").alias("empate"),
            F.when(new_format & (pick == "2"), "X").alias("gana_visitante"),
            F.when(~new_format & ~((user % 10 == 6) & (match == 12)), F.lower(pick)).alias("old_pick"))

    def assign_requests(self) -> DataFrame:
        user = F.col("user_id")
        return self._d_pick_table().select("user_id").distinct().select(
            F.concat(F.lit("set-"), user).alias("label"),
            F.when(user % 3 == 0, user).otherwise(user + 1000000).alias("user_id"))

    # -- events --------------------------------------------------------------

    def subscription_log(self) -> DataFrame:
        return self.table("events").select(*subscription_columns())

    def unsubscribe_requests(self) -> DataFrame:
        return self.table("events").where(F.col("event_type") == "click").select(
            "user_id", F.concat(F.lit("ep-"), F.col("event_id") % 3).alias("endpoint")).distinct()

    def results_log(self) -> DataFrame:
        return self.table("events").where(F.col("event_type").isin("view", "purchase")).select(*result_columns())

    def signups(self) -> DataFrame:
        key = F.col("event_id")
        named = F.concat(F.lit('{"username":"nick'), key, F.lit('","nombre":"N"}'))
        return self.table("events").where(F.col("event_type") == "signup").select(
            key.alias("user_id"),
            F.concat(F.lit("mail"), key, F.lit("@example.org")).alias("email"),
            F.when(key % 2 == 0, named).otherwise("{}").alias("raw_meta"))

    def approval_requests(self) -> DataFrame:
        return self.table("events").where(F.col("event_type") == "signup").select("user_id").distinct()

    def change_set(self) -> DataFrame:
        """Wanted row changes, each with its writer and the owner of the row."""
        kind, key = F.col("event_type"), F.col("event_id")
        relation = (F.when(kind == "signup", "users").when(kind == "click", "friendships")
                    .when(kind == "view", "predictions").when(kind == "purchase", "matches")
                    .when(key % 4 < 2, "push_subscriptions").otherwise("pending_predictions"))
        operation = F.when(key % 3 == 0, "insert").when(key % 3 == 1, "update").otherwise("delete")
        return self.table("events").select(
            key.alias("change_id"), relation.alias("relation"), operation.alias("operation"),
            F.col("user_id").alias("owner_id"),
            F.when(F.col("value") < 20, F.col("user_id")).otherwise(key % 7).alias("writer_id"))


def _number_cell(number: Column, key: Column) -> Column:
    """The number cell of a sheet row: mostly the number, now and then a text, a fraction or a zero."""
    return (F.when(key % 29 == 0, "n/a").when(key % 31 == 0, F.concat(number, F.lit(".5")))
            .when(key % 37 == 0, "0").otherwise(number.cast("string")))


def attempt_columns() -> list[Column]:
    """From a lineitem row to a pick attempt; the same for tables and streams."""
    return [
        F.col("l_suppkey").alias("user_id"),
        (F.col("l_partkey") % (CONTEST_SIZE + 3) + 1).alias("match_id"),
        _outcome().alias("predicted_result"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
    ]


def subscription_columns() -> list[Column]:
    """From an event to a subscription write; the same for tables and streams."""
    return [
        F.col("event_id"), F.col("user_id"),
        F.concat(F.lit("ep-"), F.col("event_id") % 3).alias("endpoint"),
        F.col("props").alias("p256dh"),
        F.concat(F.lit("auth-"), F.col("event_id") % 101).alias("auth"),
        F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("event_type") != "error").alias("delivered"),
    ]


def result_columns() -> list[Column]:
    """From an event to a goal edit; the same for tables and streams."""
    key = F.col("event_id")
    return [
        key, (key % CONTEST_SIZE + 1).alias("match_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "purchase", "finish").otherwise("save").alias("action"),
        F.when(key % 11 == 0, "n/a").when(key % 13 == 0, "-1").otherwise((key % 5).cast("string")).alias("home_goals"),
        (key % 3).cast("string").alias("away_goals"),
    ]
