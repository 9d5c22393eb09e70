"""Chat sessions and users: ownership, merges, lists and probes as relational jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivana.functions.text import session_title

DEFAULT_TITLE = "新的对话"
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def iso(at: Column) -> Column:
    """ISO text of a timestamp, null for null."""
    return F.date_format(at, ISO)


def session_list(sessions: DataFrame, most: int | None = None) -> DataFrame:
    """Sessions (user_id, session_id, created_at, updated_at) with ISO times and ``pos`` in their user's list, latest change first."""
    latest = F.coalesce("updated_at", "created_at").desc()
    out = sessions.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(latest, "session_id")))
    out = out.where(F.col("pos") <= most) if most else out
    return out.select("user_id", "session_id", iso(F.col("created_at")).alias("created_at"), iso(F.col("updated_at")).alias("updated_at"), "pos")


def access(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (user_id, session_id, ...) with ``access``: ok, forbidden (another's session) or missing."""
    owner = sessions.select("session_id", F.col("user_id").alias("__owner"))
    verdict = F.when(F.col("__owner").isNull(), "missing").when(F.col("__owner") == F.col("user_id"), "ok").otherwise("forbidden")
    return requests.join(owner, "session_id", "left").withColumn("access", verdict).drop("__owner")


def append_pairs(sessions: DataFrame, messages: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions (user_id, session_id, title), messages (session_id, turn, role, text) and the refused pairs after an append of
    pairs (user_id, session_id, question, answer), one a session at most.

    A missing session is created; one that has the default title takes it from the question; pairs for another's session are refused.
    """
    asked = access(sessions, pairs)
    ok = asked.where("access != 'forbidden'")
    new = ok.where("access = 'missing'").select("user_id", "session_id", F.lit(DEFAULT_TITLE).alias("title"))
    titled = sessions.unionByName(new).join(ok.select("session_id", "question"), "session_id", "left")
    fresh = (F.col("title") == DEFAULT_TITLE) & F.col("question").isNotNull()
    titled = titled.select("user_id", "session_id", F.when(fresh, session_title(F.col("question"))).otherwise(F.col("title")).alias("title"))
    last = messages.groupBy("session_id").agg(F.max("turn").alias("last"))
    at = F.coalesce(F.col("last") + 1, F.lit(0).cast("long"))
    turn = lambda k, role, c: F.struct((at + k).alias("turn"), F.lit(role).alias("role"), F.col(c).alias("text"))
    added = ok.join(last, "session_id", "left").select("session_id", F.explode(F.array(turn(0, "user", "question"), turn(1, "assistant", "answer"))).alias("m")).select("session_id", "m.*")
    return titled, messages.unionByName(added), asked.where("access = 'forbidden'").drop("access")


def delete_sessions(sessions: DataFrame, messages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages after deletes (user_id, session_id); requests for others' sessions are ignored."""
    gone = sessions.join(requests, ["user_id", "session_id"], "left_semi").select("session_id")
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")


def latest_histories(histories: DataFrame, most: int = 5) -> DataFrame:
    """Of histories (user_id, session_id, at) the latest of each session, and of these the latest few of each user with their ``pos``."""
    each = histories.groupBy("user_id", "session_id").agg(F.max("at").alias("at"))
    out = each.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("at").desc(), "session_id")))
    return out.where(F.col("pos") <= most)


def find_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Logins (login_id, name) with the user (user_id, username, email) whose name or address that is: two equi-joins, a user once."""
    by = lambda c: logins.join(users, logins["name"] == users[c]).select("login_id", "user_id")
    return by("username").union(by("email")).distinct()


def taken(users: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Wanted values (user_id, column) with ``taken``: another user has it."""
    held = users.select(column, F.col("user_id").alias("__by")).where(F.col(column).isNotNull())
    other = wanted.join(held, column).where(F.col("__by") != F.col("user_id")).select("user_id").distinct()
    return wanted.join(other.withColumn("taken", F.lit(True)), "user_id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def put_users(users: DataFrame, changes: DataFrame, columns: list[str], active: int = 1) -> DataFrame:
    """Users after inserts and partial updates (null: unchanged); a new user is active. ``stale`` marks those whose cached form must go."""
    c = changes.select("user_id", *[F.col(x).alias(f"__{x}") for x in columns], F.lit(True).alias("__changed"))
    out = users.withColumn("__old", F.lit(True)).join(c, "user_id", "full")
    values = [F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in users.columns if x not in ("user_id", "status")]
    return out.select("user_id", *values, F.when(F.col("__old").isNull(), F.lit(active)).otherwise(F.col("status")).alias("status"), F.coalesce("__changed", F.lit(False)).alias("stale"))
