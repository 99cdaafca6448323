"""Who may see what, tokens that expire, and the ordered rules of sessions and rate limits.

Rate limits and sessions depend on which earlier requests were accepted, so that they run over each key's requests in order: rows are dealt
out by key and sorted, and a task keeps the state of one key at a time, which is bounded by the policy. One key's requests are one task's by the
rule itself: each decision needs the one before. Rows without key are never limited, and are dealt by their id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What each role may do; * is anything.
ROLES = {
    "student": ("assignment:create", "assignment:read:own", "assignment:delete:own", "assignment:lock:own", "assignment:download:own", "report:read:own", "user:read:own", "user:update:own"),
    "teacher": ("assignment:read:assigned", "assignment:download:assigned", "assignment:lock:assigned", "report:read:assigned", "analytics:read:assigned", "user:read:own", "user:update:own"),
    "hod": ("assignment:read:all", "assignment:download:all", "assignment:lock:all", "report:read:all", "analytics:read:all", "user:read:own", "user:update:own"),
    "admin": ("*",),
}
#: Roles that may see analytics.
STAFF = ("hod", "teacher", "admin")
#: Requests and seconds by action; any other action has the last.
POLICIES = {"login": (10, 300), "login_account": (5, 300), "register": (15, 3600), "forgot_password": (5, 900), "reset_password": (5, 900), "resend_verification": (3, 900), "": (20, 60)}
ABSOLUTE, IDLE, PURGE_DAYS = 86_400, 1800, 7
#: How long a code is good, how many wrong ones burn a link, and addresses that are the machine's own.
CODE_MINUTES, CODE_TRIES, LOCAL = 10, 5, ("testclient", "127.0.0.1", "localhost")


def permitted(role: Column, permission: Column) -> Column:
    """Whether a role's set holds a permission; an unknown or null role holds none."""
    sets = F.create_map(*(x for name, held in ROLES.items() for x in (F.lit(name), F.array(*map(F.lit, held)))))
    held = sets[role]
    return F.coalesce(F.array_contains(held, "*") | F.array_contains(held, permission), F.lit(False))


def has_role(role: Column, roles: tuple[str, ...]) -> Column:
    """Whether a role is one of `roles`; none is no role."""
    return F.coalesce(role.isin(*roles), F.lit(False))


def gated(df: DataFrame, role: str | None, roles: tuple[str, ...] | None = None) -> DataFrame:
    """`df` if who asks has one of `roles`, those of the staff by default; its columns without rows if not."""
    return df if role in (STAFF if roles is None else roles) else df.limit(0)


def in_scope(mappings: Column, section: Column, subject: Column) -> Column:
    """Whether any of a teacher's (subject, section) takes in a row: either contains the other, and an empty section takes in all."""
    each_way = lambda a, b: F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))
    return F.exists(mappings, lambda m: ((m["section"] == "") | each_way(m["section"], section)) & each_way(m["subject"], subject))


def token_state(used: Column, expires: Column, now: Column) -> Column:
    """A token is good until its expiry, that moment included."""
    return F.when(used, "used").when(now > expires, "expired").otherwise("valid")


def to_purge(used: Column, used_at: Column, expires: Column, now: Column) -> Column:
    """Tokens that expired, or were used, more than a week ago."""
    cut = now - F.expr(f"INTERVAL {PURGE_DAYS} DAYS")
    return F.coalesce(expires < cut, F.lit(False)) | F.coalesce(used & (used_at < cut), F.lit(False))


def _in_order(df: DataFrame, key: str, order: list[str], fields: list[T.StructField], start, step) -> DataFrame:
    """`df` with what `step(state, row)` gives for each row in the order of its key; `start()` is a new key's state."""
    names = [f.name for f in fields]
    kinds = [pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = state = None
        for batch in batches:
            keys, rows = batch.column(batch.schema.get_field_index(key)).to_pylist(), batch.select(order).to_pylist()
            out = []
            for k, row in zip(keys, rows, strict=True):
                if state is None or k != known or k is None:
                    known, state = k, start()
                out.append(step(state, row))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    dealt = F.when(F.col(key).isNull(), F.xxhash64(order[-1])).otherwise(F.xxhash64(key))
    return df.repartition(dealt).sortWithinPartitions(key, *order).mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def at_seconds(at: datetime) -> float:
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()


def decided(kept: list[float], now: float, most: int, seconds: int) -> tuple[bool, int | None]:
    """Whether a request is refused, and the whole seconds until the next is accepted; `kept`, the times that count, is brought up to date."""
    kept[:] = [x for x in kept if x > now - seconds]
    if len(kept) >= most:
        return True, max(1, int(kept[0] + seconds - now) + 1)
    kept.append(now)
    return False, None


def rate_limited(requests: DataFrame, key: str, at: str, id: str, most: int, seconds: int, reset: str | None = None, cleared: list[datetime] | None = None) -> DataFrame:
    """`requests` with `limited` and, where it is, the whole seconds until the next is accepted. A request that is refused doesn't count for later ones.

    Rows whose column `reset` is true are no requests (`limited` is null): what their key has done until then counts for nothing. After each of
    the moments `cleared`, no key's does.
    """

    def step(kept: list, row: dict) -> tuple[bool | None, int | None]:
        if reset and row[reset]:
            kept.clear()
            return None, None
        now = at_seconds(row[at])
        if moments and kept and bisect_left(moments, kept[-1]) != bisect_left(moments, now):
            kept.clear()
        return decided(kept, now, most, seconds)

    moments = sorted(map(at_seconds, cleared or []))
    fields = [T.StructField("limited", T.BooleanType()), T.StructField("retry_after", T.LongType())]
    return _in_order(requests, key, [at, *([reset] if reset else []), id], fields, list, step)


def sessions(requests: DataFrame, key: str, at: str, id: str, absolute: int = ABSOLUTE, idle: int = IDLE) -> DataFrame:
    """`requests` with the number of the user's session and whether the request opened it: the one before had been idle, or old, for longer than allowed."""

    def step(state: dict, row: dict) -> tuple[int, bool]:
        now = at_seconds(row[at])
        fresh = not state or now - state["last"] > idle or now - state["since"] > absolute
        if fresh:
            state.update(number=state.get("number", 0) + 1, since=now)
        state["last"] = now
        return state["number"], fresh

    fields = [T.StructField("session", T.LongType()), T.StructField("opened", T.BooleanType())]
    return _in_order(requests, key, [at, id], fields, dict, step)


def limited_by_both(requests: DataFrame, first: str, second: str, at: str, id: str, first_policy: tuple[int, int], second_policy: tuple[int, int]) -> DataFrame:
    """`requests` with `limited_by`: the key whose limit refused it, null if both let it pass. What the first refuses never reaches the second."""
    one = rate_limited(requests, first, at, id, *first_policy).withColumnRenamed("limited", "first_limited").drop("retry_after")
    passed = rate_limited(one.where(~F.col("first_limited")), second, at, id, *second_policy)
    two = passed.select(*requests.columns, F.when(F.col("limited"), F.lit(second)).alias("limited_by"))
    return one.where("first_limited").select(*requests.columns, F.lit(first).alias("limited_by")).unionByName(two)


def revoked_all(sessions: DataFrame, users: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """(sessions with all of `users` revoked, (user, revoked): how many were live until then)."""
    wanted = users.select(user).distinct().withColumn("_wanted", F.lit(True))
    marked = sessions.join(wanted, user, "left").withColumn("_wanted", F.coalesce("_wanted", F.lit(False)))
    after = marked.withColumn("is_revoked", F.col("is_revoked") | F.col("_wanted")).select(sessions.columns)
    return after, marked.where("_wanted").groupBy(user).agg(F.count_if(~F.col("is_revoked")).alias("revoked"))


def rotated(sessions: DataFrame, old: DataFrame, fresh: DataFrame, id: str) -> DataFrame:
    """`sessions` with those of `old` revoked and `fresh` ones opened, in one version of the table."""
    gone = old.select(id).distinct().withColumn("_gone", F.lit(True))
    revoked = sessions.join(gone, id, "left").withColumn("is_revoked", F.col("is_revoked") | F.coalesce("_gone", F.lit(False))).select(sessions.columns)
    return revoked.unionByName(fresh, allowMissingColumns=True)


def reset_outcome(used: Column, expires: Column, issued_to: Column, client: Column, code_sent: Column, tries: Column, code_right: Column, now: Column) -> Column:
    """Struct of outcome, attempts and burnt for an attempt at a reset. Another address than the link's needs a code, which is good for ten minutes; the
    fifth wrong one burns the link. `code_right` is null where no code was given."""
    risky = F.coalesce(issued_to != client, F.lit(False)) & ~client.isin(*LOCAL)
    outcome = (
        F.when(used, "used").when(now > expires, "expired").when(~risky, "accepted").when(code_right.isNull(), "code needed")
        .when(now > code_sent + F.expr(f"INTERVAL {CODE_MINUTES} MINUTES"), "code expired").when(code_right, "accepted").otherwise("wrong code")
    )
    wrong = outcome == "wrong code"
    after = tries + F.when(wrong, 1).otherwise(0)
    return F.struct(outcome.alias("outcome"), after.alias("attempts"), (wrong & (after >= CODE_TRIES)).alias("burnt"))
