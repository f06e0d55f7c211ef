"""Claims of unique values, settled as if the requests came one by one.

A request takes values (an e-mail, a student number) for its user; it is
refused when another user holds one of them at its turn, and an accepted
request gives up what its user held of the same kind before.  The order is
that of the request ids.

* Users whose values, held or asked for, nobody else holds or asks for get
  all they ask for.
* A user who asks for nothing more keeps what they hold.  Requests that meet
  such a hold are refused, all in one pass.
* The rest is one chain, where each outcome hangs on the ones before.  It is
  replayed in windows of ``WINDOW`` requests: one task reads a window in
  order, with what its users hold and who holds its values, so its memory is
  that of a window however many requests there are.  What the window's users
  hold afterwards goes into the state of the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelasflow.functions.ids import assign_ids
from kelasflow.functions.shared import materialize

BEFORE = -(1 << 63)             # the turn of what the snapshot holds
WINDOW = 1 << 19                # requests that one task replays


def _values(claims: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, key, user_id) of every value that is asked for."""
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in kinds])
    return claims.select("user_id", F.inline(named)).where("key IS NOT NULL").select("kind", "key", "user_id")


def _refused_for_good(line: DataFrame, state: DataFrame, kinds: list[str]) -> DataFrame:
    """``line`` with ``reason``: set where the first value asked for is held
    by a user who asks for nothing more."""
    settled = (state.join(line.select("user_id").distinct(), "user_id", "left_anti")
               .groupBy("kind", "key").agg(F.min("late").alias("late")))
    first = F.coalesce(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("key"))) for k in kinds])
    return (line.withColumn("_first", first).withColumns({"kind": F.col("_first.kind"), "key": F.col("_first.key")})
            .join(settled, ["kind", "key"], "left")
            .withColumn("reason", F.when(F.col("late").isNotNull(), _reason("kind", "late")))
            .select(*line.columns, "reason"))


def _reason(kind: str, late: str) -> Column:
    return F.concat(F.col(kind), F.when(F.col(late), "_taken_in_batch").otherwise("_taken"))


def _replay(kinds: list[str], keeps: frozenset[str]) -> Callable[[Iterator], Iterator]:
    """Replay of rows in the order of their turns: first what is held (turn
    ``BEFORE``), then the requests.  Gives the refusals, and all that users
    hold (or null) of a kind in which they changed something."""
    def run(batches):
        import pandas as pd
        holders: dict = {k: {} for k in kinds}      # value -> {user: got in this batch}
        mine: dict = {k: {} for k in kinds}         # user -> values
        changed = {k: set() for k in kinds}

        def taken(user, keys):
            for k, key in zip(kinds, keys):
                others = [late for u, late in holders[k].get(key, {}).items() if u != user] if key is not None else []
                if others:
                    return k + ("_taken_in_batch" if all(others) else "_taken")
            return None

        def frame(rows):
            return pd.DataFrame(rows, columns=["turn", "reason", "kind", "user_id", "key", "late"]).astype(
                {"turn": "Int64", "user_id": "Int64", "late": "boolean"})
        for b in batches:
            refused = []
            for turn, user, late, *keys in zip(b["turn"].tolist(), b["user_id"].tolist(), b["late"], *[b[k] for k in kinds]):
                if turn == BEFORE:
                    for k, key in zip(kinds, keys):
                        if key is not None:
                            holders[k].setdefault(key, {})[user] = bool(late)
                            mine[k].setdefault(user, set()).add(key)
                    continue
                why = taken(user, keys)
                if why:
                    refused.append((turn, why, None, None, None, None))
                    continue
                for k, key in zip(kinds, keys):
                    had, new = mine[k].get(user, set()), set() if key is None else {key}
                    if had == new or (key is None and k in keeps):
                        continue
                    for v in had - new:
                        del holders[k][v][user]
                    for v in new - had:
                        holders[k].setdefault(v, {})[user] = True
                    mine[k][user] = new
                    changed[k].add(user)
            if refused:
                yield frame(refused)
        now = [(None, None, k, u, v, holders[k][v][u] if v is not None else None)
               for k in kinds for u in changed[k] for v in (mine[k][u] or {None})]
        for i in range(0, len(now), 50_000):
            yield frame(now[i:i + 50_000])
    return run


def _window(window: DataFrame, state: DataFrame, kinds: list[str], keeps: frozenset[str]) -> DataFrame:
    """The replay of one window: (turn, reason) rows, and (kind, user_id, key, late) rows of changed holds."""
    users = F.broadcast(window.select("user_id").distinct())                    # a window's, not the table's
    asked = F.broadcast(_values(window, kinds).select("kind", "key").distinct())
    theirs = state.join(users, "user_id", "left_semi").select("kind", "key", "user_id", "late")
    # of users who ask for nothing in this window, one stands for all who hold the value
    others = (state.join(asked, ["kind", "key"], "left_semi").join(users, "user_id", "left_anti")
              .groupBy("kind", "key").agg(F.min("user_id").alias("user_id"), F.min("late").alias("late")))
    held = theirs.unionByName(others).select(
        F.lit(BEFORE).alias("turn"), "user_id", "late", *[F.when(F.col("kind") == k, F.col("key")).alias(k) for k in kinds])
    rows = held.unionByName(window.select("turn", "user_id", F.lit(None).cast("boolean").alias("late"), *kinds))
    return materialize(rows.repartition(1).sortWithinPartitions("turn").mapInPandas(
        _replay(kinds, keeps), "turn long, reason string, kind string, user_id long, key string, late boolean"), "replayed")


def settle_claims(requests: DataFrame, held: dict[str, DataFrame],
                  keeps_on_null: frozenset[str] = frozenset()) -> DataFrame:
    """(request_id, reason): null for accepted requests, the refusal of others.

    ``requests`` has request_id (unique, ordering), user_id and one column per
    kind of ``held``, which maps the kind, in the order of the checks, to
    what the snapshot holds: (user_id, key).  Values are compared
    lower-cased.  A null claims nothing; an accepted one gives up what its
    user held, but for the kinds in ``keeps_on_null``, where it leaves all as
    it is.  Refusals read ``<kind>_taken``, or ``<kind>_taken_in_batch`` if
    the holder got the value in this batch; the first kind that is held
    counts.  Requests of null user or id are not expected.
    """
    kinds = list(held)
    claims = materialize(requests.select(
        F.col("request_id").cast("bigint").alias("turn"), F.col("user_id").cast("bigint").alias("user_id"),
        *[F.lower(F.col(k).cast("string")).alias(k) for k in kinds]), "claims")
    values = _values(claims, kinds)
    snapshot = reduce(DataFrame.unionByName, [
        df.select(F.lit(k).alias("kind"), F.lower("key").alias("key"), F.col("user_id").cast("bigint").alias("user_id"))
        for k, df in held.items()]).where("key IS NOT NULL")
    near = (snapshot.join(values.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
            .unionByName(snapshot.join(claims.select("user_id").distinct(), "user_id", "left_semi")))
    state = materialize(near.distinct().withColumn("late", F.lit(False)), "held")
    named = values.unionByName(state.select("kind", "key", "user_id"))
    contested = materialize(named.groupBy("kind", "key").agg(F.min("user_id").alias("_a"), F.max("user_id").alias("_b"))
                            .where("_a <> _b").select("kind", "key"), "contested")
    rivals = named.join(contested, ["kind", "key"], "left_semi").select("user_id").distinct()
    line = materialize(claims.join(rivals, "user_id", "left_semi"), "line")

    refused = [claims.where("false").select("turn", F.lit("").alias("reason"))]
    left, at, windows, due = line.count(), 0, 0, 0
    while left:
        if windows == due:
            judged = _refused_for_good(line if not windows else line.where(F.col("n") > at), state, kinds)
            n = judged.where("reason IS NOT NULL").count()
            due = max(1, 2 * due)
            if n and 2 * n >= left or not windows:
                refused.append(materialize(judged.where("reason IS NOT NULL").select("turn", "reason"), "refused"))
                rest = judged.where("reason IS NULL").select("turn", "user_id", *kinds)
                line, left, at = materialize(assign_ids(rest, ["turn"], F.lit(0), name="n"), "line"), left - n, 0
                continue
        replayed = _window(line.where((F.col("n") > at) & (F.col("n") <= at + WINDOW)), state, kinds, keeps_on_null)
        refused.append(replayed.where("reason IS NOT NULL").select("turn", "reason"))
        at, left, windows = at + WINDOW, max(0, left - WINDOW), windows + 1
        if left:
            now = replayed.where("reason IS NULL")
            kept = state.join(F.broadcast(now.select("kind", "user_id").distinct()), ["kind", "user_id"], "left_anti")
            state = materialize(kept.unionByName(now.where("key IS NOT NULL").select(*kept.columns)), "held")

    why = reduce(DataFrame.unionByName, refused).groupBy("turn").agg(F.min("reason").alias("reason"))
    turns = requests.select(F.col("request_id").cast("bigint").alias("turn"))
    return materialize(turns.join(why, "turn", "left").select(F.col("turn").alias("request_id"), "reason"), "verdicts")
