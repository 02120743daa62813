"""Requests on a stream: one computation for all that ask for the same, and results that are awaited together.

Both are keyed state with event-time limits.  What happens depends on the times of the events
alone, not on how they are cut into batches, as long as none is later than the watermark; the
state of a key has a fixed size, and a query that is started again from its checkpoint goes on
where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship

FLIGHTS = "key string, kind string, flight string, request_id string, value string, ts timestamp"
SETTLED = "set_id string, role_id long, path string, gap string, missing array<string>, late boolean, ts timestamp"


def _millis(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


def single_flight(events: DataFrame, limit_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """What becomes of requests (``FLIGHTS``), from events (key, kind, request_id, value, ts).

    Kinds of events: ``request``, and ``result`` with the value that was computed for a key.
    The first request of a key opens a flight, named by it: ``compute``.  Requests that come while
    it is open ``attach``.  A result closes it: ``answer``, with its value; if none comes within
    ``limit_ms`` of its opening it has ``expired``, and the next request opens another.  A result
    without an open flight is ``stray``.  At one time requests come before results, then by id.
    """
    ship(events.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        flight, since = state.get if state.exists else (None, None)

        def say(kind: str, ms: int, request=None, value=None) -> None:
            out.append((key[0], kind, flight, request, value, _time(ms)))

        if state.hasTimedOut:
            say("expired", since + limit_ms)
            state.remove()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FLIGHTS.split(", ")])
            return
        rows = pd.concat(list(frames))
        rows = rows.assign(_kind=rows["kind"] == "result").sort_values(["ts", "_kind", "request_id"], na_position="last")
        for r in rows.itertuples():
            ms = _millis(r.ts)
            if flight is not None and ms - since > limit_ms:
                say("expired", since + limit_ms)
                flight = None
            if r.kind == "request":
                new = flight is None
                if new:
                    flight, since = r.request_id, ms
                say("compute" if new else "attach", ms, r.request_id)
            elif r.kind == "result":
                if flight is None:
                    say("stray", ms, None, r.value)
                else:
                    say("answer", ms, None, r.value)
                    flight = None
        if flight is not None:
            state.update((flight, since))
            state.setTimeoutTimestamp(max(since + limit_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FLIGHTS.split(", ")])

    slim = events.select("key", "kind", "request_id", F.col("value").cast("string").alias("value"), "ts").filter("key is not null and ts is not null")
    return slim.withWatermark("ts", watermark).groupBy("key").applyInPandasWithState(run, FLIGHTS, "flight string, since long", "append", GroupStateTimeout.EventTimeTimeout)


def answers(flights: DataFrame) -> DataFrame:
    """(key, request_id, computed, outcome, value): one row for each request, from the rows of :func:`single_flight`.

    Outcome: answer, expired, or open while there is neither.
    """
    asked = flights.filter("kind in ('compute', 'attach')").select("key", "flight", "request_id", (F.col("kind") == "compute").alias("computed"))
    ends = flights.filter("kind in ('answer', 'expired')").select("key", "flight", F.col("kind").alias("outcome"), F.col("value").alias("_value"))
    both = asked.join(ends, ["key", "flight"], "left")
    return both.select("key", "request_id", "computed", F.coalesce("outcome", F.lit("open")).alias("outcome"), F.col("_value").alias("value"))


def settle_all(events: DataFrame, limit_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """The two results of every selected role (``SETTLED``), when both are there or the limit has passed.

    ``events``: set_id, role_id, kind, value, ts; kinds: ``select``, ``path``, ``gap``.  The limit
    counts from the selection; a result that comes before it waits for it as long.  ``missing``
    names the results that did not come in time.  The first result of a kind counts.  A result that
    comes after its role was released is reported alone, with ``late``, as long as its selection
    is remembered (the limit).
    """
    ship(events.sparkSession)
    names = [c.split()[0] for c in SETTLED.replace("array<string>", "a").split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        since, chosen, path, gap, done = state.get if state.exists else (None, False, None, None, False)

        def release(ms: int) -> None:
            missing = [n for n, v in (("path", path), ("gap", gap)) if v is None]
            out.append((*key, path, gap, missing, False, _time(ms)))

        if state.hasTimedOut:
            if chosen and not done:
                release(since + limit_ms)
            state.remove()
            if out:
                yield pd.DataFrame(out, columns=names)
            return
        rows = pd.concat(list(frames))
        order = {"select": 0, "path": 1, "gap": 2}
        rows = rows.assign(_kind=rows["kind"].map(order)).dropna(subset=["_kind"]).sort_values(["ts", "_kind", "value"], na_position="last")
        for r in rows.itertuples():
            ms = _millis(r.ts)
            if since is not None and ms - since > limit_ms:
                if chosen and not done:
                    release(since + limit_ms)
                    done = True
                elif not chosen:  # what waited for a selection has waited long enough
                    since, path, gap = None, None, None
            if r.kind == "select":
                if not chosen:
                    since, chosen = ms, True
            elif done:
                out.append((*key, r.value if r.kind == "path" else None, r.value if r.kind == "gap" else None, [], True, r.ts))
                continue
            else:
                since = ms if since is None else since
                path = r.value if r.kind == "path" and path is None else path
                gap = r.value if r.kind == "gap" and gap is None else gap
            if chosen and not done and path is not None and gap is not None:
                release(ms)
                done = True
        if since is not None:
            state.update((since, chosen, path, gap, done))
            state.setTimeoutTimestamp(max(since + limit_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    slim = events.select("set_id", "role_id", "kind", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"), "ts").dropna(subset=["set_id", "role_id", "ts"])
    kept = "since long, chosen boolean, path string, gap string, done boolean"
    return slim.withWatermark("ts", watermark).groupBy("set_id", "role_id").applyInPandasWithState(run, SETTLED, kept, "append", GroupStateTimeout.EventTimeTimeout)


def prepared_sets(selected: DataFrame, settled: DataFrame) -> DataFrame:
    """(set_id, prepared, missing): whether every selected role of a set has both results, and how many results are missing for good."""
    own = settled.filter("not late").select("set_id", "role_id", F.size("missing").alias("_missing"))
    both = selected.select("set_id", "role_id").distinct().join(own, ["set_id", "role_id"], "left")
    return both.groupBy("set_id").agg(F.every(F.col("_missing").isNotNull()).alias("prepared"), F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing"))
