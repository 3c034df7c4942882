"""Stateful stream operators: counter deltas, the plan throttle, plans of slow queries.

Spark partitions and shuffles the stream by key.  A processor sees the rows of one key in one
micro-batch plus that key's state.  What waits is one list per key, read and written as a whole: a
message to the state store costs more than the row in it.  All of them hold what has arrived until the
event-time watermark has passed it, so files may arrive in any order within the ``delay``; then they
work through it in order of event time.  Rows that come later than that are not lost silently: they
leave the stream unchanged, with ``behind`` set.  State goes once it cannot matter any more.
"""

from __future__ import annotations

import json
import pickle
import sys
from collections.abc import Container, Iterable, Iterator, Sequence
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.functions.text import obfuscate_explain
from fleetlens.operators.logs import EXPLAIN_BYTES, EXPLAIN_SECONDS, EXPLAIN_WITHIN, PLAN_KEYS
from fleetlens.schemas import SERVER

# Workers receive the processors by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FORGET_SECONDS = 86400

_AT = T.StructType([T.StructField("at", T.LongType())])
_ROW = "_row"
#: What several keys hold, pickled as Spark itself pickles the rows of a state, and the timer they share.
_PACKED = T.StructType([T.StructField("packed", T.BinaryType()), T.StructField("timer", T.LongType())])


def _watched(rows: DataFrame, seconds: str, delay: str) -> DataFrame:
    """Let ``seconds`` drive the watermark; late rows still reach the processors, which set them apart."""
    return rows.withColumn("_event", F.timestamp_seconds(seconds)).withWatermark("_event", delay).drop("_event")


def _records(rows: Iterable[Row], names: list[str]) -> Iterator[tuple]:
    """Rows as state takes them."""
    take = None
    for row in rows:
        take = take or itemgetter(*[row.__fields__.index(n) for n in names])
        yield take(row)


def _replace(state, records: list[tuple]) -> None:
    """One message to the state store for a whole list, however many rows wait."""
    if records:
        state.put(records)
    else:
        state.clear()


class _CounterDelta(StatefulProcessor):
    """Pairs each poll of a key with the one before it, once the watermark has passed it.

    The keys of one server share a state: ``own`` names what tells them apart, ``{own: (last, waiting)}``
    is read and written whole, once a micro-batch, and has one timer.  A row has the values that ``packed``
    holds as JSON and then the ``loose`` ones.
    """

    def __init__(self, packed: list[str], doubles: list[str], loose: list[str], state_by: list[str], own: list[str],
                 counters: list[str], adjacent: bool, time: str, forget: int):
        self._names = names = [*packed, *loose]
        self._doubles = [packed.index(n) for n in doubles]
        self._columns = [_ROW, *loose]
        self._state_by = state_by
        self._own = [names.index(n) for n in own]
        self._counters = [names.index(n) for n in counters]
        self._adjacent = adjacent
        self._poll, self._ord, self._time = (names.index(n) for n in ("poll_seq", "ord", time))
        self._forget = forget * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._keys = handle.getValueState("keys", _PACKED)

    def _read(self) -> tuple[dict, int | None]:
        if not self._keys.exists():
            return {}, None
        packed, timer = self._keys.get()
        return pickle.loads(packed), timer

    def _write(self, keys: dict, timer: int | None, now: int | None = None) -> None:
        """``timer`` is the one that is set; from ``now`` on, what it was set for is done."""
        times = [due for _, waiting, due in keys.values() if waiting]
        gone = ((self._gone(last), waiting) for last, waiting, _ in keys.values() if last)
        earliest = min([*times, *[at for at, waiting in gone if now is None or at > now or not waiting]], default=None)
        if earliest != timer:
            if timer is not None and (now is None or timer > now):
                self._handle.deleteTimer(timer)
            if earliest is not None:
                self._handle.registerTimer(earliest)
        if keys:
            self._keys.update((pickle.dumps(keys, pickle.HIGHEST_PROTOCOL), earliest))
        else:
            self._keys.clear()

    def _unpacked(self, rows: Iterable[Row]) -> Iterator[tuple]:
        for found in _records(rows, self._columns):
            text, loose = (found[0], found[1:]) if len(self._columns) > 1 else (found, ())
            record = (*json.loads(text).values(), *loose)
            # JSON has no numbers for these: NaN, Infinity and -Infinity.
            if any(type(record[i]) is str for i in self._doubles):
                record = tuple(float(v) if i in self._doubles and v is not None else v for i, v in enumerate(record))
            yield record

    def _gone(self, last: list[tuple]) -> int:
        return last[0][self._time] * 1000 + self._forget

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (keys, timer), behind, seen, poll = self._read(), [], set(), self._poll
        own = itemgetter(*self._own) if self._own else lambda record: ()
        for record in self._unpacked(rows):
            seen.add(own(record))
            last, waiting, _ = keys.setdefault(own(record), ([], [], 0))
            (behind if last and record[poll] <= last[0][poll] else waiting).append(record)
        out = self._release(keys, timerValues.getCurrentWatermarkInMs(), seen)
        self._write(keys, timer)
        yield from self._out(key, behind, True)
        yield from self._out(key, out, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        keys, timer = self._read()
        out = self._release(keys, now)
        self._write(keys, timer, now)
        yield from self._out(key, out, False)

    def _release(self, keys: dict, now: int, seen: Container = ()) -> list[tuple]:
        """Deltas of all polls that the watermark has passed; the others go on waiting, with the time the first is due.

        Keys whose last poll was too long ago are forgotten, but for those just ``seen``.
        """
        poll, time, out = self._poll, self._time, []
        for own, (last, waiting, _) in [*keys.items()]:
            gone = own not in seen and last and self._gone(last) <= now
            # Rows of one order keep the order of their arrival.
            waiting.sort(key=itemgetter(poll, self._ord))
            start, due = 0, 0
            while start < len(waiting):
                seq, end = waiting[start][poll], start + 1
                while end < len(waiting) and waiting[end][poll] == seq:
                    end += 1
                rows = waiting[start:end]
                due = max(row[time] for row in rows) * 1000
                if due > now:
                    break
                if last and (not self._adjacent or seq == last[0][poll] + 1):
                    out.extend(self._delta(rows[0], before) for before in last)
                last, start = rows, end
            if gone and start == len(waiting):
                del keys[own]
            else:
                keys[own] = (last, waiting[start:], due)
        return out

    def _delta(self, row: tuple, before: tuple) -> tuple:
        changed = list(row)
        for c in self._counters:
            changed[c] = None if row[c] is None or before[c] is None else row[c] - before[c]
        changed[self._ord] = before[self._ord]
        return tuple(changed)

    def _out(self, key, records: list[tuple], behind: bool) -> Iterator[Row]:
        form = Row(*self._state_by, *self._names, "behind")
        for record in records:
            yield form(*key, *record, behind)

    def close(self) -> None:
        pass


def stream_counter_delta(
    polls: DataFrame,
    keys: Sequence[str],
    counters: Sequence[str],
    delay: str,
    adjacent: bool = True,
    event_time: str = "measured_at",
    forget: int = FORGET_SECONDS,
) -> DataFrame:
    """Counter deltas over an unbounded poll stream whose files arrive in any order.

    ``polls`` carries the keys, ``poll_seq``, ``ord`` and ``event_time`` in seconds; all other columns
    come from the later poll.  With ``adjacent`` a row pairs only with the very next poll of its
    server, otherwise with the last one seen.  A poll is paired when the watermark, ``delay`` behind
    the latest time seen, has passed it; the last polls wait until later ones (of any key) arrive.
    Rows of a poll that is paired already come out as they are, with ``behind`` set.  A key not seen
    for ``forget`` seconds loses its state, and so its next delta.

    Keys that agree in their server columns are worked on together: a message to the state store costs
    more than many rows in it.  A task then holds what waits of one server, not of one key.  Python reads
    a row as one JSON text where its types allow, as reading a value costs more than parsing it.
    """
    keys, counters = list(keys), list(counters)
    timed = _watched(polls, event_time, delay)
    types = {f.name: f.dataType for f in timed.schema.fields}
    state_by = [k for k in keys if k in SERVER]
    # Values by which Python tells keys apart as Spark does.
    if not state_by or not all(isinstance(types[k], (T.StringType, T.IntegralType)) for k in keys):
        state_by = keys
    own = [k for k in keys if k not in state_by]
    fields = [f for f in timed.schema.fields if f.name not in state_by]
    exact = (T.StringType, T.IntegralType, T.DoubleType, T.BooleanType)
    packed = [f for f in fields if isinstance(f.dataType, exact)]
    loose = [f for f in fields if f not in packed]
    schema = T.StructType([*[polls.schema[k] for k in state_by], *packed, *loose, T.StructField("behind", T.BooleanType())])
    text = F.to_json(F.struct(*[f.name for f in packed]), {"ignoreNullFields": "false"})
    paired = timed.select(*state_by, text.alias(_ROW), *[f.name for f in loose]).groupBy(*state_by).transformWithState(
        _CounterDelta(
            [f.name for f in packed], [f.name for f in packed if isinstance(f.dataType, T.DoubleType)], [f.name for f in loose],
            state_by, own, counters, adjacent, event_time, forget,
        ),
        outputStructType=schema,
        outputMode="Append",
        timeMode="EventTime",
    )
    return paired.select(*keys, *[f.name for f in fields if f.name not in own], "behind")


class _Throttle(StatefulProcessor):
    """Holds the best event of each second until the watermark passes it, and the last emission."""

    def __init__(self, fields: list[T.StructField], order: str, gap: int):
        self._fields = fields
        self._names = [f.name for f in fields]
        self._order = self._names.index(order)
        self._time = self._names.index("measured_at")
        self._gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getListState("seconds", T.StructType(self._fields))
        self._last = handle.getValueState("last", _AT)
        self._passed = handle.getValueState("passed", _AT)

    def _waiting(self) -> dict[int, tuple]:
        return {record[self._time]: record for record in self._pending.get()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = self._passed.get()[0] if self._passed.exists() else None
        # One row per second stays, so a hot key is bounded by elapsed time.
        best, fresh = self._waiting(), False
        for record in _records(rows, self._names):
            at = record[self._time]
            if passed is not None and at <= passed:
                yield from self._out([record], True)
            elif at not in best or record[self._order] < best[at][self._order]:
                best[at], fresh = record, True
        yield from self._release(best, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        best = self._waiting()
        yield from self._release(best, False, now)
        if not best and self._last.exists() and (self._last.get()[0] + self._gap) * 1000 <= now:
            self._last.clear()
            self._passed.clear()

    def _release(self, best: dict[int, tuple], fresh: bool, now: int) -> Iterator[Row]:
        """Emits what is due and takes it out of ``best``."""
        seconds = sorted(best)
        ready = [at for at in seconds if at * 1000 <= now]
        if len(ready) < len(seconds):
            # One timer per key: the next one is set when it fires.
            self._handle.registerTimer(seconds[len(ready)] * 1000)
        chosen = []
        if ready:
            last = self._last.get()[0] if self._last.exists() else None
            for at in ready:
                record = best.pop(at)
                if last is None or at >= last + self._gap:
                    last = at
                    chosen.append(record)
            self._passed.update((ready[-1],))
            self._last.update((last,))
            self._handle.registerTimer((last + self._gap) * 1000)
        if ready or fresh:
            _replace(self._pending, list(best.values()))
        yield from self._out(chosen, False)

    def _out(self, records: list[tuple], behind: bool) -> Iterator[Row]:
        form = Row(*self._names, "behind")
        for record in records:
            yield form(*record, behind)

    def close(self) -> None:
        pass


def stream_explain_throttle(
    events: DataFrame,
    delay: str,
    keys: Sequence[str] = PLAN_KEYS,
    order: str = "event_id",
    gap: int = EXPLAIN_SECONDS,
    max_bytes: int = EXPLAIN_BYTES,
) -> DataFrame:
    """At most one plan per key and ``gap`` seconds of event time; keys name the server too.

    Events older than what their key has decided come out with ``behind`` set and count for nothing.
    A key's state goes ``gap`` seconds after its last plan.
    """
    short = _watched(events.filter(F.octet_length("raw") <= max_bytes), "measured_at", delay)
    schema = T.StructType([*short.schema.fields, T.StructField("behind", T.BooleanType())])
    return short.groupBy(*keys).transformWithState(
        _Throttle(short.schema.fields, order, gap), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    ).withColumn("plan", obfuscate_explain(F.col("plan")))


class _PlanAttachment(StatefulProcessor):
    """Slow queries and plans of one statement: throttles the plans and gives each to its query."""

    def __init__(self, fields: list[T.StructField], event_id: list[str], within: int, gap: int):
        self._fields = fields
        self._names = [f.name for f in fields]
        self._event_id = event_id
        self._within = within
        self._gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._events = handle.getListState("events", T.StructType(self._fields))
        # Of the plans of a second only the first can be taken.
        self._plans = handle.getListState("plans", T.StructType([*_AT.fields, T.StructField("id", T.LongType()), T.StructField("plan", T.StringType())]))
        self._last = handle.getValueState("last", _AT)
        self._passed = handle.getValueState("passed", _AT)

    def _waiting(self) -> tuple[list[dict], dict[int, tuple]]:
        return [dict(zip(self._names, r)) for r in self._events.get()], {r[0]: r for r in self._plans.get()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = self._passed.get()[0] if self._passed.exists() else None
        events, plans = self._waiting()
        new_events = new_plans = False
        behind = []
        for record in _records(rows, self._names):
            row = dict(zip(self._names, record))
            at, plan = row["measured_at"], row["plan_id"] is not None
            if passed is not None and (at if plan else at + self._within) <= passed:
                if not plan:
                    behind.append(row)
            elif not plan:
                events.append(row)
                new_events = True
            elif at not in plans or row["plan_id"] < plans[at][1]:
                plans[at] = (at, row["plan_id"], row["explain"])
                new_plans = True
        yield from self._out(behind, True)
        yield from self._release(events, plans, new_events, new_plans, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        left = yield from self._release(*self._waiting(), False, False, now)
        if not left and self._last.exists() and (self._last.get()[0] + self._gap) * 1000 <= now:
            self._last.clear()

    def _release(self, events: list[dict], plans: dict[int, tuple], new_events: bool, new_plans: bool, now: int) -> Iterator[Row]:
        """Queries that no plan can reach any more; returns the number of queries and plans that go on waiting."""
        seconds = sorted(plans)
        ready = [at for at in seconds if at * 1000 <= now]
        last = self._last.get()[0] if ready and self._last.exists() else None
        for at in ready:
            _, _, plan = plans.pop(at)
            if last is not None and at < last + self._gap:
                continue
            last = at
            near = [e for e in events if at - self._within <= e["measured_at"] <= at]
            if near:
                first = min(near, key=lambda e: (-e["measured_at"], *[e[c] for c in self._event_id]))
                first["explain"] = plan
                new_events = True
        if ready:
            self._last.update((last,))
            self._handle.registerTimer((last + self._gap) * 1000)
        out, left = [], []
        for event in events:
            (out if (event["measured_at"] + self._within) * 1000 <= now else left).append(event)
        waiting = seconds[len(ready) :][:1] + [e["measured_at"] + self._within for e in left]
        if waiting:
            # One timer per key: the next one is set when it fires.
            self._handle.registerTimer(min(waiting) * 1000)
        if out or ready:
            self._passed.update((now // 1000,))
        if out or new_events:
            _replace(self._events, [tuple(e.values()) for e in left])
        if ready or new_plans:
            _replace(self._plans, list(plans.values()))
        yield from self._out(out, False)
        return len(left) + len(plans)

    def _out(self, rows: list[dict], behind: bool) -> Iterator[Row]:
        names = [n for n in self._names if n != "plan_id"]
        form = Row(*names, "behind")
        for row in rows:
            yield form(*[row[n] for n in names], behind)

    def close(self) -> None:
        pass


def stream_attach_plans(
    events: DataFrame,
    plans: DataFrame,
    delay: str,
    event_id: Sequence[str] = ("payload_id", "pos"),
    within: int = EXPLAIN_WITHIN,
    gap: int = EXPLAIN_SECONDS,
    max_bytes: int = EXPLAIN_BYTES,
) -> DataFrame:
    """Streaming form of ``logs.attach_plans`` over ``logs.slow_query_events`` and ``logs.plan_events``.

    A slow query waits ``within`` seconds of event time for its plan.  Queries that arrive after the
    watermark has passed that come out without a plan and with ``behind`` set.
    """
    if within >= gap:
        raise ValueError("plans must be further apart than a plan is from its query")
    own = [c for c in events.columns if c not in ("explain", "behind")]
    # Times travel through the state as numbers.
    times = [f.name for f in events.schema.fields if isinstance(f.dataType, T.TimestampType)]
    events = events.withColumns({c: F.unix_micros(c) for c in times})
    both = events.select(*own, F.lit(None).cast("bigint").alias("plan_id"), F.lit(None).cast("string").alias("explain"))
    taken = plans.filter(F.octet_length("raw") <= max_bytes)
    named = {c: F.col(c) for c in (*SERVER, "fingerprint", "measured_at")}
    empty = [named.get(c, F.lit(None).cast(events.schema[c].dataType)).alias(c) for c in own]
    both = both.unionByName(taken.select(*empty, "plan_id", obfuscate_explain(F.col("plan")).alias("explain")))
    timed = _watched(both, "measured_at", delay)
    schema = T.StructType([*[f for f in timed.schema.fields if f.name != "plan_id"], T.StructField("behind", T.BooleanType())])
    attached = timed.groupBy(*SERVER, "fingerprint").transformWithState(
        _PlanAttachment(timed.schema.fields, list(event_id), within, gap), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return attached.withColumns({c: F.timestamp_micros(c) for c in times}) if times else attached
