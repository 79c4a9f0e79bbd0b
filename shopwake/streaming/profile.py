"""Order-dependent three-way join as one stateful operator.

Comments, logs and user rows of a user arrive on one tagged stream. State per
user: the current comment, a ring of the last logs by number, the devices seen, the
user row, and the last report. Until the user row comes, what arrives is held, once each, in
blocks, and goes through the join when it is there. A task holds the ring, a block per Arrow batch
of the user's rows, and a frame of results, however much a trigger brings.

:class:`ProfileJoin` keeps a state per user, which timers and lifetimes need. :class:`SharedProfileJoin` does the same for many
users under one key and tells a row per arrival; Spark lists its pairs.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.joins import IMPORTANT_TYPES, LOG_BUFFER, SILENCE_MS

COMMENT, LOG, USER = 0, 1, 2
DAY_MS = 24 * 3600 * 1000
PAIR = "at_ts bigint, at_tag int, at_id string, device_count bigint, comment string, log string, log_type string, log_no bigint"
OUTPUT = f"user_id string, {PAIR}, user_info string, reason string"
BLOCK = 256  # arrivals in one entry of state
FRAME = 1000  # results handed on at once
BUCKETS = 2048  # keys that users share
ARRIVAL = "user_id string, at_ts bigint, at_tag int, at_id string, device_count bigint, comment string, logs string, user_info string"
ARRIVAL_COLUMNS = [c.split()[0] for c in ARRIVAL.split(", ")]
TOLD_LOGS = "array<struct<log:string,log_type:string,log_no:bigint>>"  # of ``logs``, as JSON
PAIR_COLUMNS = ["at_ts", "at_tag", "at_id", "device_count", "comment", "log", "log_type", "log_no"]


def tagged(comments: DataFrame, logs: DataFrame, users: DataFrame, left_out: tuple[str, ...] = ()) -> DataFrame:
    """The three inputs as one stream; rows travel as JSON payloads, without the columns ``left_out``."""

    def one(rows: DataFrame, tag: int, row_id: str) -> DataFrame:
        payload = F.to_json(F.struct(*[c for c in rows.columns if c not in ("user_id", *left_out)]))

        def optional(name: str):
            return (F.col(name) if name in rows.columns else F.lit(None)).cast("string")

        return rows.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(
            "user_id",
            F.col("ts").cast("bigint").alias("at_ts"),
            F.lit(tag).alias("at_tag"),
            F.col(row_id).cast("string").alias("at_id"),
            optional("log_type").alias("log_type"),
            optional("brand").alias("brand"),
            optional("plat").alias("plat"),
            payload.alias("payload"),
        )

    return (
        one(comments, COMMENT, "comment_id")
        .unionByName(one(logs, LOG, "log_id"))
        .unionByName(one(users, USER, "user_id"))
    )


def _order(event):
    return event[0], event[1], event[2] or ""


@dataclass
class _Known:
    """What is known of the user while a trigger's rows go through."""

    comment: str | None
    user: str | None
    report: tuple | None
    logs: int
    blocks: int  # of held arrivals in state
    ring: deque
    devices: set
    held: list = field(default_factory=list)  # arrivals of a block not yet in state
    newest: tuple | None = None
    key: tuple = ()  # of the user's blocks, before their number


class ProfileJoin(StatefulProcessor):
    """Pairs comments with logs, waits for the user row, drops repetitions.

    A pair is told with the user row known at its time, or with the first one that
    comes. Rows of one trigger count in the order (time, comment before log before user
    row, id); triggers in the order in which they come.
    """

    def __init__(self, buffer: int = LOG_BUFFER, suppress: bool = True, ttl_ms: int | None = None, daily: bool = False, period_ms: int = DAY_MS, block: int = BLOCK, frame: int = FRAME):
        self.buffer, self.suppress, self.ttl_ms, self.daily = buffer, suppress, ttl_ms, daily
        self.block, self.frame = block, frame
        self.period_ms = period_ms  # between two repetitions, a UTC day but in tests

    def init(self, handle) -> None:
        ttl = {} if self.ttl_ms is None else {"ttlDurationMs": self.ttl_ms}
        self.handle = handle
        self.comment = handle.getValueState("comment", "payload string", **ttl)
        self.user = handle.getValueState("user", "payload string", **ttl)
        self.counter = handle.getValueState("counter", "logs bigint, blocks bigint", **ttl)
        self.ring = handle.getMapState("ring", "slot bigint", "log string, log_type string, log_no bigint", **ttl)
        self.devices = handle.getMapState("devices", "device string", "seen int", **ttl)
        self.held = handle.getMapState("held", "block bigint", "events string", **ttl)
        # Sorted batches of a trigger that brings several for one user; empty between triggers.
        self.batches = handle.getMapState("batches", "batch bigint, block bigint", "events string", **ttl)
        self.newest = handle.getValueState("newest", PAIR, **ttl)
        self.report = handle.getValueState(
            "report", "ts bigint, device_count bigint, log_type string", **ttl
        )

    @staticmethod
    def _value(state):
        return state.get() if state.exists() else None

    def _first(self, state):
        value = self._value(state)
        return value[0] if value else None

    @staticmethod
    def _rows(frame) -> list[list]:
        columns = [frame[c] for c in ("at_ts", "at_tag", "at_id", "log_type", "brand", "plat", "payload")]
        return sorted(([int(ts), int(tag), *rest] for ts, tag, *rest in zip(*columns)), key=_order)

    order = staticmethod(_order)

    def _in_order(self, frames) -> Iterable[list]:
        """The rows of all frames in order; beyond one frame they are merged from state."""
        own, blocks = [], []
        for frame in frames:
            if blocks or own:
                self._put_batch(own, blocks)
            own = self._rows(frame)
        if not blocks:
            return own
        self._put_batch(own, blocks)
        return heapq.merge(*[self._batch(n, size) for n, size in enumerate(blocks)], key=self.order)

    def _put_batch(self, events: list, blocks: list[int]) -> None:
        starts = range(0, len(events), self.block)
        for n, at in enumerate(starts):
            self.batches.updateValue((len(blocks), n), (json.dumps(events[at : at + self.block]),))
        blocks.append(len(starts))

    def _batch(self, batch: int, blocks: int) -> Iterator[list]:
        for n in range(blocks):
            events = json.loads(self.batches.getValue((batch, n))[0])
            self.batches.removeKey((batch, n))
            yield from events

    def _hold(self, known: _Known) -> None:
        if known.held:
            self.held.updateValue((*known.key, known.blocks), (json.dumps(known.held),))
            known.blocks, known.held = known.blocks + 1, []

    def _released(self, known: _Known) -> Iterator[list]:
        for n in range(known.blocks):
            events = json.loads(self.held.getValue((*known.key, n))[0])
            self.held.removeKey((*known.key, n))
            yield from events
        last, known.held, known.blocks = known.held, [], 0
        yield from last

    def _arrivals(self, events: Iterable[list], known: _Known) -> Iterator[tuple]:
        """Comments and logs that meet something: what they are, the devices and the comment of then, and the logs met."""
        for event in events:
            ts, tag, own_id, kind, brand, plat, payload = event
            if tag == USER:
                first, known.user = known.user is None, payload
                if first:
                    yield from self._arrivals(self._released(known), known)
                continue
            if known.user is None:
                known.held.append(event)
                if len(known.held) == self.block:
                    self._hold(known)
                continue
            if tag == COMMENT:
                known.comment, met = payload, list(known.ring)
            else:
                known.logs += 1
                if brand is not None and plat is not None:
                    known.devices.add(f"{brand}\n{plat}".lower())
                known.ring.append((payload, kind, known.logs))
                met = [known.ring[-1]] if known.comment is not None else []
            if met:
                yield ts, tag, own_id, len(known.devices), known.comment, met

    def _pairs(self, events: Iterable[list], known: _Known) -> Iterator[tuple]:
        for *arrival, met in self._arrivals(events, known):
            for log, log_kind, number in met:
                known.newest = (*arrival, log, log_kind, number)
                yield known.newest

    def _told(self, ts: int, devices: int, met: list[tuple], known: _Known) -> list[tuple]:
        """The logs met that make a pair to tell, in order."""
        if not self.suppress:
            return met
        told, last = [], known.report
        for log in met:
            kind = (log[1] or "").lower()
            if last is None or kind in IMPORTANT_TYPES or kind != last[2] or devices != last[1] or ts - last[0] > SILENCE_MS:
                told.append(log)
                last = known.report = (ts, devices, kind)
        return told

    def _is_new(self, pair: tuple, known: _Known) -> bool:
        return bool(self._told(pair[0], pair[3], [pair[5:]], known))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        logs, blocks = self._value(self.counter) or (0, 0)
        stored = sorted((v for _, v in self.ring.iterator()), key=lambda v: v[2]) if logs else []
        known = _Known(
            comment=self._first(self.comment), user=self._first(self.user), report=self._value(self.report), logs=logs, blocks=blocks,
            ring=deque((tuple(v) for v in stored), maxlen=self.buffer), devices={k[0] for k in self.devices.keys()} if logs else set(),
        )
        seen, comment, user, report = set(known.devices), known.comment, known.user, known.report
        if self.daily:
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer((now // self.period_ms + 1) * self.period_ms)

        told = []
        for pair in self._pairs(self._in_order(rows), known):
            if self._is_new(pair, known):
                told.append((key[0], *pair, known.user, "pair"))
                if len(told) == self.frame:
                    yield pd.DataFrame(told, columns=["user_id", *PAIR_COLUMNS, "user_info", "reason"])
                    told = []
        if told:
            yield pd.DataFrame(told, columns=["user_id", *PAIR_COLUMNS, "user_info", "reason"])

        self._hold(known)
        if (known.logs, known.blocks) != (logs, blocks):
            self.counter.update((known.logs, known.blocks))
        for entry in known.ring:
            if entry[2] > logs:
                self.ring.updateValue((entry[2] % self.buffer,), entry)
        for device in known.devices - seen:
            self.devices.updateValue((device,), (1,))
        if known.comment != comment:
            self.comment.update((known.comment,))
        if known.user != user:
            self.user.update((known.user,))
        if known.report != report:
            self.report.update(known.report)
        if known.newest is not None:
            self.newest.update(known.newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Daily repetition of the newest pair of a user."""
        pair, user = self._value(self.newest), self._value(self.user)
        if pair is not None and user is not None:
            out = pd.DataFrame([pair], columns=PAIR_COLUMNS)
            out.insert(0, "user_id", key[0])
            yield out.assign(user_info=user[0], reason="daily")
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.period_ms)

    def close(self) -> None:
        pass


def _shared_order(event):
    return event[0], event[1], event[2], event[3] or ""


class SharedProfileJoin(ProfileJoin):
    """:class:`ProfileJoin` for the users of a bucket: what is known of them is read and written once
    per trigger, but for held blocks. Tells an arrival with its told logs as JSON."""

    order = staticmethod(_shared_order)

    def init(self, handle) -> None:
        # Most users have a user row and nothing else.
        self.idle = handle.getValueState("idle", "users string")
        self.known = handle.getValueState("known", "users string")
        self.held = handle.getMapState("held", "user string, block bigint", "events string")
        self.batches = handle.getMapState("batches", "batch bigint, block bigint", "events string")

    @staticmethod
    def _rows(frame) -> list[tuple]:
        columns = ["user_id", "at_ts", "at_tag", "at_id", "log_type", "brand", "plat", "payload"]
        return sorted(zip(*(frame[c].tolist() for c in columns)), key=_shared_order)

    def _read(self, state) -> dict:
        text = self._first(state)
        return json.loads(text) if text else {}

    def _load(self, user: str, facts: list | None, info: str | None) -> _Known:
        comment, info, report, logs, blocks, devices, ring = facts or (None, info, None, 0, 0, [], [])
        return _Known(
            comment=comment, user=info, report=report and tuple(report), logs=logs, blocks=blocks,
            ring=deque(map(tuple, ring), maxlen=self.buffer), devices=set(devices), key=(user,),
        )

    @staticmethod
    def _facts(known: _Known) -> list:
        return [known.comment, known.user, known.report, known.logs, known.blocks, sorted(known.devices), list(known.ring)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        idle, facts, told = self._read(self.idle), self._read(self.known), []
        waiting = active = False
        for user, events in groupby(self._in_order(rows), key=lambda e: e[0]):
            info = idle.pop(user, None)
            known, texts = self._load(user, facts.get(user), info), {}
            for ts, tag, own_id, devices, comment, met in self._arrivals((e[1:] for e in events), known):
                logs = self._told(ts, devices, met, known)
                if not logs:
                    continue
                for log in logs:
                    if log[2] not in texts:
                        texts[log[2]] = json.dumps({"log": log[0], "log_type": log[1], "log_no": log[2]}, ensure_ascii=False)
                told.append((user, ts, tag, own_id, devices, comment, "[" + ",".join(texts[log[2]] for log in logs) + "]", known.user))
                if len(texts) > 2 * self.buffer:
                    texts = {n: text for n, text in texts.items() if n > known.logs - self.buffer}
                if len(told) == self.frame:
                    yield pd.DataFrame(told, columns=ARRIVAL_COLUMNS)
                    told = []
            self._hold(known)
            if known.comment is None and not known.logs and not known.blocks:
                idle[user], waiting = known.user, True
            else:
                facts[user], active = self._facts(known), True
                waiting = waiting or info is not None
        if told:
            yield pd.DataFrame(told, columns=ARRIVAL_COLUMNS)
        for changed, state, users in ((waiting, self.idle, idle), (active, self.known, facts)):
            if changed:
                state.update((json.dumps(users, ensure_ascii=False),))


def arrivals(rows: DataFrame, buckets: int = BUCKETS, **options) -> DataFrame:
    """The comments and logs of a :func:`tagged` stream that tell pairs, a row each; ``logs`` are theirs as JSON.

    Users share ``buckets`` keys: a key or an entry of state costs Python more than the few rows that
    most users have in a trigger. A trigger rewrites the buckets it touches, so take more of them for many users.
    """
    return (
        rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=SharedProfileJoin(**options), outputStructType=ARRIVAL, outputMode="Append", timeMode="None"
        )
    )


def listed_pairs(arrived: DataFrame) -> DataFrame:
    """A row per told log of :func:`arrivals`, other columns as they are."""
    kept = [c for c in arrived.columns if c != "logs"]
    each = arrived.select(*kept, F.explode(F.from_json("logs", TOLD_LOGS)).alias("_log"))
    return each.select(*kept, "_log.log", "_log.log_type", "_log.log_no")


def joined(rows: DataFrame, daily: bool = False, ttl_ms: int | None = None, **options) -> DataFrame:
    """Joined rows of a :func:`tagged` stream as they become known.

    ``daily`` adds the timer output; a query with timers never drains, so run
    it with an interval trigger, not with ``availableNow``.
    """
    if not daily and ttl_ms is None:
        pairs = listed_pairs(arrivals(rows, **options)).withColumn("reason", F.lit("pair"))
        return pairs.select(*[c.split()[0] for c in OUTPUT.split(", ")])
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=ProfileJoin(daily=daily, ttl_ms=ttl_ms, **options),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime" if daily else "None",
    )


def profile_stream(
    comments: DataFrame, logs: DataFrame, users: DataFrame, daily: bool = False, **options
) -> DataFrame:
    return joined(tagged(comments, logs, users), daily, **options)
