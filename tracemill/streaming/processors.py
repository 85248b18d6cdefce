"""Keyed state machines for streams. Each gives the rows its batch counterpart gives on ordered input.

Rows of one key inside one micro-batch are put in order first; micro-batches
are bounded by the source's trigger options. Decisions compare event times.
No row is dropped as late: a row older than what its key has seen is judged at
the newest time of the key, as a service that gets it then would judge it, and
is marked ``late``. The state of a key that stays quiet is freed by the wall
clock, a day after it could last matter on a stream that keeps up; a stream
that stands still for longer forgets as the wall clock does. Only
``stall_stream`` waits for event time and so needs a watermark.
"""

from __future__ import annotations

import hashlib
import json
import math
import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracemill.config import AGENTS, ARTICLES, REFUNDS, Agents, Articles, Refunds
from tracemill.operators.refunds import admit

SLACK_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows that the processors give, by name.
SEEN = Row("article_id", "fingerprint", "seen", "late")
STALL = Row("exec_id", "tool_name", "signal_type")
ONCE = Row("request_id", "result_request", "result_amount", "replayed", "late")
LOOP = Row("session_id", "step", "signals", "consecutive", "strategy")

#: Values (first steps of a session, requests of a group) that lie under one state value.
PART_ROWS = 64

#: Groups that keys of a few rows each are dealt to by hash. Part of the state: a checkpoint belongs to one number.
GROUPS = 16_384


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


def _in_order(rows: Iterator[Row], *columns: str) -> list[tuple]:
    """The given columns of rows, sorted by the first two (time and id), nulls last."""
    def place(row: tuple) -> tuple:
        return row[0] is None, row[0] or 0, row[1] is None, row[1] or 0

    return sorted((tuple(r[c] for c in columns) for r in rows), key=place)


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "ProcessingTime") -> DataFrame:
    # Timers and composite state need the RocksDB state store.
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode
    )


def _stateful_rows(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "ProcessingTime") -> DataFrame:
    """For many keys of a few rows each: rows instead of tables, which cost more to make than to judge."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def _micros(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("at", F.unix_micros(ts))


def _grouped(df: DataFrame, key: str) -> DataFrame:
    """With the group of each key: a call of the processor, and each state call, costs more than many rows."""
    return df.withColumn("group", F.pmod(F.xxhash64(key), F.lit(GROUPS)))


class _Parts:
    """Values by key, about PART_ROWS of them under one state value.

    Keys are dealt by hash to a number of parts that doubles as there are more of them, so a batch reads and writes each
    part once that its keys fall in, and a part stays small however many keys there are.
    """

    def __init__(self, state, parts: int, count: int):
        self.state, self.parts, self.count = state, parts, count
        self.held: dict[int, dict] = {}
        self.changed: set[int] = set()
        self.stored = parts if count else 0

    pack, unpack = staticmethod(pickle.dumps), staticmethod(pickle.loads)

    def _place(self, key) -> int:
        return zlib.crc32(str(key).encode()) % self.parts

    def _part(self, number: int) -> dict:
        if number not in self.held:
            found = self.state.getValue((number,)) if number < self.stored else None
            self.held[number] = self.unpack(found[0]) if found else {}
        return self.held[number]

    def get(self, key):
        return self._part(self._place(key)).get(key)

    def put(self, key, value) -> None:
        number = self._place(key)
        part = self._part(number)
        self.count += key not in part
        part[key] = value
        self.changed.add(number)

    def drop(self, key) -> None:
        number = self._place(key)
        if self._part(number).pop(key, None) is not None:
            self.count -= 1
            self.changed.add(number)

    def write(self) -> tuple[int, int]:
        """Store the changed parts; (parts, count) for the next batch."""
        if self.count > PART_ROWS * self.parts:
            values = {k: v for number in range(self.parts) for k, v in self._part(number).items()}
            # Parts whose time was over had gone by themselves.
            self.count = len(values)
            while self.count > PART_ROWS * self.parts:
                self.parts *= 2
            self.held, self.changed = {n: {} for n in range(self.parts)}, set(range(self.parts))
            for key, value in values.items():
                self.held[self._place(key)][key] = value
        for number in self.changed:
            if self.held[number]:
                self.state.updateValue((number,), (self.pack(self.held[number]),))
            elif number < self.stored:
                self.state.removeKey((number,))
        return self.parts, self.count


class _SeenGate(StatefulProcessor):
    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", self.life // 1_000 + SLACK_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda r: (r["at"], r["article_id"])):
            late = last is not None and row["at"] < last
            at = max(row["at"], last) if last is not None else row["at"]
            yield SEEN(row["article_id"], key[0], last is not None and at - last < self.life, late)
            last = at
        self.last.update((last,))

    def close(self) -> None:
        pass


def seen_gate(articles: DataFrame, cfg: Articles = ARTICLES) -> DataFrame:
    """(article_id, fingerprint, seen, late): whether a fingerprint was written within its lifetime.

    ``articles``: (article_id, fingerprint, published_at). Every write renews
    the lifetime. An empty or null fingerprint always counts as seen, so that
    it goes on to the full check; such rows pass beside the state, however many.
    """
    kind = articles.schema["article_id"].dataType.simpleString()
    empty = F.coalesce(F.col("fingerprint"), F.lit("")) == ""
    kept = _stateful_rows(
        _micros(articles.where(~empty), "published_at").select("fingerprint", "article_id", "at"), "fingerprint", _SeenGate(cfg.fingerprint_ttl_seconds * 1_000_000),
        f"article_id {kind}, fingerprint string, seen boolean, late boolean",
    )
    return kept.unionByName(articles.where(empty).select("article_id", "fingerprint", F.lit(True).alias("seen"), F.lit(False).alias("late")))


class _Velocity(StatefulProcessor):
    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "newest long, admitted string", self.window * 1_000 + SLACK_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["second", "event_id"])
        newest, state = self.live.get() if self.live.exists() else (int(pdf["second"].iloc[0]), "[]")
        seconds = pdf["second"].clip(lower=newest)
        granted, state = admit(json.loads(state), seconds, pd.Series(1, index=pdf.index), self.limit, self.window)
        self.live.update((int(seconds.iloc[-1]), json.dumps(state)))
        yield pd.DataFrame({
            "user_id": key[0], "event_id": pdf["event_id"], "admitted": [g == 1 for g in granted], "late": pdf["second"] < newest,
        })

    def close(self) -> None:
        pass


def velocity_stream(requests: DataFrame, cfg: Refunds = REFUNDS) -> DataFrame:
    """(user_id, event_id, admitted, late) of refund requests (user_id, event_id, ts)."""
    user, event = (requests.schema[c].dataType.simpleString() for c in ("user_id", "event_id"))
    return _stateful(
        requests.withColumn("second", F.unix_timestamp("ts")), "user_id", _Velocity(cfg.max_per_window, cfg.window_seconds),
        f"user_id {user}, event_id {event}, admitted boolean, late boolean",
    )


class _Requests(_Parts):
    """First requests by key, the time of their last write at the end; each is forgotten by itself."""

    def __init__(self, state, parts: int, count: int, since: int):
        super().__init__(state, parts, count)
        self.since = since

    def _part(self, number: int) -> dict:
        if number not in self.held:
            part = super()._part(number)
            live = {k: v for k, v in part.items() if v[-1] > self.since}
            if len(live) < len(part):
                self.held[number] = live
                self.count -= len(part) - len(live)
                self.changed.add(number)
        return self.held[number]


class _Once(StatefulProcessor):
    def __init__(self, life: int):
        self.life, self.keep = life, life // 1_000 + SLACK_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "parts long, count long", self.keep)
        self.first = handle.getMapState("first", "part long", "requests binary", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        firsts = _Requests(self.first, *(self.size.get() or (1, 0)), now - self.keep)
        for at, request, known, amount in _in_order(rows, "at", "request_id", "idempotency_key", "amount"):
            first = firsts.get(known)
            # A request without time comes last, replays nothing, and what it leaves is replayed by none.
            timed = first is not None and first[2] is not None and at is not None
            late = timed and at < first[3]
            newest = max(at, first[3]) if timed else at
            replayed = timed and newest - first[2] < self.life
            first = (*first[:3], newest, now) if replayed else (request, amount, newest, newest, now)
            firsts.put(known, first)
            yield ONCE(request, first[0], first[1], replayed, late)
        self.size.update(firsts.write())

    def close(self) -> None:
        pass


def once_stream(requests: DataFrame, cfg: Refunds = REFUNDS) -> DataFrame:
    """Result per request (request_id long, idempotency_key, amount, requested_at): a known key replays its first result.

    The amount keeps its type, decimals included. Keys are judged in groups: most have one request or two.
    """
    amount = requests.schema["amount"].dataType.simpleString()
    rows = _grouped(_micros(requests, "requested_at"), "idempotency_key").select("group", "idempotency_key", "request_id", "amount", "at")
    return _stateful_rows(
        rows, "group", _Once(cfg.key_memory_seconds * 1_000_000),
        f"request_id long, result_request long, result_amount {amount}, replayed boolean, late boolean",
    )


class _Calls(_Parts):
    """Open calls by exec_id (tool, time, timeout, due), and when the first call of each part is due."""

    def __init__(self, state, parts: int, count: int, due: list[int | None]):
        super().__init__(state, parts, count)
        self.due = due

    def expired(self, mark: int) -> Iterator[tuple[str, tuple]]:
        """Calls that are due, which are forgotten."""
        for number, due in enumerate(self.due):
            if due is not None and due <= mark:
                for key, call in [(k, c) for k, c in self._part(number).items() if c[3] <= mark]:
                    self.drop(key)
                    yield key, call

    def write(self) -> tuple[int, int]:
        size = super().write()
        self.due += [None] * (self.parts - len(self.due))
        for number in self.changed:
            self.due[number] = min((call[3] for call in self.held[number].values()), default=None)
        return size


class _Stall(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.size = handle.getValueState("size", "state string")
        self.open = handle.getMapState("open", "part long", "calls binary")

    def _read(self) -> tuple[_Calls, int | None]:
        parts, count, due, timer = json.loads(self.size.get()[0]) if self.size.exists() else (1, 0, [None], None)
        return _Calls(self.open, parts, count, due), timer

    def _write(self, calls: _Calls, timer: int | None) -> None:
        """Store the calls; one timer a group, for the first that is due."""
        size = calls.write()
        due = min((d for d in calls.due if d is not None), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if calls.count:
            self.size.update((json.dumps([*size, calls.due, due]),))
        elif calls.stored:
            self.size.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        calls, timer = self._read()
        found = [(r["at"], r["event"] == "finish", r["exec_id"], r["tool_name"], r["timeout_seconds"]) for r in rows if r["at"] is not None]
        # At one time a start comes before its finish.
        for at, finish, call, tool, timeout in sorted(found, key=lambda r: r[:2]):
            if finish:
                started = calls.get(call)
                if started is not None:
                    calls.drop(call)
                    # A finish past the timeout comes too late, whether or not the timer has run by then.
                    if at - started[1] > started[2] * 1_000_000:
                        yield STALL(call, started[0], "tool_timeout")
            elif timeout is None:
                calls.drop(call)
            else:
                # Due at the first millisecond at which the age is over the timeout.
                calls.put(call, (tool, at, timeout, int((at + timeout * 1_000_000) // 1_000) + 1))
        self._write(calls, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        calls, _ = self._read()
        for call, (tool, *_) in calls.expired(timerValues.getCurrentWatermarkInMs()):
            yield STALL(call, tool, "tool_timeout")
        # The timer that has run is taken away by Spark.
        self._write(calls, None)

    def close(self) -> None:
        pass


def stall_stream(calls: DataFrame, delay: str = "1 minute") -> DataFrame:
    """One signal per call whose age passed its timeout before it finished; then the call is forgotten.

    ``calls``: (exec_id, tool_name, event start or finish, ts, timeout_seconds), one start per exec_id, a finish in
    the batch of its start or a later one. Signals wait for event time, so rows more than ``delay`` behind are left out.
    A row without time, and a start without timeout, has no signal. Calls are judged in groups.
    """
    rows = _grouped(_micros(calls, "ts"), "exec_id").withWatermark("ts", delay)
    return _stateful_rows(rows, "group", _Stall(), "exec_id string, tool_name string, signal_type string", "EventTime")


class _Firsts(_Parts):
    """First step of each distinct output of a session, by the digest of the output."""

    pack, unpack = staticmethod(json.dumps), staticmethod(json.loads)

    def _place(self, digest: str) -> int:
        return int(digest[:15], 16) % self.parts

    def step(self, digest: str, step: int) -> int | None:
        """The first step of this output; where there is none, ``step`` becomes it."""
        known = self.get(digest)
        if known is None:
            self.put(digest, step)
        return known


class _Loops(StatefulProcessor):
    def __init__(self, cfg: Agents, idle: int):
        self.cfg, self.idle = cfg, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.short = handle.getValueState("short", "state string")
        self.first = handle.getMapState("first", "part long", "steps string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cfg = self.cfg
        before = self.short.get()
        s = json.loads(before[0]) if before else {"step": 0, "tokens": 0, "kept": [], "novel": [], "row": 0, "parts": 1, "count": 0, "timer": None}
        firsts = _Firsts(self.first, s["parts"], s["count"])
        for _, _, args, observation, tokens in _in_order(rows, "at", "event_id", "args_hash", "observation", "tokens_used"):
            s["step"] += 1
            s["tokens"] += math.nan if tokens is None else tokens
            signals = []
            if args in s["kept"]:
                signals.append("exact_duplicate")
            else:
                s["kept"] = [*s["kept"], args][-cfg.fingerprint_window:]
            if s["step"] >= cfg.max_steps or s["tokens"] >= cfg.max_tokens:
                signals.append("budget_exhausted")
            known = firsts.step(hashlib.sha256(observation.encode()).hexdigest(), s["step"])
            s["novel"] = [*s["novel"], 1.0 if known is None else 0.0][-cfg.progress_window:]
            if len(s["novel"]) == cfg.progress_window and sum(s["novel"]) / cfg.progress_window < cfg.progress_threshold:
                signals.append("no_progress")
            if known is not None and s["step"] - known >= cfg.cycle_length:
                signals.append("causal_cycle")
            s["row"] = s["row"] + 1 if signals else 0
            strategy = ""
            if signals:
                spent = "budget_exhausted" in signals
                strategy = "human_checkpoint" if s["row"] >= cfg.checkpoint_after else "force_summarize" if spent else "inject_correction"
            yield LOOP(key[0], s["step"], ",".join(signals), s["row"], strategy)
        # One timer a session, moved on by every batch that has steps of it.
        if s["timer"] is not None:
            self.handle.deleteTimer(s["timer"])
        s["timer"] = timerValues.getCurrentProcessingTimeInMs() + self.idle
        self.handle.registerTimer(s["timer"])
        s["parts"], s["count"] = firsts.write()
        self.short.update((json.dumps(s),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.short, self.first):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def loop_stream(steps: DataFrame, cfg: Agents = AGENTS, idle_seconds: int = 86_400) -> DataFrame:
    """(session_id, step, signals, consecutive, strategy) of agent steps (session_id, event_id, ts, args_hash, observation, tokens_used).

    Steps are numbered as they arrive. The state of a session is a few recent
    values and the first step of each distinct output; it is freed, and the
    session begun anew, when no step came for ``idle_seconds`` of wall clock.
    """
    kind = steps.schema["session_id"].dataType.simpleString()
    rows = _micros(steps, "ts").select("session_id", "event_id", "at", "args_hash", "observation", "tokens_used")
    return _stateful_rows(
        rows, "session_id", _Loops(cfg, idle_seconds * 1_000),
        f"session_id {kind}, step long, signals string, consecutive long, strategy string",
    )
