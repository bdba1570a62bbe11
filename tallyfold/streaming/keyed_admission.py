"""Admission (A2) as a keyed state machine (``transformWithState``).

State per user, each in its own variable: the flood burst (last request and
count), the free plan's day counter, the day of the agent counters, and a map
agent -> requests used on that day.  An event-time timer ``idle_s`` after the
user's last request drops all of it (longer than the burst gap and the day, so
nothing it holds still matters).

A user's requests of a micro-batch are kept as compact arrays, ordered by
(ts, request_id) and folded in chunks; what a chunk leaves to the next is the
same summary that the state keeps between batches.  Inside a chunk the counters
are running counts of numpy arrays; only runs of equal agent, day and limit are
visited one by one.  A user's part of a batch is bounded by the trigger's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

OUT = "request_id long, tg_user_id long, agent_id string, ts long, plan string, reason string, remaining long"
CHUNK_ROWS = 100_000
DAY = 86400
NO_LIMIT = 1 << 62


def _running(start: np.ndarray) -> np.ndarray:
    """1, 2, 3... from every True of ``start`` (the first is True)."""
    i = np.arange(len(start))
    return i - np.maximum.accumulate(np.where(start, i, 0)) + 1


class Carry:
    """What earlier requests of a user mean for the next ones."""

    def __init__(self, last_ts=None, burst=0, free_day=None, free_count=0, quota_day=None, used=None):
        self.last_ts, self.burst, self.free_day, self.free_count = last_ts, burst, free_day, free_count
        self.quota_day, self.used = quota_day, used or {}


def fold(chunk: pd.DataFrame, limits: dict[str, tuple[int, int | None, int]], gap_s: int, carry: Carry) -> pd.DataFrame:
    """Decisions of one user's ordered requests; ``carry`` moves on."""
    n = len(chunk)
    plan, agent = chunk["plan"].to_numpy(object), chunk["agent_id"].to_numpy(object)
    none, unknown = pd.isna(plan), ~np.isin(plan, list(limits))
    reason = np.where(none, "no_active_plan", np.where(unknown, "unknown_plan", "no_agent")).astype(object)
    remaining = np.zeros(n, np.int64)
    at = np.flatnonzero(~none & ~unknown & ~pd.isna(agent))  # decided requests
    if len(at):
        plan, agent, ts = plan[at], agent[at], chunk["ts"].to_numpy(np.int64)[at]
        flood, per_day, quota = (np.array([limits[p][k] if limits[p][k] is not None else NO_LIMIT for p in plan], np.int64) for k in range(3))
        free, day = plan == "free_trial", ts // DAY
        new = np.append(carry.last_ts is None or ts[0] - carry.last_ts >= gap_s, ts[1:] - ts[:-1] >= gap_s)
        goes_on = not new[0]
        new[0] = True
        burst = _running(new)
        if goes_on:
            burst[: np.flatnonzero(np.append(new[1:], True))[0] + 1] += carry.burst
        reject = burst > flood
        why = np.where(reject, np.where(free, "free_minute", "flood"), "allowed").astype(object)
        left = np.zeros(len(at), np.int64)
        f = np.flatnonzero(free & ~reject)
        if len(f):
            start = np.append(True, day[f][1:] != day[f][:-1])
            count = _running(start)
            if day[f[0]] == carry.free_day:
                count[day[f] == carry.free_day] += carry.free_count
            over = count > per_day[f]
            why[f[over]], reject[f[over]] = "free_daily", True
            carry.free_day, carry.free_count = int(day[f[-1]]), int(count[-1])
        q = np.flatnonzero(~reject)
        if len(q):
            _, code = np.unique(agent[q].astype(str), return_inverse=True)
            q = q[np.lexsort((q, code, day[q]))]
            cut = np.flatnonzero((day[q][1:] != day[q][:-1]) | (agent[q][1:] != agent[q][:-1]) | (quota[q][1:] != quota[q][:-1])) + 1
            for run in np.split(q, cut):  # equal day, agent and limit
                d, name, limit = int(day[run[0]]), agent[run[0]], int(quota[run[0]])
                if carry.quota_day != d:
                    carry.quota_day, carry.used = d, {}
                used = carry.used.get(name, 0)
                k = min(len(run), max(0, limit - used))
                left[run[:k]] = limit - used - 1 - np.arange(k)
                why[run[k:]] = "daily_quota"
                if k:
                    carry.used[name] = used + k
        reason[at], remaining[at] = why, left
        carry.last_ts, carry.burst = int(ts[-1]), int(burst[-1])
    return chunk.assign(reason=reason, remaining=remaining)[[c.split()[0] for c in OUT.split(", ")]]


class Admission(StatefulProcessor):
    def __init__(self, limits: dict[str, tuple[int, int | None, int]], gap_s: int, idle_s: int):
        self.limits, self.gap_s, self.idle_s = limits, gap_s, idle_s

    def init(self, handle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "last_ts long, n long")
        self.free_day = handle.getValueState("free_day", "day long, n long")
        self.quota_day = handle.getValueState("quota_day", "day long")
        self.used = handle.getMapState("used", "agent_id string", "n long")

    def _load(self) -> Carry:
        c = Carry()
        if self.burst.exists():
            c.last_ts, c.burst = self.burst.get()
        if self.free_day.exists():
            c.free_day, c.free_count = self.free_day.get()
        if self.quota_day.exists():
            c.quota_day = self.quota_day.get()[0]
            c.used = {k[0]: v[0] for k, v in self.used.iterator()}
        return c

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = self._load()
        before, quota_day, used = c.last_ts, c.quota_day, dict(c.used)
        cols = ["request_id", "tg_user_id", "agent_id", "ts", "plan"]
        parts = [p[cols].astype({"agent_id": "category", "plan": "category"}) for p in rows]  # 16 bytes a row and two codes
        ts = np.concatenate([p["ts"].to_numpy() for p in parts])
        ids = np.concatenate([p["request_id"].to_numpy() for p in parts])
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        row = np.concatenate([np.arange(len(p)) for p in parts])
        order = np.lexsort((ids, ts))
        for i in range(0, len(order), CHUNK_ROWS):
            o = order[i: i + CHUNK_ROWS]
            picked = [parts[k].iloc[row[o[part[o] == k]]].astype({"agent_id": object, "plan": object}) for k in np.unique(part[o])]
            yield fold(pd.concat(picked).sort_values(["ts", "request_id"], kind="stable"), self.limits, self.gap_s, c)
        if c.last_ts is None:
            return  # a user without a decided request keeps no state
        self.burst.update((c.last_ts, c.burst))
        if c.free_day is not None:
            self.free_day.update((c.free_day, c.free_count))
        if c.quota_day is not None:
            if c.quota_day != quota_day:
                self.quota_day.update((c.quota_day,))
                self.used.clear()
                used = {}
            for agent, n in c.used.items():
                if used.get(agent) != n:
                    self.used.updateValue((agent,), (n,))
        if c.last_ts != before:
            if before is not None:
                self.handle.deleteTimer((before + self.idle_s) * 1000)
            self.handle.registerTimer((c.last_ts + self.idle_s) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.burst, self.free_day, self.quota_day, self.used):
            if state.exists():
                state.clear()
        return iter([])


def stream_admission(requests: DataFrame, limits: dict[str, tuple[int, int | None, int]], gap_s: int,
                     watermark: str = "1 hour", idle_s: int = DAY) -> DataFrame:
    """Decisions of a request stream ``(request_id, tg_user_id, agent_id, ts,
    plan)``; equals A2.  ``limits``: plan -> (flood, per day or None, per agent).
    The state lives in RocksDB, which the query's session must name
    (``state_store``)."""
    state_store(requests.sparkSession)
    r = requests.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", watermark)
    return r.groupBy("tg_user_id").transformWithStateInPandas(Admission(limits, gap_s, idle_s), OUT, "Append", "EventTime")


def state_store(spark) -> None:
    """Keyed processors with several state variables need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
