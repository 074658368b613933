"""Streams of traces with typed state that event-time timers free.

A trace is over when the watermark has passed its last row by `idle`. Until then its
state is a value (a few numbers) and, for checkpoints, lists of candidates and of
prefixes before an answer; the timer emits what is due and clears all of it. Needs the
RocksDB state store: with_rocksdb(spark).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.checkpoints import PRIORITY

from .detector import START, STATE, Should, step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Python forms of the patterns in operators.checkpoints.
ANSWER = re.compile(r"(?<!\w)the answer is(?!\w)", re.I)
BOUNDARY = re.compile(r"[.!?][\"')\]]?(?:\s|\Z)")
SEEN = "answered boolean, bounds long, token long, triggered boolean, bounded boolean"
CANDIDATE = "checkpoint_type string, candidate_key string, token_index long, prefix string, prefix_token_ids array<int>"
PRIOR = "token_index long, length long, prefix string, prefix_token_ids array<int>"


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Timed(StatefulProcessor):
    """Keeps one timer a key, at its greatest time and idle."""

    idle_ms: int
    time: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _remind(self, frame: pd.DataFrame) -> None:
        newest = int(frame[self.time].max().timestamp() * 1000) + self.idle_ms
        old = self.last.get()[0] if self.last.exists() else None
        if old is None or newest > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(newest)
            self.last.update((newest,))

    def close(self) -> None:
        pass


class _Detector(_Timed):
    def __init__(self, should: Should, idle_ms: int, time: str):
        self.should, self.idle_ms, self.time = should, idle_ms, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("trend", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("pos", kind="stable")
        self._remind(frame)
        state, found = tuple(self.state.get()) if self.state.exists() else START, []
        for pos, entropy, content in zip(frame["pos"], frame["entropy"], frame["content"], strict=True):
            if state[6] or pos <= state[5]:
                continue
            state, trend = step(state, float(entropy), bool(content))
            fired = bool(self.should(int(pos), trend))
            state = (*state[:5], int(pos), fired)
            if fired:
                found.append((key[0], int(pos), trend))
        self.state.update(state)
        if found:
            yield pd.DataFrame(found, columns=["seq_id", "pos", "trend"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.last.clear()
        return iter(())


def detect(words: DataFrame, should: Should, idle: str = "10 minutes", lateness: str = "1 minute", time: str = "ts") -> DataFrame:
    """seq_id, pos, trend of the first word of each sequence that should() takes, as detector.detect(), from a stream with event times.

    A word that comes after its sequence was freed begins a new one.
    """
    return _run(words, "seq_id", _Detector(should, _ms(idle), time), "seq_id long, pos long, trend double", lateness, time)


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def _run(df: DataFrame, key: str, processor: StatefulProcessor, out: str, lateness: str, time: str) -> DataFrame:
    return df.withWatermark(time, lateness).groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")


def finalised(rows: list[tuple], most: int, stratified: bool) -> list[tuple]:
    """(type, key, token, prefix, ids) in order: checkpoints.finalise() for one trace's candidates."""
    rows = sorted(rows, key=lambda r: (r[2], PRIORITY.index(r[0]), r[1]))
    seen, kept = set(), []
    for r in rows:
        ids = tuple(r[4])
        if ids not in seen:
            seen.add(ids)
            kept.append(r)
    if stratified and len(kept) > most:
        anchors = [r for r in kept if r[0] in (PRIORITY[0], PRIORITY[-1])]
        others = [r for r in kept if r not in anchors]
        slots = max(0, most - len(anchors))
        if slots == 1:
            chosen = {len(others) // 2}
        else:
            chosen = {round(i * (len(others) - 1) / (slots - 1)) for i in range(slots)} if slots else set()
        picked = anchors[:most] + [r for i, r in enumerate(others) if i in chosen]
        kept = [r for r in kept if r in picked]
    return kept[:most]


class _Observer(_Timed):
    def __init__(self, idle_ms: int, time: str, most: int, stratified: bool, dense: bool, stride: int, most_grid: int):
        self.idle_ms, self.time, self.most, self.stratified, self.dense, self.stride, self.most_grid = idle_ms, time, most, stratified, dense, stride, most_grid

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", SEEN)
        self.candidates = handle.getListState("candidates", CANDIDATE)
        self.prior = handle.getListState("prior", PRIOR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("token_index", kind="stable")
        self._remind(frame)
        answered, bounds, last, triggered, bounded = tuple(self.seen.get()) if self.seen.exists() else (False, 0, -1, False, False)
        found, prior = [], list(self.prior.get()) if self.prior.exists() else []
        before = len(prior)
        for token, prefix, ids, hit in zip(frame["token_index"], frame["prefix"], frame["prefix_token_ids"], frame["triggered"], strict=True):
            token, ids, solid = int(token), [int(i) for i in ids], prefix.strip(" ") != ""
            if token <= last:
                continue
            at, n = ANSWER.search(prefix), len(BOUNDARY.findall(prefix))
            first_answer, answered = bool(at) and not answered, answered or bool(at)
            open_ = not (self.dense and answered)
            put = lambda kind, name, t=token, p=prefix, i=ids: found.append((kind, name, t, p, i))
            if open_ and solid and hit and not triggered:
                put(PRIORITY[0], PRIORITY[0])
                triggered = True
            if self.dense and open_ and solid:
                for k in range(bounds + 1, n + 1):
                    put("sentence_boundary", f"sentence_boundary_{k}")
                for k in range(max(0, min(last // self.stride, self.most_grid)) + 1, min(token // self.stride, self.most_grid) + 1):
                    put("token_grid", f"token_grid_{k * self.stride}")
            if not self.dense and solid and n and not bounded:
                put("first_sentence_boundary", "first_sentence_boundary")
                bounded = True
            if first_answer:
                ended = [p for p in prior if p[1] < at.start() + 1]
                if ended and ended[-1][2].strip(" "):
                    t, _, p, i = ended[-1]
                    put(PRIORITY[-1], PRIORITY[-1], t, p, list(i))
                prior = []
            elif not answered:
                prior.append((token, len(prefix.rstrip(" ")), prefix, ids))
            bounds, last = max(bounds, n), token
        self.seen.update((answered, bounds, last, triggered, bounded))
        if found:
            self.candidates.appendList(found)
        if answered and before:
            self.prior.clear()
        elif not answered and len(prior) > before:
            self.prior.appendList(prior[before:])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = list(self.candidates.get()) if self.candidates.exists() else []
        for state in (self.seen, self.candidates, self.prior, self.last):
            state.clear()
        out = [(key[0], *r[:3], i) for i, r in enumerate(finalised([tuple(r) for r in rows], self.most, self.stratified))]
        if out:
            yield pd.DataFrame(out, columns=["qid", "checkpoint_type", "candidate_key", "token_index", "checkpoint_index"])


def observe(observations: DataFrame, most: int = 3, stratified: bool = False, dense: bool = False, stride: int = 0, most_grid: int = 0, idle: str = "10 minutes", lateness: str = "1 minute", time: str = "ts") -> DataFrame:
    """qid, checkpoint_type, candidate_key, token_index, checkpoint_index of each trace when it is over.

    The stream's (qid, token_index, prefix, prefix_token_ids, triggered, ts) give what
    checkpoints.finalise(checkpoints.collect()) gives for the table of the same rows.
    Rows at or before a token already seen are skipped.
    """
    if dense and stride <= 0:
        raise ValueError("dense checkpoints need a positive stride")
    out = "qid string, checkpoint_type string, candidate_key string, token_index long, checkpoint_index int"
    return _run(observations, "qid", _Observer(_ms(idle), time, most, stratified, dense, stride, most_grid), out, lateness, time)


def state_rows(progress: dict) -> int:
    """The rows of state a query holds, by its progress."""
    return sum(s["numRowsTotal"] for s in progress["stateOperators"])
