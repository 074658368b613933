"""Online detection on token streams: state per sequence, one result each, as a batch or a stream.

The state of a sequence is bounded: the last content word's entropy, the last non-zero
first difference, the previous second difference, and their running count and sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Should = Callable[[int, float], bool]
STATE = "last_h double, last_s1 double, last_s2 double, n long, total double, seen long, fired boolean"
START = (None, None, 0.0, 0, 0.0, -1, False)


def step(state: tuple, entropy: float, content: bool) -> tuple[tuple, float]:
    """(new state, trend) after one word: the trend is 0 unless the word has a second difference."""
    h, s1, s2, n, total, seen, fired = state
    trend = 0.0
    if content:
        first = entropy - h if h is not None else 0.0
        second = first - s1 if first != 0 and s1 is not None else 0.0
        if second != 0:
            n, total = n + 1, total + second
            mean = total / n
            gap = abs(second - mean) + abs(s2 - mean)
            weight = abs(s2 - mean) / gap if gap else 0.0
            alpha = 0.9 + 0.1 * weight
            trend, s2 = alpha * second + (1 - alpha) * s2, second
        h, s1 = entropy, first if first != 0 else s1
    return (h, s1, s2, n, total, seen, fired), trend


class _NoState:
    """The state of a table's group, which comes whole."""

    exists = False

    def update(self, _: tuple) -> None:
        pass


def keyed(df: DataFrame, key: str, run: Callable, out: str, state: str) -> DataFrame:
    """run(key, frames, state) for each key: with state over batches for a stream, in one go for a table."""
    if df.isStreaming:
        return df.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)
    names = [c.split()[0] for c in out.split(", ")]

    def whole(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return next(iter(run(k, iter([frame]), _NoState())), pd.DataFrame(columns=names))

    return df.groupBy(key).applyInPandas(whole, out)


def detector(should: Should):
    """A function for keyed(): the first word of each sequence for which should(pos, trend) holds.

    A batch's words are taken in the order of pos; words at or before one already seen
    are skipped, so a batch that is read again changes nothing.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else START
        words = pd.concat(list(frames)).sort_values("pos", kind="stable")
        found = []
        for pos, entropy, content in zip(words["pos"], words["entropy"], words["content"], strict=True):
            if state[6] or pos <= state[5]:
                continue
            state, trend = step(state, float(entropy), bool(content))
            fired = bool(should(int(pos), trend))
            state = (*state[:5], int(pos), fired)
            if fired:
                found.append((key[0], int(pos), trend))
        held.update(state)
        if found:
            yield pd.DataFrame(found, columns=["seq_id", "pos", "trend"])

    return run


def detect(words: DataFrame, should: Should) -> DataFrame:
    """seq_id, pos, trend of the first word of each sequence that should() takes; words: seq_id, pos, entropy, content, a stream or a table.

    A stream's state stays for good, so words may come at any time; where they have
    event times, timers.detect() frees it when a sequence is over.
    """
    return keyed(words, "seq_id", detector(should), "seq_id long, pos long, trend double", STATE)


def observer(collect_one: Callable[[tuple | None, pd.DataFrame], tuple[tuple, list[tuple]]], state: str, out: str):
    """A stateful operator of one's own: collect_one(state or None, sorted rows) gives the new state and the rows to emit."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("token_index", kind="stable")
        new, emitted = collect_one(tuple(held.get) if held.exists else None, rows)
        held.update(new)
        if emitted:
            yield pd.DataFrame([(key[0], *e) for e in emitted], columns=names)

    return lambda df, key: keyed(df, key, run, out, state)


def checkpoint_observer(df: DataFrame, key: str = "qid") -> DataFrame:
    """qid, checkpoint_type, token_index of a stream of observations (qid, token_index, prefix, triggered), as soon as each is certain.

    The first trigger, the first sentence boundary, and the last prefix before the first
    answer marker: the rules of operators.checkpoints.collect, kept as a few numbers a trace.
    """
    import re

    answer, boundary = re.compile(r"\bthe answer is\b", re.I), re.compile(r"[.!?][\"')\]]?(?:\s|\Z)")

    def one(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        trigger, bound, done, last, size = state or (False, False, False, -1, 0)
        out = []
        for t, prefix, hit in zip(rows["token_index"], rows["prefix"], rows["triggered"], strict=True):
            if t <= last or not prefix.strip():
                continue
            if hit and not trigger:
                out.append(("first_etc_trigger", int(t)))
                trigger = True
            if not bound and boundary.search(prefix):
                out.append(("first_sentence_boundary", int(t)))
                bound = True
            found = answer.search(prefix)
            if found and not done:
                if last >= 0 and size <= found.start():
                    out.append(("before_first_answer_marker", int(last)))
                done = True
            last, size = int(t), len(prefix.rstrip())
        return (trigger, bound, done, last, size), out

    return observer(one, "trigger boolean, bound boolean, done boolean, last long, size long", f"{key} string, checkpoint_type string, token_index long")(df, key)
