"""The early stop of runs, on a stream of attempts that may come out of order: a state machine for each run.

A run's attempts are numbered from 1. The machine takes them in order of their numbers: one that is ahead waits in the state until those before it have come, or, where one never comes, until
`patience` has passed without an attempt of the run and a timeout gives it up. What the machine keeps is three values and the waiting ones, so a run of any length needs no more state than
its disorder. A failed number is given as soon as it is known to be failed, once; given all attempts, these are the rows of `report.breaker`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "run string, idx long"
STATE = "due long, streak int, stopped boolean, waiting string"


class Machine:
    """Rules of one run. `due` is the next number, `streak` the errors in a row, `stopped` whether the run has ended."""

    def __init__(self, due: int, streak: int, stopped: bool, most: int, refresh: bool) -> None:
        self.due, self.streak, self.stopped, self.most, self.refresh = due, streak, stopped, most, refresh

    def take(self, st: str) -> bool:
        """Whether the attempt that is due has failed."""
        self.due += 1
        if self.stopped:
            return self.refresh or st != "cache"
        if st == "ok":
            self.streak = 0
        elif st == "error":
            self.streak += 1
        self.stopped = st == "blocked" or (st == "error" and self.streak >= self.most)
        return st in ("error", "blocked")


def _step(most: int, refresh: bool, patience_ms: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, streak, stopped, held = state.get if state.exists else (1, 0, False, "{}")
        machine, waiting = Machine(due, streak, stopped, most, refresh), {int(i): st for i, st in json.loads(held).items()}
        if state.hasTimedOut and waiting:
            machine.due = min(waiting)  # what lies before is given up
        for frame in frames:
            for idx, st in zip(frame["idx"].tolist(), frame["st"].tolist(), strict=True):
                if idx >= machine.due:  # what is decided came again
                    waiting.setdefault(idx, st)
        failed = []
        while (idx := machine.due) in waiting:
            if machine.take(waiting.pop(idx)):
                failed.append((key[0], idx))
        state.update((machine.due, machine.streak, machine.stopped, json.dumps(waiting)))
        if waiting:
            state.setTimeoutDuration(patience_ms)
        if failed:
            yield pd.DataFrame(failed, columns=["run", "idx"])

    return step


def failed_stream(attempts: DataFrame, most: int = 5, refresh: bool = False, patience_ms: int = 3_600_000) -> DataFrame:
    """(run, idx) of failed attempts of a stream (run string, idx long, st in ok, error, blocked, cache); output mode append. Timeouts by processing time ask for a batch after
    the last, so a query with the trigger `availableNow` does not end by itself; `once` or an interval does."""
    return attempts.groupBy("run").applyInPandasWithState(_step(most, refresh, patience_ms), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
