"""Chains that tell how far they are, how much each operator gave, and that can be cancelled."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..signal import Signal
from . import chain


class Cancelled(Exception):
    """The chain was cancelled before its end."""


class Run:
    """A chain under watch.

    signal is the chain's result; an action on its rows, given to start(), runs in a thread of its own as one group of jobs. Rows and
    wide samples of each operator are counted on their way, in the same job; filters aren't pushed down through such a count.
    """

    def __init__(self, x: Signal, text: str):
        self.spark = x.df.sparkSession
        self.group = f"undula-{uuid.uuid4().hex}"
        self.cancelled, self.result, self.error, self.thread = False, None, None, None
        self.watched: list[tuple[str, Observation]] = []
        x = self._watch(x, "input")
        for name, args in chain.parse_chain(text):
            x = self._watch(chain.apply(x, name, args), name)
        self.signal = x

    def _watch(self, x: Signal, name: str) -> Signal:
        seen = Observation(f"{self.group}-{len(self.watched)}")
        self.watched.append((name, seen))
        counts = [F.count(F.lit(1)).alias("rows"), (F.max("n") + 1).alias("longest"), F.count_if(F.abs(F.col("s").cast("bigint")) >= 2147483647).alias("full_scale")]
        return x.with_df(x.df.observe(seen, *counts))

    def start(self, action: Callable[[Signal], Any]) -> Run:
        """Runs an action, such as a write, on the result; once only."""
        if self.thread:
            raise RuntimeError("the chain has been started")

        def run() -> None:
            self.spark.sparkContext.setJobGroup(self.group, "undula", interruptOnCancel=True)
            try:
                self.result = action(self.signal)
            except Exception as e:  # noqa: BLE001  told by wait()
                self.error = e

        self.thread = InheritableThread(target=run)
        self.thread.start()
        return self

    def tasks(self) -> tuple[int, int]:
        """Tasks done and tasks known of so far."""
        tracker, done, known = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    done, known = done + s.numCompletedTasks, known + s.numTasks
        return done, known

    def cancel(self) -> None:
        """Stops the jobs of this chain, and no others."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def wait(self, seconds: float | None = None) -> Any:
        """What the action gave; Cancelled if it was cancelled before."""
        self.thread.join(seconds)
        if self.thread.is_alive():
            raise TimeoutError("the chain is still running")
        if self.error is not None and self.cancelled:
            raise Cancelled() from self.error
        if self.error is not None:
            raise self.error
        return self.result

    def counts(self) -> list[tuple[str, dict]]:
        """(operator, {rows, longest, full_scale}) of the input and of each operator, once the action is done."""
        self.wait()
        return [(name, seen.get) for name, seen in self.watched]
