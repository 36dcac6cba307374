"""How far a stage is, as Spark's own records tell it, and how it is stopped.

The jobs of a stage are one Spark job group. While they run, a second thread reads the numbers of their tasks from the status tracker
and the units done (segments, windows) from an accumulator that tasks add to, and hands them on; when a stop was asked for, it has Spark
cancel the group, again and again until the stage gives up, for a stage is many jobs.
"""

from __future__ import annotations

import sys
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import SparkSession

from ..errors import StoppedError

T = TypeVar("T")
_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


@dataclass(frozen=True)
class Count:
    """Tasks of the stage's jobs so far, and units of work if the stage has told how many there are."""

    stage: str
    tasks_done: int
    tasks: int
    units_done: int = 0
    units: int | None = None

    def __str__(self) -> str:
        units = "" if self.units is None else f", {self.units_done} of {self.units} units"
        return f"{self.stage}: {self.tasks_done} of {self.tasks} tasks{units}"


class Watch:
    """Runs the jobs of stages, tells how far they are, and stops them. `report` gets a Count whenever it changes."""

    def __init__(self, report: Callable[[Count], None] | None = None, every_s: float = 0.2):
        self.report, self.every_s = report, every_s
        self.asked = threading.Event()
        self._units: int | None = None
        self._done = None

    def stop(self) -> None:
        """May be called from any thread and from a signal handler: it only leaves a note, which the watching thread reads."""
        self.asked.set()

    def counter(self, spark: SparkSession, units: int):
        """What tasks add finished units to. A task that is repeated counts again: the number is for show."""
        self._units, self._done = units, spark.sparkContext.accumulator(0)
        return self._done

    def run(self, spark: SparkSession, stage: str, work: Callable[[], T]) -> T:
        """The result of work, whose jobs are started by this thread. StoppedError if they were cancelled on request."""
        if self.asked.is_set():
            raise StoppedError(f"{stage} wasn't begun")
        sc = spark.sparkContext
        group, over = f"folioflow-{stage}-{uuid.uuid4().hex}", threading.Event()
        before = [sc.getLocalProperty(p) for p in _GROUP]
        watcher = threading.Thread(target=self._watch, args=(sc, stage, group, over), daemon=True)
        sc.setJobGroup(group, stage)
        watcher.start()
        try:
            return work()
        except Exception as e:
            if self.asked.is_set():
                raise StoppedError(f"{stage} was stopped") from e
            raise
        finally:
            over.set()
            watcher.join()
            for name, value in zip(_GROUP, before, strict=True):
                sc.setLocalProperty(name, value)
            self._units = self._done = None

    def _watch(self, sc, stage: str, group: str, over: threading.Event) -> None:
        tracker, seen, told = sc.statusTracker(), {}, None
        finished: set[int] = set()
        while True:
            last = over.wait(self.every_s)
            if self.asked.is_set() and not last:
                sc.cancelJobGroup(group)
            if self.report:
                for job in set(tracker.getJobIdsForGroup(group)) - finished:
                    info = tracker.getJobInfo(job)
                    for s in info.stageIds if info else ():
                        if found := tracker.getStageInfo(s):
                            seen[s] = found.numCompletedTasks, found.numTasks
                    if info and info.status != "RUNNING":
                        finished.add(job)
                now = Count(stage, sum(d for d, _ in seen.values()), sum(n for _, n in seen.values()), self._done.value if self._done is not None else 0, self._units)
                if now != told:
                    told = now
                    self.report(now)
            if last:
                return


def printer(out=None) -> Callable[[Count], None]:
    """Counts as lines of text."""
    return lambda count: print(count, file=out or sys.stdout, flush=True)
