"""Progress of a command: per cent of the tasks of all its jobs, each line once."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext


class Progress:
    """Polls the status tracker for one job group.  Work is not known beforehand, so per cents are held to what was shown; the last is shown at the end."""

    def __init__(self, context: SparkContext, group: str, show: Callable[[str], None], every: float):
        self.tracker, self.group, self.show, self.every = context.statusTracker(), group, show, every
        self.shown, self.seen, self._stop = -1, {}, threading.Event()

    def _per_cent(self) -> int:
        for job in self.tracker.getJobIdsForGroup(self.group):
            info = self.tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = self.tracker.getStageInfo(stage)
                if s is not None:
                    self.seen[stage] = (s.numCompletedTasks, s.numTasks)
        done, total = (sum(x) for x in zip(*self.seen.values())) if self.seen else (0, 0)
        return min(99, 100 * done // total) if total else 0

    def tell(self, value: int) -> None:
        if value > self.shown:
            self.shown = value
            self.show(f"{self.group}: {value}%")

    def run(self) -> None:
        while not self._stop.wait(self.every):
            self.tell(self._per_cent())

    def stop(self) -> None:
        self._stop.set()


@contextmanager
def progress(context: SparkContext, group: str, show: Callable[[str], None] = print, every: float = 1.0) -> Iterator[Progress]:
    """Shows 0 to 100 per cent of the jobs that this thread starts meanwhile."""
    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, group)
    told = Progress(context, group, show, every)
    told.tell(0)
    thread = threading.Thread(target=told.run, daemon=True)
    thread.start()
    try:
        yield told
        told.stop()
        thread.join()
        told.tell(100)
    finally:
        told.stop()
        context.setLocalProperty("spark.jobGroup.id", before)
