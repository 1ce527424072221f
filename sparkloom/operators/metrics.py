"""What an action did, stage by stage."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark import SparkContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StageMetrics:
    """One stage. ``measured`` knows the counts of tasks; the rest comes from the event log and is None without it. Sizes are
    bytes; ``peak_memory`` is the greatest of any task; ``attempts`` above one: lost output was made again."""

    stage: int
    name: str
    tasks: int
    completed: int
    failed: int
    retries: int | None = None
    attempts: int | None = None
    seconds: float | None = None
    task_seconds: float | None = None
    cpu_seconds: float | None = None
    gc_seconds: float | None = None
    rows_in: int | None = None
    rows_out: int | None = None
    bytes_read: int | None = None
    bytes_written: int | None = None
    shuffle_read: int | None = None
    shuffle_written: int | None = None
    memory_spilled: int | None = None
    disk_spilled: int | None = None
    peak_memory: int | None = None

    def line(self) -> str:
        text = f"  stage {self.stage}: {self.completed}/{self.tasks} tasks, {self.failed} failed"
        if self.cpu_seconds is not None:
            text += f", {self.cpu_seconds:.2f} s of CPU, {self.bytes_read} bytes read, {self.shuffle_read} from and {self.shuffle_written} to shuffles, {self.disk_spilled} spilled, peak {self.peak_memory}"
        return f"{text} ({self.name})"


@dataclass(frozen=True)
class QueryMetrics:
    """Wall time and result rows of one action, and its stages in order."""

    seconds: float
    rows: int | None
    stages: tuple[StageMetrics, ...]

    @property
    def tasks(self) -> int:
        return sum(s.tasks for s in self.stages)

    def summary(self) -> str:
        lines = [f"{self.seconds:.3f} s, {'?' if self.rows is None else self.rows} rows, {self.tasks} tasks in {len(self.stages)} stages"]
        return "\n".join(lines + [s.line() for s in self.stages])


@contextmanager
def job_group(context: SparkContext, group: str, description: str = "") -> Iterator[None]:
    """Jobs of this thread belong to the group while the block runs."""
    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
    context.setJobGroup(group, description)
    try:
        yield
    finally:
        for key, value in before.items():
            context.setLocalProperty(key, value)


def measured(df: DataFrame, action: Callable[[DataFrame], Any]) -> tuple[Any, QueryMetrics]:
    """The action's result and its metrics. Rows are counted on the way (an observation), not by a second run."""
    context, seen, group = df.sparkSession.sparkContext, Observation(), f"measured-{uuid.uuid4().hex}"
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    began = time.perf_counter()
    with job_group(context, group, "measured action"):
        result = action(watched)
    seconds = time.perf_counter() - began
    tracker = context.statusTracker()
    stages = {}
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else []:
            if (s := tracker.getStageInfo(stage)) and s.numCompletedTasks + s.numFailedTasks:
                stages[stage] = StageMetrics(stage, s.name, s.numTasks, s.numCompletedTasks, s.numFailedTasks)
    return result, QueryMetrics(seconds, seen.get.get("rows"), tuple(stages[k] for k in sorted(stages)))
