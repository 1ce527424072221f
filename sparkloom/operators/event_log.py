"""What a session's event log says: tasks, stages, and the events themselves, as tables.

The log is Spark's documented JSON lines. ``SessionOptions(event_log=folder)`` writes it as one plain file a session, which
can be read while the session runs: Spark flushes it whenever a stage or a job ends.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError
from .metrics import QueryMetrics, StageMetrics, job_group

#: The job group of this module's own reading.
_READING = "sparkloom-reads-its-event-log"

#: The parts of the events that are read: fixed names of Spark's format.
EVENTS = """
`Event` string, `Timestamp` bigint, `Job ID` int, `Submission Time` bigint, `Completion Time` bigint, `Stage ID` int, `Stage Attempt ID` int, `Stage IDs` array<int>,
`Properties` struct<`spark.sql.execution.id`: string, `spark.jobGroup.id`: string>, `Job Result` struct<`Result`: string>,
`Stage Info` struct<`Stage ID`: int, `Stage Attempt ID`: int, `Stage Name`: string, `Number of Tasks`: int, `Submission Time`: bigint, `Completion Time`: bigint, `Failure Reason`: string>,
`Task Info` struct<`Task ID`: bigint, `Index`: int, `Attempt`: int, `Launch Time`: bigint, `Finish Time`: bigint, `Executor ID`: string, `Failed`: boolean, `Killed`: boolean>,
`Task End Reason` struct<`Reason`: string>,
`Task Metrics` struct<`Executor Run Time`: bigint, `Executor CPU Time`: bigint, `JVM GC Time`: bigint, `Peak Execution Memory`: bigint, `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint, `Result Size`: bigint,
  `Input Metrics`: struct<`Bytes Read`: bigint, `Records Read`: bigint>, `Output Metrics`: struct<`Bytes Written`: bigint, `Records Written`: bigint>,
  `Shuffle Read Metrics`: struct<`Remote Bytes Read`: bigint, `Local Bytes Read`: bigint, `Total Records Read`: bigint>, `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint, `Shuffle Records Written`: bigint>>
"""


def log_path(spark: SparkSession) -> str:
    """The running session's log file."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.eventLog.enabled", "false") != "true":
        raise PlanError("the session writes no event log: see SessionOptions.event_log")
    return f"{conf.get('spark.eventLog.dir')}/{spark.sparkContext.applicationId}*"


def read_events(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The events of a log (of the running session's without a path), one row each, in columns EVENTS."""
    return spark.read.schema(EVENTS).json(path or log_path(spark))


def task_metrics(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A row for each attempt of a task, failed ones too."""
    info, metrics = F.col("`Task Info`"), F.col("`Task Metrics`")
    bytes_read = metrics["Shuffle Read Metrics"]["Remote Bytes Read"] + metrics["Shuffle Read Metrics"]["Local Bytes Read"]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")  # noqa: E731 - a task that failed early reports nothing
    return read_events(spark, path).where(F.col("Event") == "SparkListenerTaskEnd").select(
        F.col("`Stage ID`").alias("stage"),
        F.col("`Stage Attempt ID`").alias("stage_attempt"),
        info["Task ID"].alias("task"),
        info["Index"].alias("partition"),
        info["Attempt"].alias("attempt"),
        info["Executor ID"].alias("executor"),
        F.col("`Task End Reason`")["Reason"].alias("end"),
        ((info["Finish Time"] - info["Launch Time"]) / 1000).alias("seconds"),
        (zero(metrics["Executor CPU Time"]) / 1e9).alias("cpu_seconds"),
        (zero(metrics["JVM GC Time"]) / 1000).alias("gc_seconds"),
        zero(metrics["Peak Execution Memory"]).alias("peak_memory"),
        zero(metrics["Input Metrics"]["Records Read"] + metrics["Shuffle Read Metrics"]["Total Records Read"]).alias("rows_in"),
        zero(metrics["Output Metrics"]["Records Written"] + metrics["Shuffle Write Metrics"]["Shuffle Records Written"]).alias("rows_out"),
        zero(metrics["Input Metrics"]["Bytes Read"]).alias("bytes_read"),
        zero(metrics["Output Metrics"]["Bytes Written"]).alias("bytes_written"),
        zero(bytes_read).alias("shuffle_read"),
        zero(metrics["Shuffle Write Metrics"]["Shuffle Bytes Written"]).alias("shuffle_written"),
        zero(metrics["Memory Bytes Spilled"]).alias("memory_spilled"),
        zero(metrics["Disk Bytes Spilled"]).alias("disk_spilled"),
    )


def stage_metrics(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A row for each stage that ended, over all of its attempts: the columns of StageMetrics, and when it began (milliseconds).

    ``retries`` counts attempts of tasks after a failure, ``attempts`` those of the stage: more than one means that lost
    output was made again from its lineage.
    """
    total = lambda name: F.sum(name).alias(name)
    good = F.col("end") == "Success"
    tasks = task_metrics(spark, path).groupBy("stage").agg(
        F.count_if(good).cast("int").alias("completed"),
        F.count_if(~good).cast("int").alias("failed"),
        F.count_if(F.col("attempt") > 0).cast("int").alias("retries"),
        F.sum("seconds").alias("task_seconds"),
        *[total(c) for c in ("cpu_seconds", "gc_seconds", "rows_in", "rows_out", "bytes_read", "bytes_written", "shuffle_read", "shuffle_written", "memory_spilled", "disk_spilled")],
        F.max("peak_memory").alias("peak_memory"),
    )
    info = F.col("`Stage Info`")
    stages = read_events(spark, path).where(F.col("Event") == "SparkListenerStageCompleted").groupBy(info["Stage ID"].alias("stage")).agg(
        F.first(info["Stage Name"]).alias("name"),
        F.max(info["Number of Tasks"]).alias("tasks"),
        F.count("*").cast("int").alias("attempts"),
        F.min(info["Submission Time"]).alias("began"),
        (F.sum(info["Completion Time"] - info["Submission Time"]) / 1000).alias("seconds"),
    )
    return stages.join(tasks, "stage").select(*[f.name for f in fields(StageMetrics)], "began")


def session_events(spark: SparkSession, path: str | None = None) -> DataFrame:
    """What happened when: (at, event, job, stage, attempt, task, detail) for jobs, stages and tasks that failed."""
    info, stage = F.col("`Task Info`"), F.col("`Stage Info`")
    named = F.regexp_replace("Event", "^SparkListener", "")
    said = read_events(spark, path).where(F.col("Event").isin("SparkListenerJobStart", "SparkListenerJobEnd", "SparkListenerStageSubmitted", "SparkListenerStageCompleted") | ((F.col("Event") == "SparkListenerTaskEnd") & (F.col("`Task End Reason`")["Reason"] != "Success")))
    at: Column = F.coalesce("Submission Time", "Completion Time", stage["Completion Time"], stage["Submission Time"], info["Finish Time"])
    return said.select(
        F.timestamp_millis(at).alias("at"),
        named.alias("event"),
        F.col("`Job ID`").alias("job"),
        F.coalesce("Stage ID", stage["Stage ID"]).alias("stage"),
        F.coalesce(info["Attempt"], stage["Stage Attempt ID"]).alias("attempt"),
        info["Task ID"].alias("task"),
        F.coalesce(F.col("`Task End Reason`")["Reason"], stage["Failure Reason"], F.col("`Job Result`")["Result"], stage["Stage Name"]).alias("detail"),
    )


def last_run_metrics(spark: SparkSession) -> QueryMetrics | None:
    """The metrics of the session's last finished action, from its event log; None before any. The action needs no wrapper.
    Reading the log is no action of its own."""
    with job_group(spark.sparkContext, _READING):
        events = read_events(spark)
        said = F.col("Properties")
        jobs = events.where(F.col("Event") == "SparkListenerJobStart").where(~said["spark.jobGroup.id"].eqNullSafe(_READING))
        jobs = jobs.select("Job ID", F.col("`Submission Time`").alias("start"), F.col("`Stage IDs`").alias("stages"), said["spark.sql.execution.id"].alias("execution"))
        ends = events.where(F.col("Event") == "SparkListenerJobEnd").select("Job ID", F.col("`Completion Time`").alias("end"))
        done = jobs.join(ends, "Job ID").collect()  # a row a job
        if not done:
            return None
        last = max(done, key=lambda r: r["Job ID"])
        same = [r for r in done if r["Job ID"] == last["Job ID"] or last["execution"] is not None and r["execution"] == last["execution"]]
        wanted = sorted({s for r in same for s in r["stages"]})
        rows = stage_metrics(spark).where(F.col("stage").isin(wanted)).orderBy("stage").collect()
    stages = tuple(StageMetrics(**{f.name: r[f.name] for f in fields(StageMetrics)}) for r in rows)
    return QueryMetrics((max(r["end"] for r in same) - min(r["start"] for r in same)) / 1000, None, stages)
