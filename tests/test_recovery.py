"""Lost work is made again: tasks that fail, shuffle files that vanish, and what the event log says of it.

Each test has a session of its own in a process of its own, as a cluster would start one.
"""

import json
import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
START = """
import glob, json, os, sys
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import functions as F
from sparkloom import SessionOptions, create_session
from sparkloom import operators as ops
folder = {folder!r}
os.makedirs(folder + "/log", exist_ok=True)
extra = {{"spark.local.dir": folder + "/local", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": folder + "/warehouse", "spark.driver.memory": "1g"}}
spark = create_session(SessionOptions(master="local[2]", shuffle_partitions=3, task_retries=2, event_log=folder + "/log", extra=extra))
spark.sparkContext.setLogLevel("OFF")
"""


def said(tmp_path, text):
    """What a script prints as its last line, as JSON."""
    script = START.format(root=str(ROOT), folder=str(tmp_path)) + textwrap.dedent(text)
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=240, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr[-3000:]
    return json.loads(run.stdout.strip().splitlines()[-1])


def test_a_failed_task_is_tried_again(tmp_path):
    out = said(
        tmp_path,
        """
        def once(batches):
            context = TaskContext.get()
            if context.partitionId() == 1 and context.attemptNumber() == 0:
                raise RuntimeError("lost on purpose")
            yield from batches

        df = spark.range(0, 100, 1, 4).mapInArrow(once, "id long").groupBy((F.col("id") % 5).alias("k")).agg(F.sum("id").alias("s"))
        found = sorted(map(list, df.collect()))
        last = ops.last_run_metrics(spark)
        events = [r.asDict() for r in ops.session_events(spark).drop("at").collect()]
        print(json.dumps({"rows": found, "failed": sum(s.failed for s in last.stages), "retries": sum(s.retries for s in last.stages), "events": events}))
        """,
    )
    assert out["rows"] == [[k, sum(range(k, 100, 5))] for k in range(5)]
    assert out["failed"] == out["retries"] == 1
    assert [e["detail"] for e in out["events"] if e["event"] == "TaskEnd"] == ["ExceptionFailure"]


def test_a_task_that_always_fails_ends_the_query(tmp_path):
    out = said(
        tmp_path,
        """
        def never(batches):
            raise RuntimeError("lost on purpose")
            yield

        try:
            spark.range(0, 10, 1, 1).mapInArrow(never, "id long").collect()
            error = ""
        except Exception as e:
            error = str(e)
        tasks = [r.asDict() for r in ops.task_metrics(spark).collect()]
        print(json.dumps({"error": "lost on purpose" in error, "attempts": sorted(t["attempt"] for t in tasks if t["end"] != "Success")}))
        """,
    )
    assert out == {"error": True, "attempts": [0, 1, 2]}


def test_lost_shuffle_files_are_made_again(tmp_path):
    out = said(
        tmp_path,
        """
        rows = spark.range(0, 3000, 1, 4).select((F.col("id") % 7).alias("k"), "id").repartition(3, "k")
        counts = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
        lineage = counts.rdd.map(tuple).sortBy(lambda r: r[0], numPartitions=2)
        before = lineage.collect()
        files = [f for f in glob.glob(folder + "/local/**/shuffle_*", recursive=True)]
        for f in files:
            os.remove(f)
        after = lineage.collect()
        stages = [r.asDict() for r in ops.stage_metrics(spark).drop("began").collect()]
        tasks = [r["end"] for r in ops.task_metrics(spark).select("end").collect()]
        print(json.dumps({"same": before == after, "rows": before, "files": len(files), "again": max(s["attempts"] for s in stages), "ends": sorted(set(tasks))}))
        """,
    )
    assert out["files"] > 0 and out["same"] and [r[1] for r in out["rows"]] == [429, 429, 429, 429, 428, 428, 428]
    assert out["again"] > 1 and "FetchFailed" in out["ends"]


def test_metrics_of_the_last_run(tmp_path):
    out = said(
        tmp_path,
        """
        none = ops.last_run_metrics(spark)
        spark.range(0, 200000, 1, 4).select((F.col("id") % 100).alias("k"), "id").write.parquet(folder + "/t")
        spark.read.parquet(folder + "/t").groupBy("k").agg(F.sum("id").alias("s")).collect()
        one = ops.last_run_metrics(spark)
        spark.read.parquet(folder + "/t").count()
        two = ops.last_run_metrics(spark)
        from dataclasses import asdict
        print(json.dumps({"none": none is None, "one": [asdict(s) for s in one.stages], "two": [asdict(s) for s in two.stages], "text": one.summary()}))
        """,
    )
    assert out["none"]
    first, last = out["one"][0], out["one"][-1]
    assert len(out["one"]) == 2 and first["shuffle_written"] > 0 and last["shuffle_read"] == first["shuffle_written"]
    assert first["rows_in"] == 200000 and first["bytes_read"] > 0 and last["rows_in"] == first["rows_out"]
    assert all(s["cpu_seconds"] > 0 and s["peak_memory"] > 0 and s["attempts"] == 1 and s["retries"] == 0 for s in out["one"])
    assert out["two"] and {s["stage"] for s in out["two"]}.isdisjoint(s["stage"] for s in out["one"])
    assert "s of CPU" in out["text"] and "2 stages" in out["text"]


def test_no_log_no_metrics(spark):
    from sparkloom import operators as ops
    from sparkloom.errors import PlanError

    with pytest.raises(PlanError):
        ops.last_run_metrics(spark)
