"""What a job leaves in the memory of executors is given back before the next one, in every stage of the pipeline."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
from corpus import SCHEMA

import corpus_pipeline

ROOT = Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import json, re, sys
from pathlib import Path
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import corpus_pipeline
folder = {folder!r}
conf = {{"spark.master": "local-cluster[2,2,1200]", "spark.executor.memory": "1200m", "spark.executor.extraJavaOptions": "-XX:+UseG1GC -XX:ActiveProcessorCount=2", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": folder + "/w", "spark.checkpoint.dir": "file://" + folder + "/shared"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def held():
    out = {{}}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            said = (p / "cmdline").read_text().split("\\0")
            if said[0].endswith("java") and "org.apache.spark.executor.CoarseGrainedExecutorBackend" in said and folder in " ".join(said):
                out[p.name] = int(re.search(r"RssAnon:\\s+(\\d+)", (p / "status").read_text())[1]) // 1024
        except OSError:
            pass
    return out

spark.range(0, 6_000_000, 1, 4).selectExpr("id % 500003 k", "repeat('x', 50) t").groupBy("k").agg({{"t": "collect_list"}}).write.format("noop").mode("overwrite").save()
before = held()
corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame([], "doc_id long, text string"), "")
print(json.dumps([before, held()]))
"""


def test_executors_give_memory_back(tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors write to Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), folder=str(tmp_path))], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=env)
    assert run.returncode == 0, run.stderr[-3000:]
    before, after = json.loads(run.stdout.strip().splitlines()[-1])
    assert len(before) == 2 and before.keys() == after.keys()
    assert all(after[k] < 0.85 * before[k] for k in before), (before, after)


def test_every_stage_begins_with_it(spark, monkeypatch):
    told = []
    monkeypatch.setattr(corpus_pipeline, "trim_executors", lambda session: told.append(session))
    empty = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, "").count() == 0 and told == [spark] * (k + 1)
