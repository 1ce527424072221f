"""All queries with workers that cannot import the package: only the driver knows where it is."""

import json
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import json, random, sys
sys.path[:0] = [{root!r}, {root!r} + "/tests/llm"]
import __spark_entry__ as entry_points
from corpus import SCHEMA, documents
from sparkloom import SessionOptions, create_session
folder = {folder!r}
spark = create_session(SessionOptions(master="local[4]", shuffle_partitions=4, extra={{"spark.ui.enabled": "false", "spark.driver.memory": "2g", "spark.sql.warehouse.dir": folder + "/w", "spark.checkpoint.dir": folder + "/shared"}}))
spark.sparkContext.setLogLevel("OFF")

def absent(batches):
    import pyarrow as pa
    for _ in batches:
        try:
            import sparkloom
            yield pa.RecordBatch.from_pydict({{"found": [True]}})
        except ImportError:
            yield pa.RecordBatch.from_pydict({{"found": [False]}})

found = {{"importable": spark.range(1).mapInArrow(absent, "found boolean").first()[0]}}
rows, rng = documents(plain=15, copies=4, near=5), random.Random(1)
spark.createDataFrame(rows, SCHEMA).write.parquet(folder + "/documents.parquet")
spark.createDataFrame([(r[0], k % 2, int(k % 5 == 0)) for k, r in enumerate(rows) if k % 2], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)], "vec_id long, embedding array<float>").write.parquet(folder + "/embeddings.parquet")
for name, query in entry_points.queries().items():
    if name == "pipeline" or name.startswith("op"):
        found[name] = query(spark, folder).count()
print(json.dumps(found | {{"rows": len(rows)}}))
"""


def test_every_query_without_the_package_on_workers(tmp_path):
    script = SCRIPT.format(root=str(ROOT), folder=str(tmp_path))
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr[-3000:]
    out = json.loads(run.stdout.strip().splitlines()[-1])
    assert out.pop("importable") is False
    rows = out.pop("rows")
    assert len(out) == 11 and out.pop("op1_hnsw") == 30
    assert out.pop("op7_config_lp_packing") >= rows and out.pop("pipeline") > 0
    assert set(out.values()) == {rows}
