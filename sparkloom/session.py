"""Sessions with the settings that the operators assume, and the folder that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class SessionOptions:
    """What a caller may choose; everything else is Spark's own default.

    ``task_retries`` counts attempts after the first. ``broadcast_limit_mb`` is the largest side that joins may broadcast
    without being told to. ``event_log`` is an existing folder for Spark's log of sessions, stages, tasks and retries, one plain
    file each (see ``operators.event_log``). Reliable checkpoints are deleted once nothing refers to them. ``extra`` holds any
    further Spark settings.
    """

    master: str = "local[4]"
    app_name: str = "sparkloom"
    shuffle_partitions: int = 8
    task_retries: int = 3
    partition_size_mb: int = 128
    broadcast_limit_mb: int = 10
    shuffle_compression: bool = True
    predicate_pushdown: bool = True
    event_log: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def settings(self) -> dict[str, str]:
        if self.shuffle_partitions < 1 or self.task_retries < 0 or self.partition_size_mb < 1:
            raise ValueError("partitions and sizes must be positive, retries not negative")
        return {
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions),
            "spark.task.maxFailures": str(self.task_retries + 1),
            "spark.sql.files.maxPartitionBytes": f"{self.partition_size_mb}m",
            "spark.sql.autoBroadcastJoinThreshold": f"{self.broadcast_limit_mb}m",
            "spark.shuffle.compress": str(self.shuffle_compression).lower(),
            "spark.sql.parquet.filterPushdown": str(self.predicate_pushdown).lower(),
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.ansi.enabled": "true",
            "spark.sql.session.timeZone": "UTC",
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
            **self._logged(),
            **self.extra,
        }

    def _logged(self) -> dict[str, str]:
        if not self.event_log:
            return {}
        return {"spark.eventLog.enabled": "true", "spark.eventLog.dir": self.event_log, "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"}

    def master_url(self) -> str:
        """``local`` and ``local[N]`` carry the retries, which local mode takes from its URL only."""
        found = re.fullmatch(r"local(?:\[(\d+|\*)\])?", self.master)
        return f"local[{found[1] or 1},{self.task_retries + 1}]" if found else self.master


def create_session(options: SessionOptions | None = None) -> SparkSession:
    """A session with the given options; an active one is reused, with its runtime settings changed."""
    options = options or SessionOptions()
    builder = SparkSession.builder.master(options.master_url()).appName(options.app_name)
    for key, value in options.settings().items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    return f"{folder}/sparkloom-{name}-{uuid.uuid4().hex}"
