"""A local session for tests and the bench; on a cluster the session comes from outside."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, checkpoint_dir: str | None = None, memory: str = "6g") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
    }
    if checkpoint_dir:
        conf["spark.checkpoint.dir"] = checkpoint_dir
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
