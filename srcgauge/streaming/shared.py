"""Where jobs keep checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared one.

    Only a session that runs in one local process may lack the setting (a test);
    it gets a folder of its own. Elsewhere a machine-local folder would lose
    rows, so the missing setting is an error.
    """
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="srcgauge-")
        spark.conf.set(SETTING, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid4().hex}"
